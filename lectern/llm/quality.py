"""Document and host quality rules, DataFrame functions only.

Every document is measured by five rules. Rule failures are summed per host
(partial sums before the shuffle, so a host with a third of all rows costs
one row per task), each rule's failure rate is shrunk towards the mean of all
hosts with a beta prior fitted to the hosts by moments, and hosts whose shrunk
rate passes a limit are rejected. The verdict is joined back to documents.

Defined results: NULL or empty text has no words and fails the ``short``
rule; NULL host is a host of its own; repeated rows are judged row by row;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD_GAP, let, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines", "long_words")


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 20
    max_repeat_pct: int = 30      # words in repeated windows, of all words
    max_symbol_pct: int = 50      # symbols per 100 words
    max_dup_line_pct: int = 60    # repeated lines, of all lines with a word
    max_word_chars: int = 30      # mean length of a word
    max_host_rate: float = 0.5    # shrunk failure rate of a host


def _repeat_words(word_hashes: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text."""
    windows = F.when(
        F.size(word_hashes) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(word_hashes) - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice(word_hashes, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(ws: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

            def total(at: Column) -> Column:
                steps = F.transform(at, lambda x, j: F.least(
                    F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
                return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), total)
        ordered = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # most texts repeat no window: a hash set decides that without a sort
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("bigint")).otherwise(
            let(ordered, of_sorted))
    return let(windows, covered)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row per document: counts and the rules it fails (no shuffle)."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    split = base.select(
        "doc_id", "host", "text",
        F.filter(F.split("text", WORD_GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    counted = split.select(
        "doc_id", "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", WORD_GAP, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    measured = counted.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        _repeat_words(F.col("hashes")).alias("n_repeat_words"))
    n = F.col("n_words")
    return measured.withColumns({
        "fail_short": n < limits.min_words,
        "fail_repeats": 100 * F.col("n_repeat_words") > limits.max_repeat_pct * n,
        "fail_symbols": 100 * F.col("n_symbols") > limits.max_symbol_pct * n,
        "fail_dup_lines": 100 * F.col("n_dup_lines") > limits.max_dup_line_pct * F.col("n_lines"),
        "fail_long_words": F.col("word_chars") > limits.max_word_chars * n,
    }).withColumn("base_failed", F.col("fail_short") | F.col("fail_repeats"))


def host_rates(measured: DataFrame) -> DataFrame:
    """Failures per host and rule: ``host, n_docs, <rule>_n``."""
    return measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(F.col(f"fail_{r}").cast("bigint")).alias(f"{r}_n") for r in RULES])


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Per rule, (alpha, beta) of the prior by the method of moments over hosts.

    One row of sums reaches the driver. The spread between hosts beyond
    binomial noise sets the prior's weight; it lies between 1 and 1000.
    """
    n = F.col("n_docs")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("n")]
    for r in RULES:
        sums += [F.sum(f"{r}_n").alias(f"{r}_f"), F.sum(F.col(f"{r}_n") * F.col(f"{r}_n") / n).alias(f"{r}_q")]
    row = hosts.agg(*sums, F.sum(n * n).alias("nn")).first()
    priors = {}
    for r in RULES:
        total, k = row["n"] or 0, row["k"]
        if not total:
            priors[r] = (0.5, 0.5)
            continue
        m = min(max(row[f"{r}_f"] / total, 1e-6), 1 - 1e-6)
        # weighted variance of host rates, less what binomial noise explains
        var = row[f"{r}_q"] / total - m * m
        noise = m * (1 - m) * k / total
        extra = max(var - noise, 1e-12)
        weight = min(max(m * (1 - m) / extra - 1, 1.0), 1000.0)
        priors[r] = (m * weight, (1 - m) * weight)
    return priors


def host_verdicts(hosts: DataFrame, priors: dict[str, tuple[float, float]],
                  limits: QualityLimits = QualityLimits()) -> DataFrame:
    """``host, n_docs, host_rate, host_failed``: worst shrunk rate over the rules."""
    rates = [(F.col(f"{r}_n") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b)) for r, (a, b) in priors.items()]
    return hosts.select("host", "n_docs", F.greatest(*rates).alias("host_rate")).withColumn(
        "host_failed", F.col("host_rate") > limits.max_host_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Measures, rule failures, host rate and ``kept`` for every document."""
    # read twice below (rates, join): the measures are written, texts are not
    measured = stored(measure(docs, id_col, text_col, host_col, limits), "quality")
    hosts = host_rates(measured)
    verdicts = host_verdicts(hosts, beta_priors(hosts), limits).select(
        F.col("host").alias("verdict_host"), "host_rate", "host_failed")
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["verdict_host"]), "left")
    return joined.drop("verdict_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
