"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Starting from one
sampling probability for all, each step scales the cells of one margin so
that its expected tokens meet the target, and no probability passes 1; the
three margins take turns. Documents are then drawn by their cell's probability,
each by a number that depends on its doc_id alone, so a rerun draws the same.

The sums are partial before the shuffle (a hot source costs one row per task
and cell). The cells are few by nature (curated sources x languages x topics)
and are fitted on the driver; more than ``MAX_CELLS`` is an error that asks for
coarser groups. Their probabilities return as a small broadcast table.

Defined results: NULL source or language is a value of its own; NULL or empty
text has topic ``short`` and no tokens, NULL doc_id draws like an empty string;
cells without tokens keep the starting probability; repeated rows are drawn
alike; an empty table gives an empty table; extra columns pass through
``sample``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGINS = ("source", "lang", "topic")
MAX_CELLS = 200_000
BUDGET = 0.7              # expected share of all tokens that is drawn
TEMPER = 0.7              # default targets: shares to this power
ROUNDS = 10
_WORD = "[^\\x20\\x09-\\x0D]+"


def topic(text: Column) -> Column:
    """Kind of text by its layout."""
    words, lines = F.regexp_count(text, F.lit(_WORD)), F.regexp_count(text, F.lit("\n")) + 1
    return (F.when(text.contains(" | "), "table").when(words < 100, "short").when(words < 8 * lines, "list")
            .when(words >= 1000, "long").otherwise("prose"))


def described(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", "lang", topic(text).alias("topic"),
                       F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("tokens"))


def draw_number(id_col: Column) -> Column:
    """Uniform number in [0, 1) that depends on the id alone."""
    return F.conv(F.substr(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast(
        "double") / F.lit(float(1 << 32))


def rake(cells: list[dict], targets: dict[str, dict] | None = None, budget: float = BUDGET,
         rounds: int = ROUNDS) -> np.ndarray:
    """Probability of every cell; ``targets`` gives shares per margin and value."""
    tokens = np.array([c["tokens"] for c in cells], float)
    p = np.full(len(cells), budget)
    total = tokens.sum()
    if not total:
        return p
    codes, goals = [], []
    for m in MARGINS:
        values = {v: k for k, v in enumerate(dict.fromkeys(c[m] for c in cells))}
        code = np.array([values[c[m]] for c in cells])
        if targets and m in targets:
            share = np.array([float(targets[m].get(v, 0.0)) for v in values])
        else:
            share = (np.bincount(code, weights=tokens) / total) ** TEMPER
        codes.append(code)
        goals.append(share / share.sum() * budget * total)
    for _ in range(rounds):
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weights=tokens * p)
            scale = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            p = np.where(tokens > 0, np.minimum(1.0, p * scale[code]), p)
    return p


def probabilities(info: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """``source, lang, topic, tokens, probability`` for every cell."""
    cells = info.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of {MARGINS}: group sources more coarsely")
    cells = sorted((c.asDict() for c in cells), key=lambda c: tuple((c[m] is not None, c[m] or "") for m in MARGINS))
    p = rake(cells, targets, budget)
    rows = [(c["source"], c["lang"], c["topic"], int(c["tokens"]), float(x)) for c, x in zip(cells, p)]
    return info.sparkSession.createDataFrame(
        rows, "source string, lang string, topic string, tokens bigint, probability double")


def _same_cell(a: DataFrame, b: DataFrame) -> Column:
    return (a["source"].eqNullSafe(b["source"]) & a["lang"].eqNullSafe(b["lang"]) & a["topic"].eqNullSafe(b["topic"]))


def weigh(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, probability, sampled`` for every document."""
    info = described(docs)
    cells = probabilities(info, targets, budget).drop("tokens")
    joined = info.join(F.broadcast(cells), _same_cell(info, cells))
    return joined.select("doc_id", info["source"], info["lang"], info["topic"], "tokens", "probability",
                         (draw_number(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """Rows of ``docs`` that are drawn, all columns unchanged; texts are not shuffled."""
    cells = probabilities(described(docs), targets, budget).drop("tokens")
    own = docs.withColumn("_topic", topic(F.coalesce(F.col("text"), F.lit(""))))
    joined = own.join(F.broadcast(cells), own["source"].eqNullSafe(cells["source"]) & own["lang"].eqNullSafe(cells["lang"])
                      & own["_topic"].eqNullSafe(cells["topic"]))
    return joined.where(draw_number(own["doc_id"]) < cells["probability"]).select(*[own[c] for c in docs.columns])


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same fit as SQL, one table per step."""
    steps = []
    name = "c0"
    for r in range(rounds):
        for m in MARGINS:
            new = f"c{len(steps) + 1}"
            steps.append(
                f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN least(1.0, p * coalesce("
                f"(SELECT goal FROM goal_{m} g WHERE g.v IS NOT DISTINCT FROM c.{m}) / nullif(sum(tokens * p) OVER (PARTITION BY {m}), 0), 1)) "
                f"ELSE p END AS p FROM {name} c)")
            name = new
    goals = [f"goal_{m} AS MATERIALIZED (SELECT {m} AS v, pow(s / t, {TEMPER}) / sum(pow(s / t, {TEMPER})) OVER () * {BUDGET} * t AS goal "
             f"FROM (SELECT {m}, CAST(sum(tokens) AS DOUBLE) AS s, sum(sum(tokens)) OVER () AS t FROM c0 GROUP BY {m}))" for m in MARGINS]
    return (
        "WITH w AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, "
        "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, "
        "len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines FROM documents), "
        "d AS MATERIALIZED (SELECT doc_id, source, lang, CAST(tokens AS BIGINT) AS tokens, CASE WHEN contains(text, ' | ') THEN 'table' "
        "WHEN tokens < 100 THEN 'short' WHEN tokens < 8 * lines THEN 'list' WHEN tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM w), "
        f"c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, CAST({BUDGET} AS DOUBLE) AS p FROM d GROUP BY ALL), "
        + ", ".join(goals + steps) +
        f" SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(c.p, 9) AS probability, "
        "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < c.p AS sampled "
        f"FROM d JOIN {name} c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic")
