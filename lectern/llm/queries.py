"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (byte_bpe, chat_windows, decontaminate, importance, mixing_lm, ngram_join, pii_crf, quality, raking,
                         repeats, token_alignment, token_shards, toxicity)
from lectern.session import read_table, ship_package

LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        LLM_QUERIES[name] = run
        if oracle:
            LLM_ORACLES[name] = oracle
        return run
    return deco


OWN_CONVERSATION = -7


@query("op1_chat_windows")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(OWN_CONVERSATION, 0, "user", said), (OWN_CONVERSATION, 1, "assistant", said)],
                                "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return chat_windows.read_back(chat_windows.format_windows(rows.unionByName(own)))


END_ID = 2


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_shards.write_shards(read_table(spark, sf_dir, "documents"), word_bpe_path(), END_ID)
    return token_shards.read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(read_table(spark, sf_dir, "documents")).drop("kept")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_mixture_raking", oracle=raking.oracle_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.weigh(read_table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 9))


@query("op6_pii_crf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op7_mixing_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(read_table(spark, sf_dir, "documents"))


@query("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read_table(spark, sf_dir, "documents"))


@query("op9_benchmark_overlap")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.annotate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op10_host_quality", oracle=r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (SELECT *, CAST(n_words < 20 AS INT) AS f1, CAST(100 * n_repeat_words > 30 * n_words AS INT) AS f2,
             CAST(100 * n_symbols > 50 * n_words AS INT) AS f3, CAST(100 * n_dup_lines > 60 * n_lines AS INT) AS f4,
             CAST(word_chars > 30 * n_words AS INT) AS f5 FROM m),
r AS (SELECT host, rule, count(*) AS n, sum(v) AS k FROM (
        SELECT host, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS v FROM f) GROUP BY host, rule),
g AS (SELECT rule, sum(n) AS total, count(*) AS hosts, sum(k) AS fails, sum(CAST(k AS DOUBLE) * k / n) AS q FROM r GROUP BY rule),
p AS (SELECT rule, rate, least(greatest(rate * (1 - rate) / greatest(q / total - rate * rate
             - rate * (1 - rate) * hosts / total, 1e-12) - 1, 1.0), 1000.0) AS weight
      FROM (SELECT *, least(greatest(fails / total, 1e-6), 1 - 1e-6) AS rate FROM g)),
v AS (SELECT host, max((k + rate * weight) / (n + weight)) > 0.5 AS failed FROM r JOIN p USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 + f2 > 0 AS base_failed,
       f1 + f2 = 0 AND NOT v.failed AS kept
FROM f JOIN v ON v.host IS NOT DISTINCT FROM f.host
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read_table(spark, sf_dir, "documents"),
                                 tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op13_importance", oracle=importance.oracle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
