"""Target-distribution importance resampling over hashed word n-grams.

Every document is weighted by how much likelier its n-grams are in a target
text than in the corpus; documents are then drawn without replacement by
Gumbel-perturbed weights (the highest scores win, so a draw is a top-k).

* Words are maximal runs of letters, digits and non-ASCII characters; only
  A-Z is lower-cased. Features are all runs of ``n_min`` to ``n_max`` words,
  joined by one space. A feature's bucket is the crc32 of its bytes modulo
  ``BUCKETS``.
* The features of one batch are interned in an open-addressed table
  (:class:`Table`): the xxhash64 of the bytes picks the slot, equal keys are
  verified byte by byte, collisions step to the next slot. A slot stores the
  feature's bucket and count, so crc32 runs once per distinct feature.
* Pass 1 sums slot counts per bucket inside each task; what is shuffled and
  collected is one number per bucket (``BUCKETS`` rows, whatever the input).
* The gain of a bucket comes from both sums. Pass 2 interns again and gathers
  each occurrence's gain through its slot id; only numbers leave the task.
* Ranks are positions in a range sort of (score, doc_id); no task sees more
  than its range, and no threshold is estimated.

Texts are read in blocks of ``BLOCK`` bytes cut at word gaps (n-grams across
a cut are kept by carrying words over), so memory does not grow with a text.

Defined results: a NULL or empty text has no features, weight 0 and no rank;
a NULL doc_id is hashed as an empty id and sorts first among ties; repeated
rows are drawn each for itself (ties in any order); empty tables give empty
results, an empty target gives gains of the corpus side alone; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, stored
from lectern.operators.catalog import global_position

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
BLOCK = 1 << 18          # bytes of a text that are split into words at once
BATCH = 1 << 16          # features interned at once

#: A-Z as a-z; every other ASCII byte that is no letter or digit as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Table:
    """Open-addressed table of the features of one batch, linear probing, at most half full."""

    def __init__(self, grams: list[bytes], buckets: int):
        n = len(grams)
        size = 1 << max(4, (2 * n).bit_length())
        keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, n)
        holder = np.full(size, -1, np.int64)              # occurrence whose bytes a slot stands for
        self.slot = (keys & np.uint64(size - 1)).astype(np.int64)   # of every occurrence
        left = np.arange(n)
        while len(left):
            at = self.slot[left]
            free = np.flatnonzero(holder[at] < 0)[::-1]
            holder[at[free]] = left[free]                 # the first occurrence takes a free slot
            held = holder[at]
            same = keys[held] == keys[left]
            ask = np.flatnonzero(same & (held != left))   # equal keys: the bytes decide
            same[ask] = [grams[i] == grams[j] for i, j in zip(left[ask].tolist(), held[ask].tolist())]
            left = left[~same]
            self.slot[left] = (self.slot[left] + 1) & (size - 1)
        self.used = np.flatnonzero(holder >= 0)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.used] = [zlib.crc32(grams[i]) % buckets for i in holder[self.used].tolist()]
        self.count = np.bincount(self.slot, minlength=size)

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket[self.used], self.count[self.used], minlength=buckets).astype(np.int64)


def _blocks(text: bytes, n_min: int, n_max: int) -> Iterator[tuple[int, list[bytes]]]:
    """``(words, features)`` of a text, block by block; features that end in a block belong to it."""
    text = text.translate(_FOLD)
    lo, carry = 0, []
    while lo < len(text):
        hi = text.find(b" ", lo + BLOCK)
        hi = len(text) if hi < 0 else hi
        new = text[lo:hi].split()
        lo = hi
        if not new:
            continue
        if n_max == 1:
            yield len(new), new
            continue
        words = carry + new
        grams = []
        for n in range(n_min, n_max + 1):
            first = max(0, len(carry) - n + 1)
            grams += [b" ".join(words[i:i + n]) for i in range(first, len(words) - n + 1)]
        yield len(new), grams
        carry = words[-(n_max - 1):]


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def _interned(texts: list[bytes], n_min: int, n_max: int, buckets: int, n_words: np.ndarray):
    """``(table, row of each feature)`` per batch of features; adds the words of each row to ``n_words``."""
    grams, rows = [], []
    for row, text in enumerate(texts):
        for words, got in _blocks(text, n_min, n_max):
            n_words[row] += words
            grams += got
            rows.append((row, len(got)))
            if len(grams) >= BATCH:
                yield Table(grams, buckets), np.repeat(*np.array(rows).T)
                grams, rows = [], []
    if grams:
        yield Table(grams, buckets), np.repeat(*np.array(rows).T)


def bucket_counts(texts: DataFrame, text_col: str = "text", n_min: int = 1, n_max: int = 1,
                  buckets: int = BUCKETS) -> DataFrame:
    """Features of all texts per bucket: ``(bucket, n)``, one row per bucket that occurs."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = _texts(batch.column(0))
            for table, _ in _interned(column, n_min, n_max, buckets, np.zeros(len(column), np.int64)):
                total += table.bucket_counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    part = columns_of(texts, text_col).mapInArrow(run, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, ``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))``, from two tables of bucket counts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, counts in ((s, corpus), (t, target)):
        for r in counts.collect():                        # at most ``buckets`` rows
            into[r["bucket"]] = r["n"]
    size, goal = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((a + 1.0) * size / ((b + 1.0) * goal)))
                     for a, b in zip(t.tolist(), s.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n_min: int = 1, n_max: int = 1) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean of the gains of a document's features."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(1))
            n_words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for table, row in _interned(texts, n_min, n_max, buckets, n_words):
                n += np.bincount(row, minlength=len(texts))
                total += np.bincount(row, gain[table.bucket[table.slot]], minlength=len(texts)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def perturbation(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from the hash of its id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n_min: int = 1, n_max: int = 1, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Every document with ``n_features, weight, score, rank``; drawn documents have a rank.

    Of the N documents with ``min_words`` words or more, the ``percent * N // 100``
    highest scores are drawn, ties to the smaller ``doc_id``.
    """
    if not 1 <= n_min <= n_max:
        raise ValueError("n_min must be 1 or more and at most n_max")
    gain = gains(bucket_counts(docs, "text", n_min, n_max, buckets),
                 bucket_counts(target, "text", n_min, n_max, buckets), buckets)
    scored = stored(weigh(docs, gain, n_min, n_max).withColumn(
        "score", F.col("weight") + perturbation(F.col("doc_id"), seed)), "importance")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    placed = global_position(fit, [F.desc("score"), F.asc("doc_id")], name="rank").withColumn(
        "rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """The same draw in SQL: crc32 byte by byte over distinct words, with a table built from its polynomial."""
    words = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w")
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE poly(i, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, {step}, k + 1 FROM poly WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
dw AS (SELECT doc_id, row_number() OVER () AS r, coalesce(w, []) AS w FROM (SELECT doc_id, {words} FROM documents)),
occ AS (SELECT r, unnest(w) AS f FROM dw),
tocc AS (SELECT unnest(w) AS f FROM (SELECT {words} FROM benchmark)),
vocab AS (SELECT DISTINCT f FROM (SELECT f FROM occ UNION ALL SELECT f FROM tocc)),
hexed AS (SELECT f, hex(encode(f)) AS x FROM vocab),
bytes AS (SELECT f, list_transform(range(0, length(x) // 2),
            lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS b FROM hexed),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
            lambda c, y: xor(c >> 8, t[CAST((xor(c, y) & 255) + 1 AS INT)])), 4294967295) % {BUCKETS} AS bucket
        FROM bytes, tab),
s AS (SELECT bucket, count(*) AS n FROM occ JOIN crc USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM tocc JOIN crc USING (f) GROUP BY 1),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + {BUCKETS})
            / ((s.n + 1)::DOUBLE * (tot.t + {BUCKETS})))) AS BIGINT) AS g
         FROM s LEFT JOIN t USING (bucket), tot),
w AS (SELECT r, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight
      FROM occ JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT dw.r, doc_id, CAST(len(dw.w) AS BIGINT) AS n_features, coalesce(w.weight, 0) AS weight,
       coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((
         CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
     FROM dw LEFT JOIN w USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () AS n
           FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN p <= {PERCENT} * n // 100 THEN CAST(p AS BIGINT) END AS rank
FROM scored LEFT JOIN placed USING (r)
"""
