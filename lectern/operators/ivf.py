"""A1, A2: stored inverted-file vector index, probed cell by cell.

Build (:func:`build`), once:

1. *Cells* are unit vectors: :func:`fit_cells` runs k-means on a bounded sample
   (``sample_rows``, taken by hash of the keys); :func:`first_cells` takes the
   first vectors in key order, for results that must be reproducible in SQL.
2. Every vector goes to its nearest cell (map-only). Cell sizes are counted;
   a cell of more than ``CELL_FILE_ROWS`` vectors is dealt over several files.
3. Vectors are packed into blocks (:mod:`lectern.operators.blocks`) and
   written with one folder per cell. A second table keeps the cells, their
   sizes and the number of probes.

Search (:meth:`Index.search`), from any session that sees the folder:

1. Each question finds its ``probes`` nearest cells (map-only) and is packed
   by cell.
2. Question blocks meet vector blocks in an equi-join on the cell. With few
   questions Spark broadcasts them and dynamic partition pruning reads only
   the probed folders; with many, both sides are shuffled by cell and AQE
   splits a hot one. Questions are never collected.
3. Exact cosine inside the block pairs, best k per task, ``row_number``.

The answer is the exact top k among the probed cells; with all cells probed
it is the exact answer. :meth:`Index.probes_for` measures, on a sample of
questions, how many cells a wanted recall takes.

A question may name a document (A2): ``post`` ranks first and then drops
other documents, so fewer than k hits may be left (as an index that filters
its own k hits); ``fill`` compares the document inside the block pairs, so each
question has k hits unless its cells hold fewer. That is what fetching more
and more hits until k are left would give, in one pass.

NULL and empty vectors are not indexed; a zero vector belongs to cell 0 and
scores 0. Vectors shorter or longer than the cells are compared with them over
the common prefix.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.blocks import (list_array, pack, pack_runs, packed_schema, padded_matrix, score_blocks, widest)
from lectern.operators.search import DEFAULT_TOP_K
from lectern.session import stored

MAX_CELLS = 65_536               # cells are held by the driver and by every task
SAMPLE_ROWS = 50_000             # vectors that k-means sees at most
CELL_FILE_ROWS = 1 << 18         # vectors of one cell in one file
NEAR_DECIMALS = 9                # cells whose similarity agrees so far tie: the lower number wins
QUESTIONS_AT_ONCE = 1024
QUESTION_ROWS = 512              # questions in one block


def _unit(mat: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)


def _vectors(rows: DataFrame, vector: str) -> np.ndarray:
    vec = list_array(rows.select(vector).toArrow().column(0))
    return padded_matrix(vec, widest(vec))[0]


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def first_cells(vectors: DataFrame, keys: Sequence[str], n_cells: int, vector: str = "embedding") -> np.ndarray:
    """The ``n_cells`` first vectors in key order as cells."""
    return _unit(_vectors(_usable(vectors, vector).orderBy(*keys).limit(n_cells), vector))


def fit_cells(vectors: DataFrame, keys: Sequence[str], n_cells: int, vector: str = "embedding",
              sample_rows: int = SAMPLE_ROWS, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Spherical k-means on the ``sample_rows`` vectors whose keys hash lowest."""
    if not 0 < n_cells <= MAX_CELLS:
        raise ValueError(f"n_cells must be 1 to {MAX_CELLS}")
    some = _usable(vectors, vector).orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(sample_rows)
    x = _unit(_vectors(some, vector))
    if len(x) <= n_cells:
        return x
    rng = np.random.default_rng(seed)
    cells = x[rng.choice(len(x), n_cells, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[lo:lo + 4096] @ cells.T, axis=1) for lo in range(0, len(x), 4096)])
        sums = np.zeros_like(cells)
        np.add.at(sums, near, x)
        lost = np.bincount(near, minlength=n_cells) == 0
        sums[lost] = x[rng.choice(len(x), int(lost.sum()))]      # an empty cell starts again elsewhere
        cells = _unit(sums)
    return cells


def nearest_cells(mat: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """``(rows, n)`` numbers of the nearest cells, nearest first, ties to the lower number."""
    w = min(mat.shape[1], cells.shape[1])
    near = np.round(_unit(mat)[:, :w] @ cells[:, :w].T, NEAR_DECIMALS)
    if n == 1:
        return np.argmax(near, axis=1)[:, None]
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def _assigned(vectors: DataFrame, cells: np.ndarray, vector: str) -> DataFrame:
    schema = T.StructType(vectors.schema.fields + [T.StructField("cell", T.IntegerType())])

    def run(batches):
        for rb in batches:
            vec = list_array(rb.column(vector))
            mat, _ = padded_matrix(vec, widest(vec))
            near = [nearest_cells(mat[lo:lo + QUESTIONS_AT_ONCE], cells, 1)[:, 0]
                    for lo in range(0, len(mat), QUESTIONS_AT_ONCE)]
            cell = pa.array(np.concatenate(near) if near else np.empty(0), pa.int32())
            yield pa.RecordBatch.from_arrays([*rb.columns, cell], names=[*rb.schema.names, "cell"])
    return vectors.mapInArrow(run, schema)


def build(vectors: DataFrame, path: str, cells: np.ndarray, keys: Sequence[str], payload: Sequence[str] = (),
          vector: str = "embedding", probes: int = 8, cell_file_rows: int = CELL_FILE_ROWS) -> "Index":
    """Write the index of every usable vector; ``cells`` come from one of the two functions above."""
    if not len(cells):
        cells = np.zeros((1, 1))
    if len(cells) > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    spark = vectors.sparkSession
    carried = list(dict.fromkeys((*keys, *payload)))
    rows = _usable(vectors.select(*dict.fromkeys((*carried, vector))), vector)
    sizes = np.zeros(len(cells), np.int64)
    for r in _assigned(rows.select(vector), cells, vector).groupBy("cell").count().collect():    # one row per cell
        sizes[r["cell"]] = r["count"]
    files = F.element_at(F.lit([max(1, math.ceil(n / cell_file_rows)) for n in sizes.tolist()]), F.col("cell") + 1)
    dealt = _assigned(rows, cells, vector).withColumn("_file", F.pmod(F.xxhash64(*keys), files))
    dealt = dealt.repartition("cell", "_file").sortWithinPartitions("cell", *keys)
    blocks = pack(dealt, "cell", keys, carried, vector)
    blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c, n, probes, blocks.schema.json()) for i, (c, n) in enumerate(zip(cells.tolist(), sizes.tolist()))],
                          "cell int, centre array<double>, vectors long, probes int, layout string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/cells")
    return Index(spark, path, keys, payload)


class Index:
    """A stored index, opened in any session."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], payload: Sequence[str] = ()):
        self.spark, self.path, self.keys, self.payload = spark, path, list(keys), list(payload)
        table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()       # at most MAX_CELLS rows
        self.cells = padded_matrix(list_array(table.column("centre")), widest(list_array(table.column("centre"))))[0]
        self.sizes = table.column("vectors").to_numpy()
        self.probes = table.column("probes")[0].as_py()
        self.layout = T.StructType.fromJson(json.loads(table.column("layout")[0].as_py()))

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(self.layout).parquet(f"{self.path}/vectors")

    def _asked(self, questions: DataFrame, query_key: str, probes: int) -> DataFrame:
        """Questions packed by the cells they probe."""
        cells = self.cells
        fields = [f for f in questions.schema.fields if f.name != "_vec"]
        schema = packed_schema(T.StructField("cell", T.IntegerType()), fields, "q_")
        names = [f.name for f in schema.fields]
        single = questions.schema["_vec"].dataType.elementType == T.FloatType()

        def run(batches):
            for rb in batches:
                for lo in range(0, rb.num_rows, QUESTIONS_AT_ONCE):
                    part = rb.slice(lo, QUESTIONS_AT_ONCE)
                    vec = list_array(part.column("_vec"))
                    mat, sq = padded_matrix(vec, widest(vec))
                    near = nearest_cells(mat, cells, probes).astype(np.int32)
                    row = np.repeat(np.arange(len(near)), near.shape[1])
                    order = np.argsort(near.ravel(), kind="stable")
                    row = row[order]
                    yield pack_runs(pa.array(near.ravel()[order]), (mat.astype(np.float32) if single else mat)[row], np.sqrt(sq)[row],
                                    {f.name: part.column(f.name).take(pa.array(row)) for f in fields},
                                    names, QUESTION_ROWS)
        # the filter also tells the optimizer that pruning the index by these rows pays
        return questions.mapInArrow(run, schema).where(F.col("q_n") > 0)

    def search(self, questions: DataFrame, query_key: str = "query_id", query_vector: str = "embedding",
               top_k: str | None = "top_k", default_k: int = DEFAULT_TOP_K, probes: int | None = None,
               doc_filter: str | None = None, corpus_doc: str = "doc_id", filter_mode: str = "post") -> DataFrame:
        """Hits ``(query_key, rank, *keys, *payload, score)`` among the probed cells."""
        if filter_mode not in ("post", "fill"):
            raise ValueError("filter_mode must be 'post' or 'fill'")
        k = (F.coalesce(F.col(top_k).cast("int"), F.lit(default_k))
             if top_k and top_k in questions.columns else F.lit(default_k))
        scoped = doc_filter is not None and doc_filter in questions.columns
        doc = [F.col(doc_filter).alias("_doc")] if scoped else []
        q = questions.select(query_key, F.col(query_vector).alias("_vec"), k.alias("_k"), *doc).where(
            (F.col("_k") > 0) & F.col("_vec").isNotNull())
        out = [query_key, "rank", *self.keys, *[c for c in self.payload if c not in self.keys], "score"]
        n = min(probes or self.probes, len(self.cells))
        if not scoped:
            return self._hits(q, query_key, n).where(F.col("rank") <= F.col("_k")).select(*out)
        if filter_mode == "post":
            hits = self._hits(q, query_key, n).where(F.col("rank") <= F.col("_k"))
            return self._in_document(hits, q, query_key, corpus_doc).select(*out)
        return self._hits(q, query_key, n, corpus_doc).where(F.col("rank") <= F.col("_k")).select(*out)

    def _hits(self, q: DataFrame, query_key: str, probes: int, same: str | None = None) -> DataFrame:
        asked = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vec")).alias("d")).first()
        scored = score_blocks(self.blocks(), self._asked(q, query_key, probes), "cell", query_key, self.keys,
                              [c for c in self.payload if c not in self.keys],
                              asked["n"] * probes * max(1, asked["d"] or 1) * 8, (same, "_doc") if same else None)
        w = Window.partitionBy(query_key).orderBy(F.desc("score"), *[F.asc(c) for c in self.keys])
        return scored.withColumn("rank", F.row_number().over(w))

    def _in_document(self, hits: DataFrame, q: DataFrame, query_key: str, corpus_doc: str) -> DataFrame:
        """Hits of the question's own document, numbered again (a question without one keeps all)."""
        kept = hits.join(q.select(query_key, "_doc"), query_key).where(
            F.col("_doc").isNull() | (F.col("_doc") == F.col(corpus_doc)))
        return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy("rank")))

    def probes_for(self, questions: DataFrame, recall: float = 0.9, k: int = DEFAULT_TOP_K, sample: int = 400,
                   query_key: str = "query_id", query_vector: str = "embedding") -> int:
        """Cells to probe so that ``recall`` of the true top ``k`` of a sample of questions is met.

        The sample (``sample`` questions by hash) is answered from all cells, which is
        exact; each true hit needs as many probes as its cell's place in the question's order.
        Two standard errors of the sample are added to ``recall``.
        """
        some = stored(questions.where(F.col(query_vector).isNotNull()).orderBy(
            F.xxhash64(query_key), query_key).limit(sample).select(query_key, query_vector), "ivf-sample")
        truth = self._hits(some.withColumnRenamed(query_vector, "_vec").withColumn("_k", F.lit(k)), query_key,
                           len(self.cells)).where(F.col("rank") <= k)
        at = self.blocks().select("cell", F.explode("rows").alias("r")).select(
            "cell", *[F.col("r")[c].alias(c) for c in self.keys])
        need = truth.join(at, self.keys).join(some, query_key).select("cell", query_vector).toArrow()   # sample * k rows
        if not need.num_rows:
            return 1
        vec = list_array(need.column(query_vector))
        order = nearest_cells(padded_matrix(vec, widest(vec))[0], self.cells, len(self.cells))
        place = np.argmax(order == need.column("cell").to_numpy()[:, None], axis=1) + 1
        safe = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / len(place)))
        return int(np.sort(place)[math.ceil(safe * len(place)) - 1])

