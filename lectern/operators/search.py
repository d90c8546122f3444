"""Exact top-k retrieval by cosine similarity.

Plan for a table of questions against a chunk table of any size:

1. Questions are embedded and counted. They are split into blocks whose
   matrix (``rows x dim x 8`` bytes) stays under ``max_block_bytes`` and whose
   hits (the sum of their ``k``) under ``max_block_hits``; each block is
   collected once and shipped as a broadcast variable, the same route a
   broadcast join takes, but with its size checked first.
2. The chunk table is scanned once per block, map-only, in ``mapInArrow``:
   vectors come in as Arrow list arrays (no per-row Python objects). Tiles of
   cosines come from one single-precision BLAS product of unit vectors, or from
   a product of bytes where the vectors are counts; only
   pairs that can still reach a question's best ``k`` (within the rounding
   error of such a product) are scored exactly. Each task keeps its best ``k``
   rows per question (ties broken by the chunk key). Question pairs are never
   materialised as rows and chunks are never shuffled.
3. The per-task winners (``questions x k x tasks`` rows) are shuffled by
   question and ranked with ``row_number``; the literal ``k`` bound lets
   Spark add a partial window group limit before that shuffle.

With more than one block the chunk table is first written once to the shared
folder with a row number, so that no block chunks and embeds it again; a few
blocks run at a time and write their winners, so that the driver holds only
those. Winners are then keys, score and row number, and the payload of the
hits alone is joined to them by that number.

A question may name a document (``doc_id``); those questions go another way,
an equi-join on the document over packed blocks (:func:`_scoped_scores`), so
their work is linear in the chunks of the documents they name.
Chunks without a vector (NULL or empty) are skipped.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import whole
from lectern.operators.blocks import (Matrix, best_of_block, cosines, list_array, pack, padded_matrix, pair_cosines,
                                       score_blocks, widest)
from lectern.operators.worker import returning
from lectern.session import stored

DEFAULT_TOP_K = 5                       # fixed: default number of hits per question
MAX_BLOCK_BYTES = 64 * 1024 * 1024      # question matrix shipped per scan
MAX_BLOCK_HITS = 1 << 17                # hits that a task holds for a block of questions
BLOCKS_AT_ONCE = 4                      # blocks that are broadcast and scanned together
TASKS_A_CORE = 3                        # scan tasks of these blocks together, for each core
SPLITS_A_TASK = 16                      # splits of the stored corpus that one of them reads at most
TILE = 1024                             # questions and chunk vectors of one matrix product
DENSE_ROW = 32                          # more candidates of a question in a tile are ranked before they are kept
HELD_BYTES = 48 << 20                   # batches that a task holds for the candidates in them
OUT_ROWS = 8192                         # rows of one output batch
PUSHED_DOCUMENTS = 1_000                # named documents that are put into the scan's filter
SCOPED_FILTER_ROWS = 100_000            # named documents that are filtered by broadcast (a few MB)


class _Block:
    """One broadcast block of questions, as NumPy arrays: vectors as wide as they came, or as
    bytes if all are small counts."""

    def __init__(self, tbl: pa.Table, qkey: str, qvec: str):
        self.ids = tbl.column(qkey)
        vec = list_array(tbl.column(qvec))
        n, self.width = len(vec), widest(vec)
        parts = [slice(lo, lo + OUT_ROWS) for lo in range(0, n, OUT_ROWS)]
        self.norm, self.integral, self.counts = np.empty(n), np.empty(n, bool), True
        for part in parts:
            mat, sq = padded_matrix(vec.slice(part.start, OUT_ROWS), self.width)
            self.norm[part], self.integral[part] = np.sqrt(sq), (mat == np.rint(mat)).all(axis=1)
            self.counts = self.counts and whole.counts(mat)
        single = pa.types.is_float32(vec.type.value_type)
        self.matrix = np.empty((n, self.width), np.uint8 if self.counts else np.float32 if single else np.float64)
        for part in parts:
            self.matrix[part] = padded_matrix(vec.slice(part.start, OUT_ROWS), self.width)[0]
        self.k = tbl.column("_k").to_numpy()

    @functools.cached_property
    def unit(self) -> np.ndarray:
        """Unit vectors in single precision, made where they are used."""
        out = np.empty((len(self.norm), self.width), np.float32)
        for lo in range(0, len(out), OUT_ROWS):
            part = slice(lo, lo + OUT_ROWS)
            out[part] = _unit(self.matrix[part].astype(np.float64), self.norm[part])
        return out


def _unit(mat: np.ndarray, norm: np.ndarray) -> np.ndarray:
    usable = (norm > 0) & np.isfinite(norm)
    return np.divide(mat, norm[:, None], out=np.zeros_like(mat), where=usable[:, None]).astype(np.float32)


def _gather(tables, bt, row, name):
    """Column ``name`` of rows ``(batch, row)``, in the order given."""
    parts, order = [], []
    for b in range(len(tables)):
        sel = np.flatnonzero(bt == b)
        if len(sel):
            parts.append(tables[b].column(name).take(pa.array(row[sel])))
            order.append(sel)
    if not parts:
        return pa.array([], tables[0].schema.field(name).type)
    order = np.concatenate(order)
    inv = np.empty_like(order)
    inv[order] = np.arange(len(order))
    return pa.chunked_array(parts).combine_chunks().take(pa.array(inv))


def _select_winners(tables, cand, keys, k, repeated=False):
    """Best ``k[question]`` candidates per question across a task's batches.

    ``cand`` holds ``(question, batch, row, score)`` arrays; ``repeated`` says
    that a pair of a question and a chunk may be in it twice: its best
    occurrence is kept. Scores alone decide for most questions: key columns
    are gathered only for candidates whose score is that of their question's
    last place and more than fit in; payload columns are taken later for the
    winners alone.
    """
    q, bt, row, score = (np.concatenate(c) for c in zip(*cand))
    idx = np.lexsort((-score, q))
    if repeated:
        ident = (q.astype(np.int64) * len(tables) + bt) * (int(row.max()) + 1) + row
        _, best = np.unique(ident[idx], return_index=True)
        idx = idx[np.sort(best)]
    qs, s = q[idx], score[idx]
    first = np.r_[0, np.flatnonzero(qs[1:] != qs[:-1]) + 1]
    lens = np.diff(np.r_[first, len(qs)])
    rank = np.arange(len(qs)) - np.repeat(first, lens)
    places = k[qs[first]]
    over = np.flatnonzero(lens > places)
    last = first[over] + places[over] - 1
    tied = over[s[last] == s[last + 1]]
    if len(tied):
        bound = np.full(len(first), np.nan)
        bound[tied] = s[first[tied] + places[tied] - 1]
        at = np.flatnonzero(s == np.repeat(bound, lens))
        some = np.sort(idx[at])
        keyt = pa.table({c: _gather(tables, bt[some], row[some], c) for c in keys})
        order = pc.sort_indices(keyt, sort_keys=[(c, "ascending") for c in keys]).to_numpy()
        key_rank = np.empty(len(order), np.int64)
        key_rank[order] = np.arange(len(order))
        idx[at] = some[np.lexsort((key_rank, q[some]))]        # stretches of equal question and score, now by key
    pick = idx[rank < k[qs]]
    return q[pick], bt[pick], row[pick], score[pick]


def _compact(tables, winners):
    """Only the winners' rows stay in memory: one table, and the winners pointing into it."""
    q, bt, row, score = winners
    stride = int(row.max()) + 1
    cells, at = np.unique(bt * stride + row, return_inverse=True)
    kept = pa.table({c: _gather(tables, cells // stride, cells % stride, c) for c in tables[0].column_names})
    return [kept], [(q, np.zeros(len(q), np.int64), at.reshape(-1), score)]


def _products(blk: _Block, mat, norm, integral):
    """``(lo, near, measure)`` of one tile of vectors: products with the questions from ``lo`` on, which are cosines
    but for a factor of each question, and a function that turns cosines of these questions into that measure."""
    large = np.flatnonzero(~(integral & (np.abs(mat).max(axis=1, initial=0) <= whole.LARGEST)))
    if blk.counts and 4 * len(large) <= len(mat) and whole.available():
        small = mat.copy()
        small[large] = 0
        small = small.T.astype(np.int8, order="C")
        scale = np.divide(1, norm, out=np.zeros_like(norm), where=norm > 0).astype(np.float32)
        rest = _unit(mat[large], norm[large]).T
        for lo in range(0, len(blk.k), TILE):
            mine, size = blk.matrix[lo:lo + TILE], np.where(blk.norm[lo:lo + TILE] > 0, blk.norm[lo:lo + TILE], 1)
            near = whole.scaled_product(mine, small, scale)
            if len(large):
                near[:, large] = mine.astype(np.float32) @ rest
            yield lo, near, lambda c, by=size: c * by
        return
    unit = _unit(mat, norm).T
    product = np.empty((min(TILE, len(blk.k)), len(mat)), np.float32)      # one for all tiles
    for lo in range(0, len(blk.k), TILE):
        mine = blk.unit[lo:lo + TILE]
        yield lo, np.matmul(mine, unit, out=product[:len(mine)]), lambda c: c


def _tile_candidates(blk: _Block, mat, norm, floor):
    """Pairs ``(question, column, score)`` of one tile of vectors that are not below their question's ``floor``.

    A single-precision product of unit vectors differs from the cosine by less
    than ``slack``, so a pair below ``floor - slack`` there is none of the hits.
    Products of counts (:mod:`lectern.operators.whole`) are closer than that.
    """
    slack = (blk.width + 8) * 2.0 ** -23
    integral = (mat == np.rint(mat)).all(axis=1)
    for lo, near, measure in _products(blk, mat, norm, integral):
        least = measure(floor[lo:lo + TILE] - slack).astype(np.float32)
        rows = np.flatnonzero(near.max(axis=1) >= least)
        if not len(rows):
            continue
        near = near[rows] >= least[rows, None]
        many = near.sum(axis=1) > DENSE_ROW
        dense, few = lo + rows[many], np.flatnonzero(~many)
        found = []
        if len(dense):
            scores = cosines(Matrix(blk.matrix[dense].astype(np.float64), blk.norm[dense]), mat, norm)
            qi, ci = best_of_block(scores, blk.k[dense])
            found.append((dense[qi], ci, scores[qi, ci]))
        qi, ci = np.divmod(np.flatnonzero(near[few]), len(mat))
        qi = lo + rows[few[qi]]
        for at in range(0, len(qi), OUT_ROWS):
            q, c = qi[at:at + OUT_ROWS], ci[at:at + OUT_ROWS]
            found.append((q, c, pair_cosines(blk.matrix[q], blk.norm[q], blk.integral[q], mat[c], norm[c], integral[c])))
        for q, c, score in found:
            keep = score >= floor[q]
            yield q[keep], c[keep], score[keep]


def _prune(tables, cand, keys, k):
    """Winners among the candidates in one table, and the score each question's later hits must reach."""
    tables, cand = _compact(tables, _select_winners(tables, cand, keys, k))
    q, _, _, score = cand[0]
    n = np.bincount(q, minlength=len(k))
    floor = np.full(len(k), -np.inf)
    full = n >= k
    floor[full] = score[(np.cumsum(n) - 1)[full]]          # winners are in order: question, score
    return tables, cand, floor


def _score_partition(bc, keys, payload, cvec, out_schema: T.StructType):
    out_names = [f.name for f in out_schema.fields]

    def run(batches):
        blk: _Block = bc.value
        if not len(blk.k):
            return
        tables, cand, n, held, limit = [], [], 0, 0, TILE * 64
        floor = np.full(len(blk.k), -np.inf)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            tbl = pa.Table.from_batches([rb])
            # chunk-key order: among equal scores the lower position wins
            perm = pc.sort_indices(tbl, sort_keys=[(c, "ascending") for c in keys]).to_numpy().astype(np.int64)
            vec = list_array(tbl.column(cvec))
            tables.append(tbl.select([c for c in tbl.column_names if c in (*keys, *payload)]))
            b, met = len(tables) - 1, False
            for lo in range(0, len(perm), TILE):
                rows_here = perm[lo:lo + TILE]
                mat, sq = padded_matrix(vec.take(pa.array(rows_here)), blk.width)
                for q, c, score in _tile_candidates(blk, mat, np.sqrt(sq), floor):
                    if len(q):
                        cand.append((q, np.full(len(q), b), rows_here[c], score))
                        n, met = n + len(q), True
                if n > limit:
                    # this batch's rows stay in reach: their table comes back behind the winners'
                    tables, cand, floor = _prune(tables, cand, keys, blk.k)
                    n, held = len(cand[0][0]), 0
                    limit = max(TILE * 64, 2 * n)
                    tables.append(tbl.select(tables[0].column_names))
                    b, met = 1, False
            if not met:
                tables.pop()                              # none of its rows is a candidate
                continue
            held += rb.nbytes
            if held > HELD_BYTES:
                tables, cand, floor = _prune(tables, cand, keys, blk.k)
                n, held = len(cand[0][0]), 0
        if not cand:
            return
        tables, cand, _ = _prune(tables, cand, keys, blk.k)
        for lo in range(0, len(cand[0][0]), OUT_ROWS):
            q, bt, row, score = (a[lo:lo + OUT_ROWS] for a in cand[0])
            cols = {name: _gather(tables, bt, row, name) for name in dict.fromkeys((*keys, *payload))}
            out = pa.table({out_names[0]: blk.ids.take(pa.array(q)), **cols,
                            "score": pa.array(score, pa.float64()), "_k": pa.array(blk.k[q], pa.int32())})
            yield from out.select(out_names).combine_chunks().to_batches()
    return returning(run)


def exact_search(corpus: DataFrame, questions: DataFrame, *,
                 keys: tuple[str, ...] = ("doc_id", "chunk_id"),
                 payload: tuple[str, ...] = ("text",),
                 vector: str = "embedding",
                 query_key: str = "query_id",
                 query_vector: str = "embedding",
                 top_k: str | None = "top_k",
                 doc_filter: str | None = "doc_id",
                 corpus_doc: str = "doc_id",
                 default_k: int = DEFAULT_TOP_K,
                 max_block_bytes: int = MAX_BLOCK_BYTES,
                 max_block_hits: int = MAX_BLOCK_HITS) -> DataFrame:
    """Hits ``(query_id, rank, *keys, *payload, score)``, best first per question.

    ``top_k`` (per question, default ``default_k``) of 0 or less gives no hits.
    ``doc_filter`` names the question column restricting a question to one
    document (NULL = whole corpus). Scores are full-precision cosines.

    Payload columns travel with the winners, so repeated or NULL chunk keys
    give one hit per row. An empty question vector scores 0 with every chunk.
    """
    spark = corpus.sparkSession
    qcols = questions.columns
    has_filter = doc_filter is not None and doc_filter in qcols
    kcol = (F.coalesce(F.col(top_k).cast("int"), F.lit(default_k))
            if top_k and top_k in qcols else F.lit(default_k))
    q = questions.select(
        F.col(query_key), F.col(query_vector),
        kcol.alias("_k"),
        *([F.col(doc_filter).alias("_doc")] if has_filter else []),
    ).where(F.col("_k") > 0).where(F.col(query_vector).isNotNull())

    # the size check and the search read the questions twice: keep them
    # in memory between the two (a lost copy is only recomputed)
    q = q.persist()
    open_q = F.col("_doc").isNull() if has_filter else F.lit(True)
    stats = q.agg(F.count_if(open_q).alias("open"), F.count_if(~open_q).alias("scoped"),
                  F.sum(F.when(open_q, F.col("_k").cast("bigint"))).alias("hits"),
                  F.max(F.size(query_vector)).alias("d"), F.max("_k").alias("k")).first()
    width = max(1, stats["d"] or 1)

    extra = [corpus_doc] if has_filter and corpus_doc not in (*keys, *payload) else []
    c = corpus.select(*keys, *payload, *extra, vector).where(
        F.col(vector).isNotNull() & (F.size(vector) > 0))
    cfields = {f.name: f for f in c.schema.fields}

    def scored_schema(columns):
        return T.StructType(
            [T.StructField(query_key, q.schema[query_key].dataType)] + [cfields[n] for n in columns]
            + [T.StructField("score", T.DoubleType()), T.StructField("_k", T.IntegerType())])
    parts, corpus_rows = [], None
    if stats["scoped"]:
        parts.append(_scoped_scores(c, q.where(~open_q), keys, payload, vector, query_key, query_vector,
                                    corpus_doc, stats["scoped"], width))
    if stats["open"]:
        nblocks = max(1, math.ceil(stats["open"] * width * 8 / max_block_bytes), math.ceil(stats["hits"] / max_block_hits))
        if nblocks == 1:
            parts.append(_scan(c, [_broadcast(q.where(open_q), query_key, query_vector)], keys, payload, vector,
                               scored_schema((*keys, *payload))))
        else:
            corpus_rows = stored(c.select(*dict.fromkeys((*keys, *payload, vector))).withColumn(
                "_row", F.monotonically_increasing_id()), "search-corpus")
            cfields["_row"] = corpus_rows.schema["_row"]
            parts.append(_blockwise(corpus_rows, q.where(open_q), nblocks, keys, vector, query_key, query_vector,
                                    scored_schema((*keys, "_row"))))
    if not stats["scoped"]:
        q.unpersist()                       # the open questions are in the blocks now
    if not parts:
        empty = spark.createDataFrame([], scored_schema((*keys, *payload)))
        return empty.select(query_key, F.lit(0).alias("rank"), *keys, *payload, "score").limit(0)
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p, allowMissingColumns=True)
    hits = rank_hits(scored, query_key, keys, stats["k"] or 0).where(F.col("rank") <= F.col("_k"))
    if corpus_rows is not None:
        hits = _with_payload(hits, corpus_rows, [p for p in payload if p not in keys])
    return hits.select(query_key, "rank", *keys, *payload, "score")


def _broadcast(q, query_key, query_vector):
    return q.sparkSession.sparkContext.broadcast(_Block(q.toArrow(), query_key, query_vector))


def _scan(c, blocks, keys, payload, vector, out_schema):
    """Per-task winners over the whole corpus: one map-only scan per broadcast block of questions."""
    need = c.select(*dict.fromkeys((*keys, *payload, vector)))
    scans = [need.mapInArrow(_score_partition(bc, keys, payload, vector, out_schema), out_schema) for bc in blocks]
    one = scans[0]
    for more in scans[1:]:
        one = one.unionByName(more)
    return one


def _blockwise(c, q, nblocks, keys, vector, query_key, query_vector, out_schema):
    """Winners of all blocks, a few blocks at a time: the driver never holds more of the questions than those."""
    dealt = stored(q.withColumn("_blk", F.pmod(F.monotonically_increasing_id(), F.lit(nblocks)).cast("int")),
                   "search-questions", "_blk")
    cores, splits = q.sparkSession.sparkContext.defaultParallelism, c._jdf.queryExecution().toRdd().getNumPartitions()
    parts = []
    for lo in range(0, nblocks, BLOCKS_AT_ONCE):
        blocks = [_broadcast(dealt.where(F.col("_blk") == b), query_key, query_vector)
                  for b in range(lo, min(lo + BLOCKS_AT_ONCE, nblocks))]
        # each task starts without hits and gives its own: no more of them than keep all cores busy
        tasks = max(math.ceil(TASKS_A_CORE * cores / len(blocks)), math.ceil(splits / SPLITS_A_TASK))
        parts.append(stored(_scan(c.coalesce(tasks), blocks, keys, ("_row",), vector, out_schema), "search-winners"))
        for bc in blocks:
            bc.destroy()
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return scored


def _with_payload(hits, corpus_rows, payload):
    """Payload of the hits that came with a row number of the stored corpus."""
    if not payload:
        return hits
    taken = corpus_rows.select("_row", *[F.col(p).alias(f"_of_{p}") for p in payload])
    hits = hits.join(taken, "_row", "left")
    for p in payload:
        there = F.col(f"_of_{p}")
        hits = hits.withColumn(p, F.when(F.col("_row").isNotNull(), there).otherwise(F.col(p)) if p in hits.columns else there)
    return hits


def _scoped_scores(c, q, keys, payload, vector, query_key, query_vector, corpus_doc, n, width):
    """Questions that name a document meet only its chunks, by an equi-join on the document.

    Both sides are packed into blocks (:mod:`lectern.operators.blocks`), so the
    work is one product per (block of questions, block of chunks) of a
    document; a document that holds a third of all chunks, or is asked about
    by a third of all questions, is many blocks, never one group. The documents
    of up to :data:`PUSHED_DOCUMENTS` questions are also a filter that skips row
    groups of a stored index, those of up to :data:`SCOPED_FILTER_ROWS` a
    broadcast filter before packing; more are left to the join.
    """
    named = q.select(F.col("_doc").alias("_named")).distinct()
    if n <= PUSHED_DOCUMENTS:
        c = c.where(F.col(corpus_doc).isin([r[0] for r in named.collect()]))     # reaches the scan of a stored index
    elif n <= SCOPED_FILTER_ROWS:
        c = c.join(F.broadcast(named), F.col(corpus_doc) == F.col("_named"), "left_semi")
    key = "_scope"
    items = pack(c.withColumn(key, F.col(corpus_doc)), key, keys, list(dict.fromkeys((*keys, *payload))), vector)
    asked = pack(q.withColumnRenamed("_doc", key), key, [query_key], [query_key, "_k"], query_vector, prefix="q_")
    return score_blocks(items, asked, key, query_key, keys, payload, n * width * 8)


def rank_hits(scored: DataFrame, query_key: str, keys, k: int) -> DataFrame:
    """``row_number`` per question by score desc, key asc; keep ``rank <= k``."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), *[F.asc(c) for c in keys])
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k))


def topk_single(scored: DataFrame, k: int, keys=("doc_id", "chunk_id")) -> DataFrame:
    """Best ``k`` rows of one scored set (TakeOrderedAndProject, no full sort)."""
    if k <= 0:
        return scored.limit(0)
    return scored.orderBy(F.desc("score"), *[F.asc(c) for c in keys]).limit(k)
