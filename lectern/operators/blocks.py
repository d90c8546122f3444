"""Packed vector blocks and their scoring by an equi-join.

Rows that share a key (a document, an index cell) are packed into blocks: one
row holds up to ``BLOCK_ROWS`` vectors as one matrix, with the carried columns
as an array of structs. Questions are packed the same way, so a join on the
key meets *blocks*, not rows: each joined row is one matrix product, and no
(question, vector) pair ever becomes a row. Spark picks the join by size; a
hot key has many blocks on both sides, which AQE can split, and none of its
groups is ever collected.

Packing is map-only and vectorised: a batch is sorted by key, and the blocks'
matrices are slices of its one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 1024            # vectors in one block
PACK_ROWS = 2048             # rows of a batch that are packed at once
KEPT_ROWS = 1 << 16          # winners a task holds before it drops those beaten meanwhile
KEPT_BYTES = 32 << 20        # the same in bytes; what is still more than half of either goes out
OUT_ROWS = 8192              # rows of one output batch
BROADCAST_BYTES = 64 << 20   # packed questions that may be broadcast; more are joined by a shuffle


def padded_matrix(vec: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``vec`` as a zero-padded/truncated ``(n, width)`` float64 matrix,
    plus each row's squared norm over its *full* length."""
    vec = vec.cast(pa.list_(pa.float64()))
    offsets = vec.offsets.to_numpy()
    values = vec.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    values = np.nan_to_num(values, nan=0.0)
    offsets = offsets - offsets[0]
    lens = np.diff(offsets)
    n = len(lens)
    sq = np.zeros(n)
    full = np.flatnonzero(lens > 0)                      # empty vectors keep norm 0
    if len(full):
        sq[full] = np.add.reduceat(values * values, offsets[full])
    if n and (lens == width).all():
        return values.reshape(n, width), sq
    mat = np.zeros((n, width))
    take = np.minimum(lens, width)
    rows = np.repeat(np.arange(n), take)
    cols = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    mat[rows, cols] = values[np.repeat(offsets[:-1], take) + cols]
    return mat, sq


def widest(vec: pa.ListArray) -> int:
    lens = np.diff(vec.offsets.to_numpy())
    return max(1, int(lens.max()) if len(lens) else 1)


def list_array(column) -> pa.ListArray:
    """One list array without gaps for NULL rows (they are empty lists)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, []) if column.null_count else column


def topk_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row (question), the ``k`` best columns (chunks); equal scores go to
    the lower column index, which is the lower chunk key.

    Returns ``(question, column)`` index arrays. ``-inf`` marks excluded cells.
    """
    b = scores.shape[1]
    kk = min(k, b)
    kth = np.partition(scores, b - kk, axis=1)[:, b - kk]
    mask = scores >= kth[:, None]
    if np.isneginf(kth).any():
        mask &= scores > -np.inf
    qi, ci = np.nonzero(mask)
    if len(qi) == 0:
        return qi, ci
    s = scores[qi, ci]
    tie = s == kth[qi]
    # among ties keep only as many as each question still needs, lowest columns first
    above = np.bincount(qi, weights=~tie, minlength=len(kth)).astype(np.int64)
    start = np.r_[0, np.flatnonzero(qi[1:] != qi[:-1]) + 1]
    tie_cum = np.cumsum(tie)
    base = np.repeat(tie_cum[start] - tie[start], np.diff(np.r_[start, len(qi)]))
    keep = ~tie | (tie_cum - base <= kk - above[qi])
    return qi[keep], ci[keep]


def exact_in_single(mat: np.ndarray, bound_other: float) -> bool:
    """Integer-valued blocks whose dot products stay below 2**24 are exact in float32."""
    if not len(mat):
        return True
    l1 = np.abs(mat).sum(axis=1).max()
    return l1 * bound_other < 2 ** 24 and np.array_equal(mat, np.rint(mat))


class Matrix:
    """Question vectors with what scoring needs to know of them."""

    def __init__(self, mat: np.ndarray, norm: np.ndarray):
        self.mat, self.norm = mat, norm
        self.max_abs = float(np.abs(mat).max()) if mat.size else 0.0
        self.integral = (mat == np.rint(mat)).all(axis=1)   # per question
        self.single = exact_in_single(mat, 1.0) and self.max_abs < 2 ** 24
        self.mat32 = mat.astype(np.float32) if self.single else None


# Integer-valued vectors (the hash embedder) give exact dot products, so their
# scores are the exact IEEE results of dot / (|q| |c|). Other vectors are
# ranked at 12 decimals: a BLAS product may give two copies of one vector dot
# products a last bit apart (the result depends on block shape); at this
# precision copies tie and fall back to the key order.
SCORE_DECIMALS = 12


def cosines(q: Matrix, mat: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """``(questions, vectors)`` cosine scores of one block; 0 where a norm is 0."""
    whole = (mat == np.rint(mat)).all(axis=1)
    if q.single and whole.all() and exact_in_single(mat, q.max_abs):
        dots = (q.mat32 @ mat.astype(np.float32).T).astype(np.float64)
    else:
        dots = q.mat @ mat.T
    denom = np.multiply.outer(q.norm, norm)
    # a zero norm means a zero vector, whose dot products are already 0
    scores = np.divide(dots, denom, out=dots, where=denom > 0)
    # one rule per pair, whatever else is in the batch: two whole-number
    # vectors score exactly, all other pairs at SCORE_DECIMALS
    if not (whole.all() and q.integral.all()):
        exact = np.logical_and.outer(q.integral, whole)
        scores = np.where(exact, scores, np.round(scores, SCORE_DECIMALS))
    return scores


def pair_cosines(qmat: np.ndarray, qnorm: np.ndarray, qwhole: np.ndarray, mat: np.ndarray, norm: np.ndarray,
                 whole: np.ndarray) -> np.ndarray:
    """Cosine of each question row with the vector row beside it, by the rule of :func:`cosines`."""
    dots = np.einsum("ij,ij->i", qmat.astype(np.float64, copy=False), mat)
    denom = qnorm * norm
    scores = np.divide(dots, denom, out=dots, where=denom > 0)
    return np.where(qwhole & whole, scores, np.round(scores, SCORE_DECIMALS))


def best_of_block(scores: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winners of a block: each question keeps its own number ``k`` (0 or less: none)."""
    rows, cols = [], []
    for n in np.unique(k[k > 0]):
        of_n = np.flatnonzero(k == n)
        qs, cs = topk_rows(scores if len(of_n) == len(k) else scores[of_n], int(n))
        rows.append(of_n[qs])
        cols.append(cs)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, np.int64),) * 2


def packed_schema(by: T.StructField, carried: Sequence[T.StructField], prefix: str = "") -> T.StructType:
    p = prefix
    return T.StructType([by, T.StructField(p + "n", T.IntegerType()), T.StructField(p + "width", T.IntegerType()),
                         T.StructField(p + "vectors", T.BinaryType()), T.StructField(p + "norms", T.BinaryType()),
                         T.StructField(p + "rows", T.ArrayType(T.StructType(list(carried))))])


def pack_runs(by: pa.Array, mat: np.ndarray, norm: np.ndarray, carried: dict[str, pa.Array],
              names: list[str], rows: int = BLOCK_ROWS) -> pa.RecordBatch:
    """Rows sorted by ``by`` as blocks of equal key and at most ``rows`` rows (columns of ``packed_schema``)."""
    n, width = mat.shape
    code = pc.dictionary_encode(by).indices.to_numpy(zero_copy_only=False) if n else np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if n else np.empty(0, np.int64)
    lens = np.diff(np.r_[starts, n])
    parts = -(-lens // rows)
    first = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * rows
    edges = np.r_[first, n]
    mat = np.ascontiguousarray(mat)

    def slices(a: np.ndarray, row_bytes: int) -> pa.Array:
        # each block is a stretch of one buffer
        return pa.Array.from_buffers(pa.large_binary(), len(first), [
            None, pa.py_buffer((edges * row_bytes).astype(np.int64)), pa.py_buffer(a.tobytes())]).cast(pa.binary())

    struct = pa.StructArray.from_arrays(list(carried.values()), list(carried))
    return pa.RecordBatch.from_arrays(
        [by.take(pa.array(first)), pa.array(np.diff(edges), pa.int32()),
         pa.array(np.full(len(first), width), pa.int32()), slices(mat, width * mat.itemsize), slices(norm, 8),
         pa.ListArray.from_arrays(pa.array(edges, pa.int32()), struct)], names=names)


def pack(df: DataFrame, by: str, order: Sequence[str], carried: Sequence[str], vector: str,
         prefix: str = "", rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``df``: rows in ``order`` inside a block; rows without a key or a vector are left out."""
    fields = {f.name: f for f in df.schema.fields}
    schema = packed_schema(fields[by], [fields[c] for c in carried], prefix)
    names = [f.name for f in schema.fields]
    single = fields[vector].dataType.elementType == T.FloatType()       # kept as wide as it came

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            tbl = pa.Table.from_batches([rb])
            perm = pc.sort_indices(tbl, sort_keys=[(c, "ascending") for c in (by, *order)])
            for lo in range(0, len(perm), max(rows, PACK_ROWS // rows * rows)):
                part = tbl.take(perm.slice(lo, max(rows, PACK_ROWS // rows * rows))).combine_chunks()
                one = {c: part.column(c).chunk(0) for c in part.column_names}
                vec = list_array(one[vector])
                mat, sq = padded_matrix(vec, widest(vec))
                yield pack_runs(one[by], mat.astype(np.float32) if single else mat, np.sqrt(sq),
                                {c: one[c] for c in carried}, names, rows)

    need = list(dict.fromkeys((by, *order, *carried, vector)))
    some = df.select(*need).where(F.col(by).isNotNull() & F.col(vector).isNotNull())
    return some.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, r: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    n, width = batch.column(prefix + "n")[r].as_py(), batch.column(prefix + "width")[r].as_py()
    raw = batch.column(prefix + "vectors")[r].as_buffer()
    mat = np.frombuffer(raw, np.float32 if raw.size == 4 * n * width else np.float64).reshape(n, width)
    return mat.astype(np.float64, copy=False), np.frombuffer(batch.column(prefix + "norms")[r].as_buffer(), np.float64)


def _beaten(tbl: pa.Table, query_key: str, keys: Sequence[str]) -> pa.Table:
    """Only the best ``_k`` rows of every question."""
    tbl = tbl.take(pc.sort_indices(tbl, sort_keys=[(query_key, "ascending"), ("score", "descending"),
                                                   *[(c, "ascending") for c in keys]]))
    code = pc.fill_null(pc.dictionary_encode(tbl.column(query_key).combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    return tbl.filter(pa.array(rank < tbl.column("_k").to_numpy()))


def _same(questions: pa.Array, items: pa.Array) -> np.ndarray:
    """``(questions, items)``: whether an item has the question's value; a question without one takes all."""
    values = questions.unique()
    q = pc.index_in(questions, value_set=values).to_numpy(zero_copy_only=False)
    i = pc.fill_null(pc.index_in(items, value_set=values), -1).to_numpy(zero_copy_only=False)
    return (q[:, None] == i[None, :]) | pc.is_null(questions).to_numpy(zero_copy_only=False)[:, None]


def score_blocks(items: DataFrame, questions: DataFrame, on: str, query_key: str,
                 keys: Sequence[str], payload: Sequence[str], question_bytes: int,
                 same: tuple[str, str] | None = None) -> DataFrame:
    """Items and questions that share a key, scored: ``(query_key, *keys, *payload, score, _k)``.

    ``question_bytes`` is the counted size of the packed questions: Spark
    cannot estimate it, so over :data:`BROADCAST_BYTES` a shuffle is asked for.
    ``items`` carry the keys and payload, ``questions`` (prefix ``q_``) carry
    ``query_key`` and ``_k``. ``same`` names a carried column of the items and
    one of the questions that must agree for a hit (a NULL question takes all).
    Each task keeps the best ``_k`` rows per question; it holds at most
    :data:`KEPT_ROWS` winners or :data:`KEPT_BYTES`, besides those of one
    block: what a clean-up leaves beyond half of that goes out, to be ranked
    with the rest. The questions lead the join, so a block of them has met all
    its items (of a shuffled join) before the next one comes.
    """
    carried = items.schema["rows"].dataType.elementType
    asked = questions.schema["q_rows"].dataType.elementType
    names = [query_key, *keys, *payload]
    schema = T.StructType([T.StructField(query_key, asked[query_key].dataType)]
                          + [T.StructField(c, carried[c].dataType) for c in (*keys, *payload)]
                          + [T.StructField("score", T.DoubleType()), T.StructField("_k", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            item_rows, question_rows = batch.column("rows"), batch.column("q_rows")
            item_at, question_at = item_rows.offsets.to_numpy(), question_rows.offsets.to_numpy()
            item_rows, question_rows = item_rows.values, question_rows.values
            ks = question_rows.field("_k").to_numpy()
            for r in range(batch.num_rows):
                mat, norm = _matrix(batch, r, "")
                qmat, qnorm = _matrix(batch, r, "q_")
                w = min(mat.shape[1], qmat.shape[1])       # common prefix; norms are over full vectors
                q0, i0 = int(question_at[r]), int(item_at[r])
                scores = cosines(Matrix(qmat[:, :w], qnorm), mat[:, :w], norm)
                if same:
                    scores[~_same(question_rows.field(same[1]).slice(q0, len(qmat)),
                                  item_rows.field(same[0]).slice(i0, len(mat)))] = -np.inf
                qi, ci = best_of_block(scores, ks[q0:q0 + len(qmat)])
                if not len(qi):
                    continue
                at, by = pa.array(i0 + ci), pa.array(q0 + qi)
                held.append(pa.table([question_rows.field(query_key).take(by)]
                                     + [item_rows.field(c).take(at) for c in (*keys, *payload)]
                                     + [pa.array(scores[qi, ci]), pa.array(ks[q0 + qi], pa.int32())],
                                     names=[*names, "score", "_k"]))
                n, size = n + len(qi), size + held[-1].nbytes
                if n > KEPT_ROWS or size > KEPT_BYTES:
                    held = [_beaten(pa.concat_tables(held), query_key, keys)]
                    n, size = held[0].num_rows, held[0].nbytes
                    if n > KEPT_ROWS // 2 or size > KEPT_BYTES // 2:
                        yield from held[0].to_batches(max_chunksize=OUT_ROWS)
                        held, n, size = [], 0, 0
        if held:
            yield from _beaten(pa.concat_tables(held), query_key, keys).to_batches(max_chunksize=OUT_ROWS)

    if question_bytes > BROADCAST_BYTES:
        questions = questions.hint("merge")
    return questions.join(items, on).drop(on).mapInArrow(run, schema)
