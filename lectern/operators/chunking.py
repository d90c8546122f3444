"""Sentence-aware overlapping chunking (T1 + T2 + T3).

The chunk walk is sequential inside one document (each window depends on where
the previous one ended), so documents are the unit of parallelism: the walk
runs in ``mapInPandas`` over Arrow batches, map-only, with no shuffle. Every
other input column is carried onto the chunk rows, so catalog fields such as
``total_chunks`` come out of the same pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.operators.worker import returning

# Default window and overlap in characters.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
PART_BYTES = 4 << 20          # text of a batch that is walked at once

CHUNK_FIELDS = [
    T.StructField("chunk_id", T.IntegerType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("start_char", T.IntegerType(), False),
    T.StructField("end_char", T.IntegerType(), False),
    T.StructField("total_chunks", T.IntegerType(), False),
]


def check_window(size: int, overlap: int) -> None:
    """Reject settings under which the walk would not advance."""
    if size <= 0 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap non-negative")
    # Smallest step is (size // 2 + 2) - overlap when a period cuts the window.
    if overlap >= min(size, size // 2 + 2):
        raise ValueError(f"overlap {overlap} too large for chunk size {size}")


def clean_text(text: str | None) -> str:
    """Whitespace runs to one space, ends stripped (Python's whitespace class)."""
    return " ".join(text.split()) if text else ""


def chunk_spans(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Chunks of one document as ``(text, start_char, end_char)`` tuples.

    Offsets refer to the cleaned text. A window that does not reach the end
    is cut after its last period when that period lies past the middle of
    the window; the next window starts ``overlap`` characters before the cut.
    ``end_char`` is not clamped to the text length.
    """
    t = clean_text(text)
    n = len(t)
    out = []
    start = 0
    half = size // 2
    while start < n:
        width = size
        if start + size < n:
            dot = t.rfind(".", start, start + size)
            if dot - start > half:
                width = dot - start + 1
        out.append((t[start:start + width].strip(), start, start + width))
        start += width - overlap
    return out


def _parts(rb: pa.RecordBatch, text_col: str):
    """Slices of a batch with about ``PART_BYTES`` of text each: only one is held as Python strings."""
    sizes = pc.fill_null(pc.binary_length(rb.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // PART_BYTES
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, rb.num_rows]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield rb.slice(lo, hi - lo)


def _chunk_batches(carried: list[str], text_col: str, size: int, overlap: int):
    """Arrow in, Arrow out: carried columns are taken by row, so any type (NULLs included) stays exact."""
    def run(batches):
        for rb in (part for whole in batches for part in _parts(whole, text_col)):
            spans = [chunk_spans(t, size, overlap) for t in rb.column(text_col).to_pylist()]
            counts = np.fromiter((len(s) for s in spans), dtype=np.int64, count=len(spans))
            row = pa.array(np.repeat(np.arange(len(spans)), counts))
            flat = [c for s in spans for c in s]
            ordinal = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [rb.column(c).take(row) for c in carried]
                + [pa.array(ordinal, pa.int32()), pa.array([c[0] for c in flat], pa.string()),
                   pa.array([c[1] for c in flat], pa.int32()), pa.array([c[2] for c in flat], pa.int32()),
                   pa.array(np.repeat(counts, counts), pa.int32())],
                names=[*carried, "chunk_id", "text", "start_char", "end_char", "total_chunks"])
    return returning(run)


def chunk_documents(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: carried columns + ``chunk_id, text, start_char, end_char, total_chunks``.

    ``chunk_id`` is the 0-based ordinal inside the document; a document whose
    cleaned text is empty yields no rows.
    """
    check_window(size, overlap)
    carried = [f for f in docs.schema.fields if f.name not in (text_col, *[c.name for c in CHUNK_FIELDS])]
    out_schema = T.StructType(carried + CHUNK_FIELDS)
    src = docs.select(*[f.name for f in carried], text_col)
    return src.mapInArrow(_chunk_batches([f.name for f in carried], text_col, size, overlap), out_schema)
