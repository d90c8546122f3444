"""Vectorised text helpers for Arrow batches: bytes, words, word hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_SPAN = 64                                   # byte positions with a table of their own
_TABLE = _rng.integers(0, 1 << 63, size=(_SPAN, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[:, 65:91] = _TABLE[:, 97:123]        # A-Z hash as a-z
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their n+1 offsets; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batch: pa.RecordBatch, text_index: int, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``max_bytes`` of text (a longer single text is one slice)."""
    _, offs = text_bytes(batch.column(text_index))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


@dataclass
class Words:
    """Words of a batch of texts, in order: byte spans and the row of each."""
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray        # n+1 offsets of each row's words
    gap: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


#: Word gaps of ``words_of``: white space, or every ASCII byte that is no letter or digit.
SPACE = _SPACE
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words_of(raw: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> Words:
    solid = ~gap[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offs)
    return Words(raw, start, end, np.repeat(np.arange(len(offs) - 1), np.diff(first)), first, gap)


def word_hashes(w: Words, fold: bool = True) -> np.ndarray:
    """64-bit tabulation hash of every word (A-Z as a-z if ``fold``)."""
    if not len(w.start):
        return np.empty(0, np.uint64)
    n = len(w.raw)
    delta = np.zeros(n, dtype=np.int64)
    # position within the word: running index minus the start of the word it is in
    delta[w.start] = w.start
    pos = np.arange(n, dtype=np.int64) - np.maximum.accumulate(delta)
    table = (_FOLDED if fold else _TABLE).ravel()
    val = table[((pos & (_SPAN - 1)) << 8) + w.raw]
    if (w.end - w.start).max() > _SPAN:
        val = val * (2 * (pos // _SPAN) + 1).astype(np.uint64)
    val[w.gap[w.raw]] = 0
    return mix(np.add.reduceat(val, w.start))


def shingles_of(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every ``k``-word shingle: (hash, row, word index). Rows with 1..k-1 words give one."""
    n = len(hashes)
    rows = len(first) - 1
    count = np.diff(first)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    roll = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        roll = mix(roll * _MIX1 + hashes[j:n - k + 1 + j] + np.uint64(j + 1)) if n >= k else roll
    per = np.maximum(count - k + 1, 0)
    at = np.repeat(first[:-1] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    row = np.repeat(np.arange(rows), per)
    out = roll[at] if len(at) else np.empty(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            h[has] = mix(h[has] * _MIX1 + hashes[first[short[has]] + j] + np.uint64(j + 1))
        h = mix(h + np.uint64(0x51ED))         # never equal to a full shingle by construction
        out, row, at = np.concatenate([out, h]), np.concatenate([row, short]), np.concatenate([at, first[short]])
        order = np.argsort(row, kind="stable")
        out, row, at = out[order], row[order], at[order]
    return out, row, at
