"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are runs of letters and digits, ASCII lower-cased. A shingle is five
words and weighs as many as its bytes. For every item the 64-bit SimHash of
its weighted shingles is indexed in ``radius + 1`` bit blocks: two
fingerprints within ``radius`` agree in at least one block, so the index
returns all of them. Document windows have the size of an item; every window
whose weight consists to 80 % of benchmark shingles (any other has similarity
below 0.8 with every item) is fingerprinted and searched, and candidates are
decided by exact weighted Jaccard similarity of their shingles.

The benchmark is the query set: it streams to the driver in blocks of at most
``BLOCK_BYTES`` of text, each of which is one map-only pass over the
documents. Documents are never shuffled, so no key can be hot.

Defined results: NULL or empty text is clean; items with fewer than five
words have no shingle and match nothing; NULL items are skipped; items with
equal text all match (the smallest item_id is reported first); repeated rows
are judged row by row; empty tables give empty results; extra columns pass
through ``keep_clean`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops

K = 5
THRESHOLD = 0.8
RADIUS = 18          # of 64 bits: similarity 0.8 lies near 10 bits, this is three deviations more
BLOCK_BYTES = 8 << 20
_BITS = np.arange(64, dtype=np.uint64)


def shingled(raw: np.ndarray, offs: np.ndarray):
    """(shingle hashes, weights, per-row offsets) of texts with at least five words."""
    w = textops.words_of(raw, offs, textops.PUNCTUATION)
    h = textops.word_hashes(w)
    size = np.concatenate([[0], np.cumsum(w.end - w.start)])
    per = np.maximum(w.counts() - K + 1, 0)
    first = np.concatenate([[0], np.cumsum(per)])
    if not first[-1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), first
    sh, _, at = textops.shingles_of(h, w.first, K)
    full = np.repeat(w.counts() >= K, np.where(w.counts() >= K, per, (w.counts() > 0).astype(np.int64)))
    sh, at = sh[full], at[full]
    return sh, size[at + K] - size[at], first


def fingerprints(sh: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the windows ``[begin, end)`` of a row of weighted shingle hashes.

    Each bit's signed weights are summed once along the row, a window is the
    difference of two sums: memory is linear in the row, whatever the windows.
    """
    out = np.zeros(len(begin), np.uint64)
    weight = weight.astype(np.int64)
    run = np.zeros(len(sh) + 1, np.int64)
    for bit in _BITS:
        np.cumsum(np.where((sh >> bit) & np.uint64(1), weight, -weight), out=run[1:])
        out |= (run[end] > run[begin]).astype(np.uint64) << bit
    return out


class ItemIndex:
    """Multi-index over the fingerprints of one block of items."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, threshold: float = THRESHOLD):
        raw, offs = textops.text_bytes(pa.array([t for _, t in items], pa.large_string()))
        sh, wt, first = shingled(raw, offs)
        keep = [i for i in range(len(items)) if first[i + 1] > first[i]]
        self.ids = [items[i][0] for i in keep]
        self.radius, self.threshold = radius, threshold
        self.sizes = np.array([first[i + 1] - first[i] for i in keep], dtype=np.int64)
        self.bags, self.total = [], []
        for i in keep:
            own, w = sh[first[i]:first[i + 1]], wt[first[i]:first[i + 1]]
            u, at, n = np.unique(own, return_index=True, return_counts=True)
            self.bags.append((u, n, w[at]))
            self.total.append(float(w.sum()))
        bounds = np.asarray(keep, dtype=np.int64)
        self.prints = fingerprints(sh, wt, first[bounds], first[bounds + 1])
        owner = np.repeat(np.arange(len(keep)), [len(b[0]) for b in self.bags]) if keep else np.empty(0, np.int64)
        every = np.concatenate([b[0] for b in self.bags]) if keep else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.shingle, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.shingle & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            value = (self.prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            by = np.argsort(value, kind="stable")
            self.blocks.append((np.uint64(lo), np.uint64((1 << (hi - lo)) - 1), value[by], by))

    def anchors(self, sh: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.maybe[(sh & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.shingle, sh[at]), len(self.shingle) - 1)
        return at[self.shingle[k] == sh[at]]

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs at Hamming distance ``radius`` or less."""
        found = []
        for shift, mask, value, by in self.blocks:
            v = (prints >> shift) & mask
            lo, hi = np.searchsorted(value, v, "left"), np.searchsorted(value, v, "right")
            n = hi - lo
            win = np.repeat(np.arange(len(prints)), n)
            item = by[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[win] ^ self.prints[item]) <= self.radius
            found.append(win[near] * len(self.prints) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def similarity(self, item: int, sh: np.ndarray, wt: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a window (shingle multisets)."""
        u, n, w = self.bags[item]
        k = np.minimum(np.searchsorted(u, sh), len(u) - 1)
        hit = u[k] == sh
        both = float((np.minimum(np.bincount(k[hit], minlength=len(u)), n) * w).sum())
        return both / (self.total[item] + float(wt.sum()) - both)

    def search(self, sh: np.ndarray, wt: np.ndarray) -> dict[int, tuple[float, int]]:
        """Items that some window of one document holds: item -> (similarity, first shingle)."""
        at = self.anchors(sh)
        best: dict[int, tuple[float, int]] = {}
        if not len(at):
            return best
        lo, hi = np.searchsorted(self.shingle, sh[at], "left"), np.searchsorted(self.shingle, sh[at], "right")
        own = np.concatenate([self.owner[a:b] for a, b in zip(lo, hi)])
        marked = np.zeros(len(sh))
        marked[at] = wt[at]
        in_items, weight = np.concatenate([[0], np.cumsum(marked)]), np.concatenate([[0], np.cumsum(wt)])
        for size in np.unique(self.sizes[np.unique(own)]):
            begin = np.arange(max(1, len(sh) - size + 1))
            end = np.minimum(begin + size, len(sh))
            begin = begin[in_items[end] - in_items[begin] >= self.threshold * (weight[end] - weight[begin]) - 1e-9]
            if not len(begin):
                continue
            win, item = self.within_radius(fingerprints(sh, wt, begin, np.minimum(begin + size, len(sh))))
            for k, i in zip(win.tolist(), item.tolist()):
                a, b = int(begin[k]), min(int(begin[k]) + int(size), len(sh))
                s = self.similarity(i, sh[a:b], wt[a:b])
                if s >= self.threshold and s > best.get(i, (0.0, 0))[0]:
                    best[i] = (s, a)
        return best

    def search_rows(self, column: pa.Array) -> list[dict[int, tuple[float, int]]]:
        sh, wt, first = shingled(*textops.text_bytes(column))
        out: list[dict] = [{} for _ in range(len(column))]
        if len(self.ids) and len(sh):
            rows = np.unique(np.searchsorted(first, self.anchors(sh), side="right") - 1)
            for r in rows.tolist():
                out[r] = self.search(sh[first[r]:first[r + 1]], wt[first[r]:first[r + 1]])
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                radius: int = RADIUS, threshold: float = THRESHOLD) -> Iterator[ItemIndex]:
    """Indexes over blocks of the benchmark, each of at most ``BLOCK_BYTES`` of text (or one item)."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`"))
    for item_id, text in rows.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield ItemIndex(sorted(block), radius, threshold)
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield ItemIndex(sorted(block), radius, threshold)


def annotate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **limits) -> DataFrame:
    """Per document: ``doc_id, n_items, best_item, best_similarity, best_word, contaminated``."""
    found = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
        F.lit(0).cast("bigint").alias("n_items"), F.lit(None).cast("bigint").alias("best_item"),
        F.lit(0.0).alias("best_similarity"), F.lit(None).cast("bigint").alias("best_word"))
    schema = found.schema
    for index in item_blocks(benchmark, **limits):
        def mark(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textops.pieces(batch, 1):
                    n, item, sim, word = (part.column(k).to_pylist() for k in range(2, 6))
                    for r, hits in enumerate(index.search_rows(part.column(1))):
                        if not hits:
                            continue
                        n[r] += len(hits)
                        i, (s, at) = max(hits.items(), key=lambda x: (round(x[1][0], 6), -index.ids[x[0]]))
                        if item[r] is None or (s, -index.ids[i]) > (sim[r], -item[r]):
                            item[r], sim[r], word[r] = index.ids[i], round(s, 6), at
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(item, pa.int64()),
                         pa.array(sim, pa.float64()), pa.array(word, pa.int64())], names=schema.names)
        found = found.mapInArrow(mark, schema)
    return found.drop("text").withColumn("contaminated", F.col("n_items") > 0)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    at, schema = docs.columns.index(text_col), docs.schema
    for index in item_blocks(benchmark, **limits):
        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textops.pieces(batch, at):
                    yield part.filter(pa.array([not hits for hits in index.search_rows(part.column(at))], pa.bool_()))
        docs = docs.mapInArrow(clean, schema)
    return docs
