"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the vocabulary's pattern; each match is one token if its
bytes are in the rank file, else its bytes are merged pair by pair, the lowest
rank first and the leftmost among equals.

:class:`RankQueue` holds, per merge rank, the positions of the linked list at
which that pair stood when it was seen. A bitmap over leaves of 256 ranks and
one over each leaf give the lowest non-empty bucket by find-first-set twice;
entries whose pair has changed since are stale and skipped when met. Each
merge costs a bounded number of steps, so a match of a megabyte (a long run
of letters or spaces) takes time in proportion to its length.

Encoded matches are kept per Python worker in a table of bounded size, which
is only a saving of time. Map-only: nothing is shuffled.

Defined results: NULL and empty texts have no ids and decode to no bytes;
texts that are not valid UTF-8 are read with replacement characters; rows are
kept one by one (repeated rows, NULL doc_ids); empty tables stay empty;
columns other than ``doc_id`` and ``text`` (``ids``) are not read; an id
outside the rank file is an error.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of
from lectern.llm.textops import pieces

KEPT_MATCHES = 800_000       # matches whose ids a worker remembers (about 200 MB)
KEPT_LENGTH = 64             # only matches of at most so many characters are remembered
WHOLE = 1 << 20              # texts up to this length are split at once, longer ones match by match


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by merge rank; the lowest rank first. Empty again after every use."""

    LEAF = 8                                         # a leaf has a bit for each of 2**LEAF ranks

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaves = [0] * ((ranks >> self.LEAF) + 1)
        self.root = 0                                # a bit for each leaf that is not empty

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        leaf = rank >> 8
        bits = self.leaves[leaf]
        if not bits:
            self.root |= 1 << leaf
        self.leaves[leaf] = bits | 1 << (rank & 255)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank by find-first-set, and its positions, leftmost first; -1 when empty."""
        root = self.root
        if not root:
            return -1, []
        leaf = (root & -root).bit_length() - 1
        bits = self.leaves[leaf]
        rest = bits & (bits - 1)
        self.leaves[leaf] = rest
        if not rest:
            self.root = root & (root - 1)
        rank = leaf << 8 | (bits ^ rest).bit_length() - 1
        positions = self.buckets.pop(rank)
        if len(positions) > 1:
            positions.sort()
        return rank, positions


class Encoder:
    """Merges of single matches, and whole texts through them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of the bytes of one match."""
        get, pop, push, n = self.ranks.get, self.queue.pop, self.queue.push, len(word)
        whole = get(word)
        if whole is not None:
            return [whole]
        after = list(range(1, n + 2))                # linked list: the part at i ends where the next begins
        before = list(range(-1, n))
        pair = [-1] * (n + 1)                        # rank of the pair that now begins at i; -1: none
        for i in range(n - 1):
            rank = get(word[i:i + 2])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        while True:
            rank, positions = pop()
            if rank < 0:
                break
            for k, i in enumerate(positions):
                if pair[i] != rank:
                    continue                         # stale: this pair has gone or changed
                middle = after[i]
                end = after[middle]
                after[i] = end
                before[end] = i
                pair[middle] = pair[i] = -1
                lower = False
                if end < n:
                    new = get(word[i:after[end]])
                    if new is not None:
                        pair[i] = new
                        push(new, i)
                        lower = new < rank
                left = before[i]
                if left >= 0:
                    new = get(word[left:end])
                    if new is None:
                        pair[left] = -1
                    else:
                        pair[left] = new
                        push(new, left)
                        lower = lower or new < rank
                if lower:                            # a lower rank has come up: the rest waits
                    for p in positions[k + 1:]:
                        push(rank, p)
                    break
        ids, i = [], 0
        while i < n:
            ids.append(get(word[i:after[i]]))
            i = after[i]
        return ids

    def _match(self, match: str) -> bytes:
        ids = array("I", self.merge(match.encode())).tobytes()
        if len(match) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_MATCHES:
                self.kept.clear()
            self.kept[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers."""
        kept, new = self.kept.get, self._match
        found = self.pattern.findall(text) if len(text) <= WHOLE else (m[0] for m in self.pattern.finditer(text))
        return b"".join([kept(m) or new(m) for m in found])


_ENCODERS: dict[tuple[str, str], Encoder] = {}       # one per Python worker: built once, not per batch


def _encoder(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of every whole text."""
    def run(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in pieces(batch, 1):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                ids = [encoder.encode(t.decode(errors="replace")) if t else b"" for t in texts]
                offsets = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
                values = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["doc_id", "ids"])

    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that the ids stand for. A NULL list decodes to no bytes."""
    def run(batches):
        ranks = load_ranks(ranks_path)
        tokens: list = [None] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum([len(x) if x.is_valid else 0 for x in lists])
            values = lists.flatten().to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or values.max() >= len(tokens)):
                raise ValueError("an id is outside the rank file")
            parts = [b"".join(map(tokens.__getitem__, ids.tolist())) for ids in np.split(values, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(parts[:len(lists)], pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return columns_of(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Length and digests of ids and decoded bytes of each document."""
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
