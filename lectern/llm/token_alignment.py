"""Alignment of two tokenizers' tokens over the bytes of each text.

A is a byte-level BPE (tokenizers library), B a sentencepiece model. Both see
the same bytes: a space and the text (A is given the space, B adds its own).

* Coarse cuts: the character offsets that the tokenizers library reports for
  A, and the spans of B's surfaces in the text. They are exact wherever a
  token covers whole characters.
* Refinement: where several tokens share one character (A splits its bytes,
  B falls back to single bytes) the spans do not say where the bytes are cut.
  There, the decoded byte length of each token is counted on from the last
  exact cut (:func:`byte_ends`).
* Byte offsets where tokens of both sides end cut the tokens into groups. Two
  tokens are linked when their byte ranges overlap: every stretch between
  neighbouring cuts (of either side) is one link, so links come out of the
  merged cuts in linear time, never as pairs of a group.
* A space between two other characters always begins a token on both sides
  (A's pattern starts a match there, none of B's pieces has a space inside),
  so texts are cut there into units whose tokens, groups and links depend on
  nothing else. Each Python worker aligns a distinct unit once and keeps the
  result in a table of bounded size (:class:`Units`). A text with a unit whose
  bytes do not come back is tokenized as a whole before it is given up.
* A pair's count is the number of documents that hold it linked. Documents
  are gathered into pieces of ``PIECE_BYTES`` of text; a piece counts its own
  distinct pairs, and only those are dealt out, summed and compared by A id
  (two partial aggregations). The counts go back to the pieces by a join on
  the pair, where a very common pair has one row per piece, not per document;
  AQE splits such a key. Pieces are written once to shared storage in between.

Defined results: NULL and empty texts, and texts whose tokens' bytes do not
join to the same bytes as a space and the text (a normalisation on either
side), have no tokens: zeros and ''. Control strings in texts are plain text.
Repeated rows count as documents of their own, NULL doc_ids are kept; empty
tables give empty results; columns other than ``doc_id`` and ``text`` are not
read. Units of a long text are taken ``BLOCK_UNITS`` at a time; only a unit
(a text without single spaces) has to fit a task whole, as do the distinct
links of a piece of ``PIECE_BYTES`` or of one longer document.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, stored
from lectern.llm.packing import pack, unpack
from lectern.llm.textops import pieces

PIECE_BYTES = 8 << 20        # text whose pairs are summed before anything is dealt out
BLOCK_UNITS = 1 << 16        # units of texts that are looked up at once
KEPT_UNITS = 800_000         # units that a worker remembers from piece to piece
KEPT_LINKS = 8_000_000       # and links in them, about 250 MB together

#: A unit goes on over every gap that is not a single space between two other characters.
_UNIT = re.compile(r"\s*\S+(?:(?! \S)\s+\S+)*(?:\s+\Z)?|\s+")

PIECES = "piece long, docs binary, codes binary, times binary, own binary, a binary, b binary, n binary"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def _byte_level() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for b, c in zip(plain + other, plain + [256 + i for i in range(len(other))])}


class Vocabularies:
    """Both tokenizers, with the bytes of every entry; built once per Python worker."""

    _made: dict = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        stand_in = _byte_level()
        size = self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(stand_in[c] for c in e) if all(c in stand_in for c in e) else e.encode() for e in entries]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_width = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_width = np.array([len(x) for x in self.b_bytes], np.int64)
        #: no piece of B goes over a gap, so that units stand for themselves
        self.cuttable = not any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        # texts of an id followed by each separator: "," inside a side, "|" after A, ";" after a group
        ids = max(size, len(self.b_bytes))
        self.ids = ids
        self.said = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(ids)]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Vocabularies":
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]


def byte_ends(begin: np.ndarray, end: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Byte offset at which each token ends.

    ``begin`` and ``end`` are the byte offsets of the reported spans, ``width``
    the decoded byte lengths. Spans as wide as the token are taken as they are;
    ends of the others are counted on from the last such cut (the start of the
    texts is one).
    """
    total = np.cumsum(width)
    exact = end - begin == width
    last = np.maximum.accumulate(np.where(exact, np.arange(len(end)), -1))
    drift = np.where(last >= 0, (end - total)[last], 0)
    return np.where(exact, end, total + drift)


class Aligned:
    """Tokens, groups and links of a few texts, as flat arrays over their joined bytes."""

    def __init__(self, texts: list[str | None], v: Vocabularies):
        a = [v.a.encode(" " + t, add_special_tokens=False) if t else None for t in texts]
        b = v.b.encode([t or "" for t in texts], return_type="offset_mapping", return_bytes=True, num_threads=1)
        spaced = [b" " + t.encode() if t else b"" for t in texts]
        a_ids = [e.ids if e else [] for e in a]
        b_ids = [e["ids"] if t else [] for e, t in zip(b, texts)]
        fits = [bool(t) and b"".join(map(v.a_bytes.__getitem__, x)) == t == b"".join(map(v.b_bytes.__getitem__, y))
                for t, x, y in zip(spaced, a_ids, b_ids)]
        a_ids = [x if ok else [] for x, ok in zip(a_ids, fits)]
        b_ids = [x if ok else [] for x, ok in zip(b_ids, fits)]
        spaced = [x if ok else b"" for x, ok in zip(spaced, fits)]
        self.docs = len(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        flat = lambda lists, n, t: np.fromiter(itertools.chain.from_iterable(lists), t, n)
        self.a = flat(a_ids, self.n_a.sum(), np.int64)
        self.b = flat(b_ids, self.n_b.sum(), np.int64)
        self.start = np.cumsum([0] + [len(x) for x in spaced])      # of each text in the joined bytes

        raw = np.frombuffer(b"".join(spaced), np.uint8)
        chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))   # byte offset of every character
        first = np.searchsorted(chars, self.start[:-1])
        spans = flat(itertools.chain.from_iterable(e.offsets for e, ok in zip(a, fits) if ok), 2 * len(self.a), np.int64)
        spans = chars[spans.reshape(-1, 2) + np.repeat(first, self.n_a)[:, None]]
        a_ends = byte_ends(spans[:, 0], spans[:, 1], v.a_width[self.a])
        spans = flat(itertools.chain.from_iterable(e["offsets"] for e, ok in zip(b, fits) if ok), 2 * len(self.b), np.int64)
        # spans of B lie in the text itself; the space before it belongs to the first token
        spans = spans.reshape(-1, 2) + (np.repeat(self.start[:-1], self.n_b) + 1)[:, None]
        leading = (np.cumsum(self.n_b) - self.n_b)[self.n_b > 0]
        spans[leading, 0] -= 1
        b_ends = byte_ends(spans[:, 0], spans[:, 1], v.b_width[self.b])

        at_a, at_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        at_a[a_ends], at_b[b_ends] = True, True
        cuts = np.flatnonzero(at_a | at_b)                         # every cut ends one link
        before_a, before_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
        self.link_a, self.link_b = self.a[before_a[cuts]], self.b[before_b[cuts]]
        self.n_links = np.diff(np.searchsorted(cuts, self.start, side="right"))
        both = at_a & at_b
        closing = np.flatnonzero(both)
        self.n_groups = np.diff(np.searchsorted(closing, self.start, side="right"))
        self.fits = np.array(fits, bool)
        self._strings(v, a_ends, b_ends, both)

    def _strings(self, v: Vocabularies, a_ends, b_ends, both) -> None:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        group = np.cumsum(both) - both
        side = np.concatenate([2 * group[a_ends], 2 * group[b_ends] + 1])
        mark = np.concatenate([both[a_ends], 2 * both[b_ends].astype(np.int64)])
        code = (mark * v.ids + np.concatenate([self.a, self.b]))[np.argsort(side, kind="stable")]
        said = list(map(v.said.__getitem__, code.tolist()))
        hi = np.cumsum(self.n_a + self.n_b)
        self.groups = [b"".join(said[e - n:e])[:-1] for e, n in zip(hi.tolist(), (self.n_a + self.n_b).tolist())]


class _Growing:
    """An array that is appended to, copied only when its room has doubled."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1 << 10, dtype), 0

    def append(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.room):
            room = np.empty(max(need, 2 * len(self.room)), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:need] = more
        self.n = need

    @property
    def all(self) -> np.ndarray:
        return self.room[:self.n]


class Units:
    """Distinct units of a worker's texts, each aligned once."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.code: dict[str, int] = {}
        self.pair: dict[int, int] = {}            # A id and B id packed -> number of the pair
        self.groups: list[bytes] = []
        self.sizes = [_Growing(np.int32) for _ in range(4)]      # n_a, n_b, n_groups, n_links
        self.fits = _Growing(bool)
        self.first = _Growing(np.int64)           # of each unit's links
        self.links = _Growing(np.int32)           # numbers of pairs

    def codes(self, units: list[str]) -> np.ndarray:
        get = self.code.get
        got = [get(u, -1) for u in units]
        new = list(dict.fromkeys(u for u, c in zip(units, got) if c < 0))
        if new:
            self._add(new)
            got = [self.code[u] if c < 0 else c for u, c in zip(units, got)]
        return np.array(got, np.int64)

    def _add(self, new: list[str]) -> None:
        lo = 0
        while lo < len(new):                      # a few at a time: their tokens are held together
            hi, chars = lo, 0
            while hi < len(new) and chars < 1 << 17:
                chars += len(new[hi])
                hi += 1
            x = Aligned([u[1:] for u in new[lo:hi]], self.v)
            self.code.update(zip(new[lo:hi], range(len(self.code), len(self.code) + hi - lo)))
            keys, inverse = np.unique(x.link_a << 32 | x.link_b, return_inverse=True)
            numbers = np.array([self.pair.setdefault(k, len(self.pair)) for k in keys.tolist()], np.int32)
            self.first.append(self.links.n + np.cumsum(x.n_links) - x.n_links)
            self.links.append(numbers[inverse] if len(keys) else np.empty(0, np.int32))
            for column, values in zip(self.sizes, (x.n_a, x.n_b, x.n_groups, x.n_links)):
                column.append(values)
            self.fits.append(x.fits)
            self.groups += x.groups
            lo = hi

    def links_of(self, codes: np.ndarray) -> np.ndarray:
        n = self.sizes[3].all[codes].astype(np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.links.all[np.repeat(self.first.all[codes], n) + within]

    _kept: dict = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Units":
        """The worker's table; a new one when the last has become too large."""
        kept = cls._kept.get((a_path, b_path))
        if kept is None or len(kept.code) > KEPT_UNITS or kept.links.n > KEPT_LINKS:
            kept = cls._kept[a_path, b_path] = cls(Vocabularies.of(a_path, b_path))
        return kept


class _Piece:
    """Documents gathered until their pairs are dealt out together."""

    def __init__(self, units: Units):
        self.units = units
        self.ids: list = []
        self.sizes = [_Growing(np.int64) for _ in range(4)]
        self.sha: list[str] = []
        self.held = np.empty(0, np.int64)         # distinct (document, pair)
        self.times = np.empty(0, np.int64)        # and how often
        self.new: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        base, n = self.sizes[0].n, len(texts)
        self.ids.append(ids)
        total = np.zeros((4, n), np.int64)
        digest = [hashlib.sha256() for _ in texts]
        units, rows, whole = [], [], set()

        def settle():
            codes = self.units.codes(units)
            row = np.repeat(*np.array(rows).T)
            bad = set(row[~self.units.fits.all[codes]].tolist())
            whole.update(bad)
            for column, sizes in zip(total, self.units.sizes):
                column += np.bincount(row, sizes.all[codes], minlength=n).astype(np.int64)
            lo = 0
            for r, k in rows:
                if r not in whole:
                    joined = b";".join(map(self.units.groups.__getitem__, codes[lo:lo + k].tolist()))
                    digest[r].update(joined if starts[r] else b";" + joined)
                    starts[r] = False
                lo += k
            links = self.units.links_of(codes)
            self.new.append((base + np.repeat(row, self.units.sizes[3].all[codes])) << 32 | links)
            if sum(map(len, self.new)) > 1 << 22:
                self._fold()

        starts = [True] * n
        for r, text in enumerate(texts):
            if not text:
                continue
            if not self.units.v.cuttable:
                units.append(" " + text)
                rows.append((r, 1))
            elif len(text) < 1 << 20:
                found = _UNIT.findall(" " + text)
                units += found
                rows.append((r, len(found)))
            else:
                matches = (m[0] for m in _UNIT.finditer(" " + text))
                while found := list(itertools.islice(matches, BLOCK_UNITS)):
                    units += found
                    rows.append((r, len(found)))
                    settle()
                    units, rows = [], []
            if len(units) >= BLOCK_UNITS:
                settle()
                units, rows = [], []
        if units:
            settle()
        if whole:
            self._whole(sorted(whole), texts, total, digest, base)
        for column, values in zip(self.sizes, total):
            column.append(values)
        self.sha += [d.hexdigest() if t else "" for d, t in zip(digest, total[0].tolist())]
        self.bytes += sum(len(t) for t in texts if t) + 64 * n

    def _whole(self, rows: list[int], texts, total, digest, base) -> None:
        """Texts with units that do not fit: what their tokens say as a whole counts."""
        self._fold()
        keep = ~np.isin(self.held >> 32, base + np.array(rows))
        self.held, self.times = self.held[keep], self.times[keep]
        for r in rows:
            x = Aligned([texts[r]], self.units.v)
            total[:, r] = x.n_a[0], x.n_b[0], x.n_groups[0], x.n_links[0]
            digest[r] = hashlib.sha256(x.groups[0])
            if x.fits[0]:
                pair = self.units.pair
                links = [pair.setdefault(k, len(pair)) for k in (x.link_a << 32 | x.link_b).tolist()]
                self.new.append((base + r) << 32 | np.array(links, np.int64))

    def _fold(self) -> None:
        """New links into the distinct ones, with their numbers."""
        own, n = np.unique(np.concatenate([self.held, *self.new]), return_counts=True)
        if len(self.held):
            n[np.searchsorted(own, self.held)] += self.times - 1
        self.held, self.times, self.new = own, n, []

    def row(self, number: int) -> pa.RecordBatch:
        self._fold()
        used, code = np.unique(self.held & 0xFFFFFFFF, return_inverse=True)
        keys = np.fromiter(self.units.pair, np.int64, len(self.units.pair))[used]     # in order of their numbers
        rows = pa.RecordBatch.from_arrays(
            [pa.concat_arrays(self.ids), *(pa.array(x.all) for x in self.sizes), pa.array(self.sha, pa.string())],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        u4 = lambda x: pack(x.astype(np.uint32))
        packed = [sink.getvalue().to_pybytes(), u4(code), u4(self.times),
                  u4(np.bincount(self.held >> 32, minlength=rows.num_rows)),
                  u4(keys >> 32), u4(keys & 0xFFFFFFFF), u4(np.bincount(code, minlength=len(used)))]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in packed)],
                                          names=[f.split()[0] for f in PIECES.split(", ")])


def aligned_pieces(docs: DataFrame, a_path: str, b_path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Tokens aligned, one row per piece of documents (columns ``PIECES``)."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32      # unique in the table written from one run
        piece = _Piece(Units.of(a_path, b_path))
        for batch in batches:
            for part in pieces(batch, 1):
                texts = [t.decode(errors="replace") if t else None
                         for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                piece.add(part.column(0), texts)
                if piece.bytes >= piece_bytes:
                    yield piece.row(number)
                    number, piece = number + 1, _Piece(Units.of(a_path, b_path))
        if piece.ids:
            yield piece.row(number)

    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES)


def _pairs(batches):
    """A piece's distinct pairs as rows."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b, n = (unpack(row[c]).astype(np.int64) for c in "abn")
            for lo in range(0, len(a), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                code = np.arange(lo, lo + len(a[at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), row["piece"])), pa.array(code, pa.int32()), pa.array(a[at], pa.int32()),
                     pa.array(b[at], pa.int32()), pa.array(n[at])], names=["piece", "code", "a", "b", "n"])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: documents that hold the pair, and whether no pair of that A id has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = counts.groupBy("a").agg(F.max("count").alias("_top"))
    return counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))


def _settle(pieces_: pa.Table, scored: pa.Table) -> pa.Table:
    """Corpus-wide counts of a piece's pairs summed over each of its documents."""
    row = pieces_.to_pylist()[0]
    docs = pa.ipc.open_stream(row["docs"]).read_all()
    code, times, own = (unpack(row[c]).astype(np.int64) for c in ("codes", "times", "own"))
    count, best = np.zeros(scored.num_rows, np.int64), np.zeros(scored.num_rows, np.int64)
    at = scored.column("code").to_numpy()
    count[at] = scored.column("count").to_numpy()
    best[at] = scored.column("best").to_numpy().astype(np.int64)
    run = np.concatenate([[[0], [0]], np.cumsum([times * best[code], times * count[code]], axis=1)], axis=1)
    ends = np.cumsum(own)
    n_best, count_sum = run[:, ends] - run[:, ends - own]
    return docs.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).select(
        [f.split()[0] for f in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Groups and links of every document, with corpus-wide counts of its linked pairs (columns ``RESULT``)."""
    made = stored(aligned_pieces(docs, a_path, b_path, piece_bytes), "alignment")
    pairs = made.select("piece", "a", "b", "n").mapInArrow(_pairs, "piece long, code int, a int, b int, n long")
    scored = pairs.drop("n").join(pair_counts(pairs), ["a", "b"]).select("piece", "code", "count", "best")
    return made.drop("a", "b", "n").groupBy("piece").cogroup(scored.groupBy("piece")).applyInArrow(_settle, RESULT)
