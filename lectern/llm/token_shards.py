"""Token ids in seekable binary shards: one zstandard frame per document.

A shard is a plain ``.zst`` file: an index frame, one frame of ids per
document in ascending doc_id order, and the public *zstd seekable format*
seek table at the end (a skippable frame with compressed size, raw size and
the low half of XXH64 for every frame). Ids are little-endian unsigned 32-bit
integers. The index frame holds the doc_ids (validity byte and signed 64-bit
integer each). A reader fetches the tail, finds the frames of the documents
it wants and decompresses only those; each is checked against its checksum.

Spark sorts the documents by range of doc_id; each task writes one shard to
the shared folder under a name of its own attempt, and reports it in one
manifest row. Only shards of the manifest count, so a lost executor or a
second attempt leaves at most an unused file behind.

Defined results: NULL or empty text gives the end id alone; NULL doc_id comes
first; equal doc_ids are ordered by text, all are kept; an empty table gives
an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textops
from lectern.llm.common import scratch_path

SKIPPABLE = 0x184D2A5E          # fixed values of the zstd seekable format
SEEKABLE = 0x8F92EAB1
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
CHECKSUM_FLAG = 0x80
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"
TOKENS = "doc_id bigint, shard int, frame int, shard_start bigint, n_tokens bigint, ids_crc32 bigint"


# ---- encoding -------------------------------------------------------------

class PieceEncoder:
    """Ids of texts; every distinct blank-separated piece is encoded once.

    The vocabulary's words never cross a blank or newline (white space is
    dropped before merging), so ids of a text are the ids of its pieces in
    order; nor do they join a letter with a comma or full stop after it. Texts
    of one-byte characters are lower-cased first, as the vocabulary does, unless
    they may hold a special token, which the vocabulary matches before. The
    table of pieces is emptied at ``max_pieces``: memory is bounded.
    """

    def __init__(self, tokenizer_path: str, end_id: int, max_pieces: int = 1_000_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.end_id = end_id
        self.between, = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.max_pieces = max_pieces
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0
        self.at = np.empty(1 << 14, dtype=np.int64)
        self.len = np.empty(1 << 14, dtype=np.int32)

    def _append(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        k, n = len(self.code), len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while k + n > len(self.at):
            self.at, self.len = (np.concatenate([a, np.empty_like(a)]) for a in (self.at, self.len))
        self.ids[self.used:self.used + len(ids)] = ids
        self.at[k:k + n] = self.used + np.cumsum(lens) - lens
        self.len[k:k + n] = lens
        self.used += len(ids)
        self.code.update(zip(pieces, range(k, k + n)))

    def _ends_in_letter(self, piece: str) -> bool:
        """Whether the piece, as the vocabulary normalises it, ends in a letter (U+0130 ends in a mark)."""
        last = piece[-1:]
        if last.isascii():
            return last.isalpha()
        return last.isalpha() and self.tokenizer.normalizer.normalize_str(piece)[-1:].isalpha()

    def _learn(self, fresh: set[str]) -> None:
        code = self.code
        marked = [p for p in fresh if p[-1:] in _MARKS and self._ends_in_letter(p[:-1])]
        plain = fresh.difference(marked)
        plain.update(p[:-1] for p in marked)
        plain.update(p[-1] for p in marked)
        todo = [p for p in plain if p not in code]
        # many pieces are one text to the tokenizer, with a sign between them whose id no piece contains
        odd = [p for p in todo if _BETWEEN in p]
        todo = [p for p in todo if _BETWEEN not in p]
        for lo in range(0, len(todo), 16384):
            part = todo[lo:lo + 16384]
            runs = [f" {_BETWEEN} ".join(part[k:k + 256]) + f" {_BETWEEN}" for k in range(0, len(part), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(
                runs, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.between)
            self._append(part, ids[ids != self.between], np.diff(ends, prepend=-1) - 1)
        for p in odd:
            ids = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32)
            self._append([p], ids, np.array([len(ids)]))
        if marked:
            both = np.fromiter((code[x] for p in marked for x in (p[:-1], p[-1])), np.int64, 2 * len(marked))
            lens = self.len[both].astype(np.int64)
            self._append(marked, self.ids[_ragged(self.at[both], lens)], lens[::2] + lens[1::2])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column, the end id last."""
        raw, offs = textops.text_bytes(column)
        # A-Z fold before the lookup where every character has one byte in Latin-1 (no marks that combine)
        wide = np.concatenate([[0], np.cumsum(raw >= 0xC4)])
        plain = wide[offs[1:]] == wide[offs[:-1]]
        # special tokens match before lower-casing: texts that may hold one keep their capitals
        special = np.flatnonzero((raw[:-1] == _SPECIAL[0]) & (raw[1:] == _SPECIAL[1]))
        plain[np.searchsorted(offs, special, side="right") - 1] = False
        raw = _FOLD[raw] if plain.all() else np.where(np.repeat(plain, np.diff(offs)), _FOLD[raw], _BLANK[raw])
        w = textops.words_of(raw, offs, _GAP)
        size = w.end - w.start
        body = np.ascontiguousarray(raw[~_GAP[raw]])
        words = pa.LargeStringArray.from_buffers(
            len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(body))
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        fresh = set(distinct).difference(self.code)
        if fresh:
            if len(self.code) + 2 * len(fresh) > self.max_pieces:
                self._clear()
                fresh = set(distinct)
            self._learn(fresh)
        own = np.fromiter(map(self.code.__getitem__, distinct), np.int64, len(distinct))
        codes = own[encoded.indices.to_numpy()]
        lens = self.len[codes].astype(np.int64)
        ids = self.ids[_ragged(self.at[codes], lens)]
        stop = np.concatenate([[0], np.cumsum(lens)])[w.first[1:]]
        # the end id goes after the last id of every text
        cut = stop + np.arange(1, len(stop) + 1)
        out = np.empty(len(ids) + len(stop), "<u4")
        inner = np.ones(len(out), bool)
        inner[cut - 1] = False
        out[inner] = ids
        out[cut - 1] = self.end_id
        return np.split(out, cut[:-1]) if len(cut) else []


#: Bytes as looked up: newline as blank, A-Z as a-z (``_BLANK`` keeps capitals); only blanks part pieces.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[10] = 32
_FOLD = _BLANK.copy()
_FOLD[65:91] += 32
_GAP = np.arange(256) == 32
_BETWEEN = "\x01"
_SPECIAL = b"<|"
_MARKS = frozenset((".", ","))
_ENCODERS: dict[tuple, PieceEncoder] = {}


def _ragged(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of the runs that begin at ``at`` and are ``lens`` long."""
    end = np.cumsum(lens)
    return np.repeat(at - (end - lens), lens) + np.arange(int(end[-1]) if len(end) else 0)


def encoder_of(tokenizer_path: str, end_id: int) -> PieceEncoder:
    """The worker's encoder: tasks that follow one another in a worker share its table of pieces."""
    key = (tokenizer_path, end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(tokenizer_path, end_id)
    return _ENCODERS[key]


# ---- shard files ------------------------------------------------------------

def _open(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _low_xxh64(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class ShardWriter:
    """Appends documents; ``close`` adds index frame and seek table."""

    def __init__(self, uri: str):
        import zstandard
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=1, write_content_size=True)
        self.table: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.n_tokens = self.n_bytes = 0

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.n_bytes += len(packed)
        self.table.append(ENTRY.pack(len(packed), len(raw), _low_xxh64(raw)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.tobytes())
        self.doc_ids.append(doc_id)
        self.n_tokens += len(ids)

    def close(self) -> None:
        index = np.zeros(len(self.doc_ids), dtype=[("valid", "u1"), ("id", "<i8")])
        index["valid"] = [d is not None for d in self.doc_ids]
        index["id"] = [d or 0 for d in self.doc_ids]
        self._frame(index.tobytes())
        body = b"".join(self.table) + FOOTER.pack(len(self.table), CHECKSUM_FLAG, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.n_bytes += len(body) + 8
        self.out.close()


class ShardReader:
    """Random access by frame; the last frame is the index of doc_ids."""

    def __init__(self, uri: str):
        import zstandard
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        self.zstd = zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKSUM_FLAG:
            raise ValueError(f"not a seekable shard: {uri}")
        raw = self._at(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
        table = np.frombuffer(raw, dtype=[("packed", "<u4"), ("raw", "<u4"), ("sum", "<u4")])
        self.table = table
        self.start = np.concatenate([[0], np.cumsum(table["packed"].astype(np.int64))])
        index = np.frombuffer(self.frame(n - 1), dtype=[("valid", "u1"), ("id", "<i8")])
        self.doc_ids = [int(i) if v else None for v, i in zip(index["valid"], index["id"])]
        self.n_tokens = (table["raw"][:-1] // 4).astype(np.int64)

    def _at(self, pos: int, n: int) -> bytes:
        self.file.seek(pos)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        raw = self.zstd.decompress(self._at(int(self.start[k]), int(self.table["packed"][k])),
                                   max_output_size=int(self.table["raw"][k]))
        if _low_xxh64(raw) != int(self.table["sum"][k]):
            raise ValueError(f"frame {k}: checksum differs")
        return raw

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.frame(k), dtype="<u4")

    def close(self) -> None:
        self.file.close()


# ---- Spark jobs ---------------------------------------------------------------

def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return their manifest (one small row per shard)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, writer, encoder = TaskContext.get().partitionId(), None, None
        name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            for part in textops.pieces(batch, 1, 2 << 20):
                if writer is None:
                    writer, encoder = ShardWriter(name), encoder_of(tokenizer_path, end_id)
                for doc_id, got in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    writer.add(doc_id, got)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [len(writer.doc_ids)],
                "n_tokens": [writer.n_tokens], "n_bytes": [writer.n_bytes]})

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    manifest = ranged.mapInArrow(write, MANIFEST)
    # whole texts in a batch: few rows each, so that neither side holds tens of MB of text at once
    size = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "1000")
    try:
        manifest.write.parquet(f"{path}/manifest")  # the commit: shards outside it do not count
    finally:
        spark.conf.set(BATCH_ROWS, size)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Decode every shard: one row per document, in file order, with its place and checksum of ids."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = ShardReader(path)
                n = len(r.doc_ids)
                starts = np.cumsum(r.n_tokens) - r.n_tokens
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(r.doc_ids[lo:hi], pa.int64()), pa.array([shard] * (hi - lo), pa.int32()),
                        pa.array(range(lo, hi), pa.int32()), pa.array(starts[lo:hi]), pa.array(r.n_tokens[lo:hi]),
                        pa.array([zlib.crc32(r.frame(k)) for k in range(lo, hi)], pa.int64())],
                        names=["doc_id", "shard", "frame", "shard_start", "n_tokens", "ids_crc32"])
                r.close()

    files = manifest.select("shard", "path").repartition(
        manifest.sparkSession.sparkContext.defaultParallelism * 4, "shard")
    decoded = files.mapInArrow(read, TOKENS)
    # offsets of shards: a running sum over one small row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    return decoded.join(offsets, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "frame")


def fetch(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the documents in ``wanted(doc_id)``: only their frames are decompressed."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                r = ShardReader(path)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(r.doc_ids, pa.int64()), "path": [path] * len(r.doc_ids),
                    "frame": pa.array(range(len(r.doc_ids)), pa.int32())})
                r.close()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            for doc_id, path, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if path != opened:
                    reader, opened = ShardReader(path), path
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_id], pa.int64()),
                    "ids": pa.array([reader.ids(frame).astype(np.int64)], pa.list_(pa.int64()))})

    places = manifest.select("path").mapInArrow(locate, "doc_id bigint, path string, frame int")
    asked = wanted.select(F.col("doc_id").cast("bigint")).distinct()
    found = places.join(asked, "doc_id", "left_semi").select("doc_id", "path", "frame")
    return found.repartition("path").sortWithinPartitions("path", "frame").mapInArrow(
        decode, "doc_id bigint, ids array<bigint>")
