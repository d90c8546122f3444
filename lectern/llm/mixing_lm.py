"""Language-model scores by logistic mixing of context bit predictors.

A text is read as bytes (A-Z lower-cased, an end byte after the last). Each of
the eight bits of a byte is predicted by exact counts of its contexts of zero
to five preceding bytes. The predictions' log-odds are combined by weights
chosen by a gate (bit number and how many contexts are known), and the mix is
refined by an adaptive map from (preceding byte, mixed log-odds) to
probability. Counts are sums over all training documents: six-byte strings
(five bytes of context and the byte) hold the counts of every order and bit,
so pieces of input send their distinct strings to the bucket of the two bytes
before the last, where orders two to five are counted; orders zero and one are
a table of 65,536 byte pairs. The strings and counts are a Spark table that
grows with the training text.

Weights and map are learnt from every place of every training document, each
place with its own occurrence taken out of the counts: sums of gradient and
curvature over all buckets, then a Newton step, a few times (``WEIGHT_PASSES``,
``MAP_PASSES``). This is the loss that online learning descends place by place;
the sums are integers, so the result does not depend on the order of tasks.
Every distinct string is scored once, in its bucket, and its score goes back to
the pieces that hold it; a score is a function of the text alone.

Beside it stands the unigram base: counts of all training words. Words travel
once per piece of input, not once per place: each piece sends its distinct
words to the bucket of their hash and gets their counts back.

Defined results: NULL or empty text has only its end; NULL doc_id is never
held out; rows that repeat a doc_id are scored row by row; without training
rows every count is 0 and the mix predicts each bit with 1/2; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops
from lectern.llm.common import shuffle_partitions, stored
from lectern.llm.packing import bucket_of, pack, unpack

ORDERS = (0, 1, 2, 3, 4, 5)
PIECE_BYTES = 12 << 20
GATES = 8 * len(ORDERS)
BUCKETS = 24                                     # log-odds steps of the adaptive map
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 << 20                            # text whose places are held at once
WEIGHT_PASSES, MAP_PASSES = 5, 3
UNIT = 1 << 10                                   # sums over places are kept in integers of 1 / UNIT
_I, _K = np.triu_indices(len(ORDERS))


def places(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(six bytes ending at each place, row): every byte of every text and its end byte 0."""
    n = len(offs) - 1
    lens = np.diff(offs)
    row = np.repeat(np.arange(n), lens)
    padded = np.zeros(len(raw) + 6 * n, np.uint64)
    padded[np.arange(len(raw)) + 6 * row + 5] = _FOLD[raw]
    if n == 0:
        return np.empty(0, np.uint64), row
    key = padded[5:].copy()
    for back in range(1, 6):
        key |= padded[5 - back:len(padded) - back] << np.uint64(8 * back)
    each = lens + 1
    first = np.cumsum(lens + 6) - (lens + 6)
    at = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return key[at], np.repeat(np.arange(n), each)


def collapse(h: np.ndarray, bits: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, index of each element among them) by one pass over a direct-mapped table."""
    n = len(h)
    slot = (textops.mix(h) >> np.uint64(64 - bits)).astype(np.int64)
    holder = np.empty(1 << bits, np.int64)
    every = np.arange(n)
    holder[slot] = every
    lead = holder[slot]
    same = h[lead] == h
    leaders = np.flatnonzero(lead == every)
    number = np.empty(n, np.int64)
    number[leaders] = np.arange(len(leaders))
    code = number[lead]
    rest = np.flatnonzero(~same)
    if not len(rest):
        return h[leaders], code
    more, inverse = np.unique(h[rest], return_inverse=True)
    code[rest] = inverse + len(leaders)
    return np.concatenate([h[leaders], more]), code


def by_context(keys: np.ndarray) -> np.ndarray:
    """Six-byte strings with the byte before the last as the highest: order ``k`` shares its first ``k`` bytes."""
    out = keys & np.uint64(255)
    for back in range(1, 6):
        out |= ((keys >> np.uint64(8 * back)) & np.uint64(255)) << np.uint64(8 * (6 - back))
    return out


def levels(strings: np.ndarray, times: np.ndarray, pairs: np.ndarray) -> Iterator[tuple]:
    """Per bit number: (unit of each string, first string of each unit, n0 and n1 of each unit and order).

    ``strings`` ascend and are all those of their two-byte contexts; ``pairs``
    counts (preceding byte, byte). A unit is a five-byte context with the bits before.
    """
    byte = strings & np.uint64(255)
    pairs = pairs.astype(np.float64)
    orders = [(np.arange(256, dtype=np.uint64), pairs.reshape(256, 256).sum(axis=0), byte.astype(np.int64)),
              (np.arange(65536, dtype=np.uint64), pairs, ((strings >> np.uint64(40) << np.uint64(8)) | byte).astype(np.int64))]
    for k in ORDERS[2:]:
        own, at = np.unique((strings >> np.uint64(8 * (6 - k)) << np.uint64(8)) | byte, return_inverse=True)
        orders.append((own, np.bincount(at, weights=times, minlength=len(own)), at))
    for j in range(8):
        cut = np.uint64(8 - j)
        unit = strings >> cut
        begins = np.diff(unit, prepend=~unit[:1]) != 0
        first = np.flatnonzero(begins)
        n0, n1 = np.empty((len(first), len(ORDERS))), np.empty((len(first), len(ORDERS)))
        for k, (own, total, at) in enumerate(orders):
            node = own >> cut
            group = np.cumsum(np.diff(node, prepend=node[:1]) != 0)
            one = ((own >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64)
            mine = group[at[first]]
            ones = np.bincount(group, weights=total * one)
            n1[:, k] = ones[mine]
            n0[:, k] = (np.bincount(group, weights=total) - ones)[mine]
        yield np.cumsum(begins) - 1, first, n0, n1


def _inputs(n0: np.ndarray, n1: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of every order, and the gate."""
    return np.log((n1 + 0.4) / (n0 + 0.4)), j * len(ORDERS) + (n0[:, 1:] + n1[:, 1:] > 0).sum(axis=1)


@dataclass
class Mixer:
    pairs: np.ndarray         # counts of (preceding byte, byte)
    weights: np.ndarray       # (GATES, orders)
    refine: np.ndarray        # (256, BUCKETS + 1) log-odds after refinement

    def log2(self, strings: np.ndarray, times: np.ndarray) -> np.ndarray:
        """log2 probability of the last byte of every string of a bucket, given the five before it."""
        total = np.zeros(len(strings))
        before = (strings >> np.uint64(40)).astype(np.int64)
        for j, (unit, first, n0, n1) in enumerate(levels(strings, times, self.pairs)):
            x, gate = _inputs(n0, n1, j)
            p = _probability(_mix_and_refine((x * self.weights[gate]).sum(axis=1), self.refine, before[first]))
            bit = (strings >> np.uint64(7 - j)) & np.uint64(1)
            total += np.where(bit > 0, np.log2(p)[unit], np.log2(1 - p)[unit])
        return total

    def sums(self, strings: np.ndarray, times: np.ndarray, mapped: bool) -> np.ndarray:
        """Gradient and curvature of the log-likelihood of a bucket's training places, in 1 / UNIT."""
        shape = (2, 256 * (BUCKETS + 1)) if mapped else (len(ORDERS) + len(_I), GATES)
        out = np.zeros(shape)
        before = (strings >> np.uint64(40)).astype(np.int64)
        for j, (_, first, n0, n1) in enumerate(levels(strings, times, self.pairs)):
            for bit, n in ((0, n0), (1, n1)):
                some = np.flatnonzero(n[:, -1])
                often = n[some, -1]
                # the place's own occurrence is taken out of every order
                x, gate = _inputs(n0[some] - (bit == 0), n1[some] - bit, j)
                mixed = (x * self.weights[gate]).sum(axis=1)
                if mapped:
                    low, part = _cell(mixed)
                    cell = before[first[some]] * (BUCKETS + 1) + low
                    flat = self.refine.ravel()
                    p = _probability(flat[cell] * (1 - part) + flat[cell + 1] * part)
                    for at, share in ((cell, 1 - part), (cell + 1, part)):
                        out[0] += np.bincount(at, often * (bit - p) * share, shape[1])
                        out[1] += np.bincount(at, often * p * (1 - p) * share, shape[1])
                else:
                    p = _probability(mixed)
                    for k in ORDERS:
                        out[k] += np.bincount(gate, often * (bit - p) * x[:, k], GATES)
                    for r, (i, k) in enumerate(zip(_I, _K)):
                        out[len(ORDERS) + r] += np.bincount(gate, often * p * (1 - p) * x[:, i] * x[:, k], GATES)
        return np.rint(out * UNIT).astype(np.int64)

    def step(self, sums: np.ndarray, mapped: bool) -> None:
        """One Newton step from the sums of all buckets; a weak pull to the start settles what no place tells."""
        s = sums / UNIT
        if mapped:
            s = s.reshape(2, 256, BUCKETS + 1)
            self.refine = np.clip(self.refine + (s[0] + _IDENTITY - self.refine) / (s[1] + 1), -11, 11)
            return
        bend = np.zeros((GATES, len(ORDERS), len(ORDERS)))
        bend[:, _I, _K] = bend[:, _K, _I] = s[len(ORDERS):].T
        move = np.linalg.solve(bend + np.eye(len(ORDERS)), (s[:len(ORDERS)].T + START - self.weights)[:, :, None])[:, :, 0]
        self.weights = self.weights + move / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1)


START = 0.3
_IDENTITY = np.arange(BUCKETS + 1) * 16 / BUCKETS - 8.0


def starting_mixer(pairs: np.ndarray) -> Mixer:
    return Mixer(pairs, np.full((GATES, len(ORDERS)), START), np.tile(_IDENTITY, (256, 1)))


def _probability(x: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-x)), 1 / 65536, 1 - 1 / 65536)


def _cell(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = (np.clip(x, -7.99, 7.99) + 8) * (BUCKETS / 16)
    low = pos.astype(np.int64)
    return low, pos - low


def _mix_and_refine(x: np.ndarray, refine: np.ndarray, before: np.ndarray) -> np.ndarray:
    low, part = _cell(x)
    fine = refine[before, low] * (1 - part) + refine[before, low + 1] * part
    return (x + fine) / 2


# ---- Spark: counts of contexts and words --------------------------------------------

SENT = "bucket int, kind string, piece bigint, a binary, b binary, c binary, d binary"
BACK = "bucket int, kind string, home bigint, n bigint, v bigint, a binary, b binary, c binary, d binary"
OUT = "doc_id bigint, n_tokens bigint, n_known bigint, log_sum double, n_bytes bigint, bits double"
_ABCD = [(c, pa.binary()) for c in "abcd"]
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("piece", pa.int64())] + _ABCD)
_BACK = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("home", pa.int64()), ("n", pa.int64()), ("v", pa.int64())] + _ABCD)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64()),
                  ("n_bytes", pa.int64()), ("bits", pa.float64())])
END = np.uint64(0xE0DE0DE0DE0DE0D1)              # hash of the end token


def trains(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 != 2, F.lit(True))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def _crcs(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(raw))
    return np.array([zlib.crc32(view[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Strings under the bucket of the two bytes before their last, ascending as (bucket, string)."""
    strings = by_context(keys)
    bucket = bucket_of(textops.mix((strings >> np.uint64(32)) + _STEP), min(buckets, 1 << 16))
    return (bucket.astype(np.uint64) << np.uint64(48)) | strings


_STRING = np.uint64((1 << 48) - 1)


def _scan(buckets: int):
    """Distinct strings and words of each piece with their training counts, and the texts of the piece."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, valid, crc, train, words, sizes, texts, grams, often, held = [], [], [], [], [], [], [], [], [], 0

        def flush():
            doc, sums, tr = np.concatenate(ids), np.concatenate(crc), np.concatenate(train)
            raw, n = np.concatenate(texts), np.concatenate(sizes)
            distinct, c = _counted(np.concatenate(words), np.repeat(tr, n))
            piece = np.bitwise_xor.reduce(textops.mix(distinct + c.astype(np.uint64))) ^ np.bitwise_xor.reduce(
                textops.mix(doc.astype(np.uint64) * _STEP + sums.astype(np.uint64) + np.arange(len(doc), dtype=np.uint64)))
            piece = int(np.int64(piece.astype(np.int64)))
            home = int(bucket_of(np.array([textops.mix(np.array([piece], np.int64).astype(np.uint64))[0]]), buckets)[0])
            yield _table([(home, "docs", piece, pack(doc), pack(np.concatenate(valid)), pack(np.concatenate(lens)), pack(raw))], _SENT)
            strings, at = np.unique(np.concatenate(grams), return_inverse=True)
            g = np.bincount(at, weights=np.concatenate(often), minlength=len(strings)).astype(np.int64)
            rows = []
            for kind, keys, times, where in (("words", distinct, c, bucket_of(distinct, buckets)),
                                             ("grams", strings & _STRING, g, (strings >> np.uint64(48)).astype(np.int64))):
                edge = np.searchsorted(where, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edge)):
                    lo, hi = edge[b], edge[b + 1]
                    rows.append((int(b), kind, piece, pack(keys[lo:hi], delta=True), pack(times[lo:hi].astype(np.int64)),
                                 pack(np.array([lo], np.int64)), b""))
                    if len(rows) >= 64:
                        yield _table(rows, _SENT)
                        rows = []
            if rows:
                yield _table(rows, _SENT)
        lens: list[np.ndarray] = []
        for batch in batches:
            for part in textops.pieces(batch, 1, SLICE_BYTES):
                raw, offs = textops.text_bytes(part.column(1))
                tr = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                key, row = places(raw, offs)
                distinct, code = collapse(key)
                grams.append(_by_bucket(distinct, buckets))
                often.append(np.bincount(code, weights=tr[row], minlength=len(distinct)))
                h, n = _words(raw, offs)
                doc = part.column(0)
                ids.append(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                valid.append(doc.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
                crc.append(_crcs(raw, offs))
                train.append(tr)
                words.append(h)
                sizes.append(n)
                lens.append(np.diff(offs).astype(np.int64))
                texts.append(raw.copy())
                held += len(raw)
                if held >= PIECE_BYTES:
                    yield from flush()
                    for x in (ids, valid, crc, train, words, sizes, lens, texts, grams, often):
                        x.clear()
                    held = 0
        if ids:
            yield from flush()
    return scan


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, its end last, and their number per text."""
    w = textops.words_of(raw, offs)
    return np.insert(textops.word_hashes(w), w.first[1:], END), w.counts() + 1


def _ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, rank of each element)."""
    distinct, code = collapse(h)
    by = np.argsort(distinct)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return distinct[by], place[code]


def _counted(h: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, code = _ranked(h)
    return distinct, np.bincount(code[chosen], minlength=len(distinct))


def _add_up(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(code, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's buckets: sums of words, whose counts go back to their pieces, and of strings (``table``)."""
    keys, times, pieces, firsts = [], [], [], []
    tables: dict[int, tuple[list, list]] = {}
    fresh: dict[int, int] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == "docs":
                yield _table([(None, "docs", r["piece"], None, None, r["a"], r["b"], r["c"], r["d"])], _BACK)
            elif r["kind"] == "grams":
                b = r["bucket"]
                k, t = tables.setdefault(b, ([], []))
                k.append(unpack(r["a"]))
                t.append(unpack(r["b"]))
                fresh[b] = fresh.get(b, 0) + len(k[-1])
                if fresh[b] > 1 << 20:
                    merged = _add_up(k, t)
                    tables[b], fresh[b] = ([merged[0]], [merged[1]]), 0
                yield _table([(b, "grams", r["piece"], None, None, r["a"], r["c"], b"", b"")], _BACK)
            else:
                keys.append(unpack(r["a"]))
                times.append(unpack(r["b"]))
                pieces.append(r["piece"])
                firsts.append(r["c"])
    for b, (k, t) in tables.items():
        strings, total = _add_up(k, t)
        yield _table([(b, "table", None, len(strings), None, pack(strings, delta=True), pack(total), b"", b"")], _BACK)
    if keys:
        distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(code, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64)
        yield _table([(None, "sizes", None, int(total.sum()), int((total > 0).sum()), b"", b"", b"", b"")], _BACK)
        back, at = total[code], 0
        for k, piece, first in zip(keys, pieces, firsts):
            yield _table([(None, "words", piece, None, None, first, pack(back[at:at + len(k)]), b"", b"")], _BACK)
            at += len(k)


def _joined(rows: list[dict], kind: str, dtype) -> np.ndarray:
    """The values sent back to a piece, in order (a piece that occurs twice gets equal values twice)."""
    parts = {int(unpack(r["a"])[0]): r["b"] for r in rows if r["kind"] == kind}
    return np.concatenate([unpack(parts[k]).view(dtype) for k in sorted(parts)])


def _gather(buckets: int):
    """Per piece: every document's sum of log10(count + 1), number of known tokens and bits."""
    def gather(table: pa.Table) -> pa.Table:
        rows, done = table.to_pylist(), []
        count, score = _joined(rows, "words", np.int64), _joined(rows, "grams", np.float32)
        value = np.log10(count + 1.0)
        for r in rows:
            if r["kind"] != "docs":
                continue
            ids, valid, lens, raw = (unpack(r[c]) for c in "abcd")
            offs = np.concatenate([[0], np.cumsum(lens)])
            cuts = [0]
            while cuts[-1] < len(ids):
                hi = int(np.searchsorted(offs, offs[cuts[-1]] + SLICE_BYTES, side="right")) - 1
                cuts.append(min(max(hi, cuts[-1] + 1), len(ids)))
            grams, codes, hashes, sizes = [], [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part, at = raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                distinct, c = collapse(places(part, at)[0])
                grams.append(_by_bucket(distinct, buckets))
                codes.append(c.astype(np.int32))
                h, k = _words(part, at)
                hashes.append(h)
                sizes.append(k)
            n = np.concatenate(sizes)
            code, first = _ranked(np.concatenate(hashes))[1], np.cumsum(n) - n
            at = np.unique(np.concatenate(grams), return_inverse=True)[1]
            bits, used = [], 0
            for lo, hi, g, c in zip(cuts[:-1], cuts[1:], grams, codes):
                own = score[at[used:used + len(g)]].astype(np.float64)
                bits.append(np.bincount(np.repeat(np.arange(hi - lo), lens[lo:hi] + 1), weights=own[c], minlength=hi - lo))
                used += len(g)
            done.append(pa.RecordBatch.from_arrays([
                pa.array(ids, mask=valid == 0), pa.array(n.astype(np.int64)),
                pa.array(np.add.reduceat((count[code] > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(value[code], first)), pa.array(lens), pa.array(np.concatenate(bits))], schema=_OUT))
        return pa.Table.from_batches(done, _OUT)
    return gather


# ---- Spark: learning and scoring ------------------------------------------------------

def _summed(table: DataFrame, of) -> np.ndarray:
    """Sum of integer arrays ``of(strings, times)`` over all buckets; one row per task comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = of(unpack(a), unpack(b))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(total.ravel())], pa.binary())], names=["a"])
    got = table.select("a", "b").mapInArrow(run, "a binary").toLocalIterator()
    return reduce(np.add, (unpack(a) for (a,) in got), 0)


def _pair_counts(strings: np.ndarray, times: np.ndarray) -> np.ndarray:
    pair = ((strings >> np.uint64(40) << np.uint64(8)) | (strings & np.uint64(255))).astype(np.int64)
    return np.bincount(pair, weights=times, minlength=65536).astype(np.int64)


def learn_mixer(table: DataFrame) -> Mixer:
    """Weights, then the map, from all training places of the table of strings."""
    mixer = starting_mixer(np.zeros(65536, np.int64) + _summed(table, _pair_counts))
    if not mixer.pairs.any():
        return mixer
    for mapped in [False] * WEIGHT_PASSES + [True] * MAP_PASSES:
        sums = _summed(table, lambda strings, times: mixer.sums(strings, times, mapped))
        mixer.step(sums.reshape(-1, 256 * (BUCKETS + 1) if mapped else GATES), mapped)
    return mixer


def _score_strings(mixer):
    """Scores of the strings of every piece, bucket by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, wanted = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == "table":
                    tables[r["bucket"]] = (r["a"], r["b"])
                else:
                    wanted.setdefault(r["bucket"], []).append((r["home"], r["a"], r["b"]))
        for b, (keys, times) in tables.items():
            strings = unpack(keys)
            score = mixer.value.log2(strings, unpack(times)).astype(np.float32).view(np.uint32)
            for home, own, first in wanted[b]:
                yield _table([(b, "grams", home, None, None, first, pack(score[np.searchsorted(strings, unpack(own))]), b"", b"")], _BACK)
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    spark = docs.sparkSession
    buckets = 2 * shuffle_partitions(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("train", trains(F.col("doc_id")))
    sent = rows.mapInArrow(_scan(buckets), SENT)
    back = stored(sent.repartition("bucket").mapInArrow(_merge, BACK), "mixing-lm")
    sizes = back.where("kind = 'sizes'").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(sizes[0] or 0), int(sizes[1] or 0)
    table = stored(back.where("kind = 'table'").select("bucket", "a", "b"), "mixing-lm-strings")
    mixer = spark.sparkContext.broadcast(learn_mixer(table))
    scored = back.where("kind IN ('table', 'grams')").repartition("bucket").mapInArrow(_score_strings(mixer), BACK)
    homes = back.where("kind IN ('docs', 'words')").unionByName(scored)
    got = homes.groupBy("home").applyInArrow(_gather(buckets), OUT)
    return got.select(
        "doc_id", (~trains(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("bits") * F.log10(F.lit(2.0))).alias("score"),
        (-F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
