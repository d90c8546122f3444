"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words sums, over all common subsequences of three symbols
spanning at most six places, decay**(skipped places) of both words, divided by
the norm a word of its length can have. Skipped places make it tolerant of
gaps and inserted characters (``i.d.i.o.t``, ``idxiot``); digits and signs
used for letters count as those letters; single letters set apart by blanks
(``s c u m``) are read as one word. Kernel values with the landmark words are
mapped by Nyström's method to features of a linear SVM.

Training uses labelled sentences: the sentences of labelled documents, each
with its document's label. A toxic sentence counts through its most telling
word, a clean one through all its words (those nearest the margin are mined
round by round). Since the decision is linear in the kernel, the landmarks
fold into one weight per triple of symbols, and a whole batch of text is
scored by table lookups. A document's score is a logistic calibration of its
highest margin. Words of more than ``LONG`` symbols are scored as overlapping
windows of ``WINDOW`` symbols, each for itself; training learns from words of 3
to ``LONG`` characters.

The sample is bounded: at most ``per_class`` labelled documents of each class,
the first by hash of doc_id, none longer than ``max_chars``; longer ones are
scored like all others, but not learnt from. Scoring is map-only: no shuffle.

Defined results: NULL or empty text has margin ``FLOOR``; without labelled rows
of both classes every score is 0.5 * (share of toxic labels) (0 if there are
none); NULL doc_id is scored, held_out false; rows are scored one by one, so
repeated rows score alike; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops

SYMBOLS = 64
SPAN = 6
DECAY = 0.6
FLOOR = -3.0
LONG = 24                   # longer words are read in windows of WINDOW symbols
WINDOW, STRIDE = 16, 8

#: Symbol of each byte: letters 1-26, signs that stand for letters as those, other bytes of letters 27-58.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
for _sign, _letter in zip("013457@$!", "oieastasi"):
    _SYMBOL[ord(_sign)] = ord(_letter) - 96
_SYMBOL[128:] = 27 + (np.arange(128, 256) % 32)

_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def _norms(longest: int = 512) -> np.ndarray:
    n = np.arange(longest + 1)
    total = np.zeros(longest + 1)
    for a, b in _GAPS:
        total += np.maximum(n - a - b, 0) * DECAY ** (2 * (a + b - 2))
    return np.sqrt(np.maximum(total, 1.0))


_NORM = _norms()


def _norm(length: np.ndarray) -> np.ndarray:
    return _NORM[np.minimum(length, len(_NORM) - 1)]


@dataclass
class Spans:
    """Words as the kernel reads them: symbol stream, spans and the row of each."""
    sym: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def spans_of(raw: np.ndarray, offs: np.ndarray) -> Spans:
    w = textops.words_of(raw, offs)
    start, end, row = w.start, w.end, w.row
    if len(start):
        alone = end - start == 1
        joined = np.zeros(len(start), bool)       # word continues the one before it
        joined[1:] = alone[1:] & alone[:-1] & (start[1:] - end[:-1] == 1) & (row[1:] == row[:-1])
        head = np.flatnonzero(~joined)
        start, row = start[head], row[head]
        end = end[np.append(head[1:], len(joined)) - 1]
        long = end - start > LONG
        if long.any():
            return _windowed(_SYMBOL[raw], start, end, row, long)
    return Spans(_SYMBOL[raw], start, end, row)


def _windowed(sym: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, long: np.ndarray) -> Spans:
    """Long words as windows. Windows overlap, so each gets its own copy of its
    symbols behind the stream: no triple of one is counted in the next."""
    s, e, r = start[long], end[long], row[long]
    n = -(-(e - s - WINDOW) // STRIDE) + 1
    at = np.repeat(s, n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    size = np.minimum(WINDOW, np.repeat(e, n) - at)
    first = np.cumsum(size) - size
    copied = sym[np.repeat(at - first, size) + np.arange(size.sum())]
    first += len(sym)
    return Spans(np.concatenate([sym, copied]), np.concatenate([start[~long], first]),
                 np.concatenate([end[~long], first + size]), np.concatenate([row[~long], np.repeat(r, n)]))


def _reach(s: Spans) -> np.ndarray:
    """For each place, the end of the word it is in (at or before the place outside words)."""
    reach = np.zeros(len(s.sym) + 1, np.int64)
    by = np.argsort(s.start, kind="stable")
    reach[s.start[by]] = s.end[by]
    return np.maximum.accumulate(reach)[:-1]


def margins(s: Spans, table: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of every word: folded triple weights, summed and normalised."""
    n = len(s.sym)
    if not len(s.start):
        return np.empty(0)
    left = np.clip(_reach(s) - np.arange(n), 0, 127).astype(np.int8)
    high, mid = s.sym * (SYMBOLS * SYMBOLS), s.sym * SYMBOLS
    acc = np.zeros(n, np.float32)
    for a, b in _GAPS:
        m = n - a - b
        if m <= 0:
            continue
        code = high[:m] + mid[a:a + m]
        code += s.sym[a + b:]
        got = table[code]
        got *= left[:m] > a + b
        if a + b > 2:
            got *= np.float32(DECAY ** (a + b - 2))
        acc[:m] += got
    total = np.concatenate([[0.0], np.cumsum(acc, dtype=np.float64)])
    return (total[s.end] - total[s.start]) / _norm(s.end - s.start) + bias


@dataclass
class Model:
    table: np.ndarray        # weight of every symbol triple
    bias: float
    slope: float
    shift: float

    def rows(self, column: pa.Array) -> np.ndarray:
        """Score of every text of a column."""
        s = spans_of(*textops.text_bytes(column))
        top = np.full(len(column), FLOOR)
        if self.slope:
            np.maximum.at(top, s.row, margins(s, self.table, self.bias))
        return 1 / (1 + np.exp(-(self.slope * top + self.shift)))


# ---- training (bounded sample, on the driver) --------------------------------

def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple code, decay weight) of every subsequence in ``words``."""
    col = pa.array(words, pa.large_string())
    raw, offs = textops.text_bytes(col)
    sym, owner = _SYMBOL[raw], np.repeat(np.arange(len(words)), np.diff(offs))
    w, c, v = [], [], []
    for a, b in _GAPS:
        m = len(sym) - a - b
        if m <= 0:
            continue
        ok = (owner[:m] == owner[a + b:]) & (sym[:m] > 0) & (sym[a:a + m] > 0) & (sym[a + b:] > 0)
        i = np.flatnonzero(ok)
        w.append(owner[i])
        c.append(sym[i] * SYMBOLS * SYMBOLS + sym[i + a] * SYMBOLS + sym[i + a + b])
        v.append(np.full(len(i), DECAY ** (a + b - 2)))
    if not w:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(w), np.concatenate(c), np.concatenate(v)


def _lengths(words: list[str]) -> np.ndarray:
    return np.array([len(x.encode()) for x in words], dtype=np.int64)


class Landmarks:
    def __init__(self, words: list[str]):
        self.words, self.norm = words, _norm(_lengths(words))
        w, c, v = _triples(words)
        self.used, code = np.unique(c, return_inverse=True)
        self.phi = np.zeros((len(self.used) + 1, len(words)), np.float32)
        np.add.at(self.phi, (code, w), v.astype(np.float32))
        self.phi[:, :] /= self.norm
        gram = self.kernel(words)
        value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(len(words)))
        self.map = vector / np.sqrt(np.maximum(value, 1e-6))

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for lo in range(0, len(words), 400):
            part = words[lo:lo + 400]
            w, c, v = _triples(part)
            k = np.minimum(np.searchsorted(self.used, c), len(self.used) - 1) if len(self.used) else c * 0
            hit = np.flatnonzero(self.used[k] == c) if len(self.used) else np.empty(0, np.int64)
            by = hit[np.argsort(w[hit], kind="stable")]
            if len(by):
                rows, first = np.unique(w[by], return_index=True)
                sums = np.add.reduceat(self.phi[k[by]] * v[by, None].astype(np.float32), first, axis=0)
                out[lo + rows] = sums
        return out / _norm(_lengths(words))[:, None]

    def features(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.map

    def fold(self, weight: np.ndarray) -> np.ndarray:
        """One weight per triple: the decision is linear in kernel values."""
        table = np.zeros(SYMBOLS ** 3, np.float32)
        table[self.used] = self.phi[:len(self.used)] @ (self.map @ weight)
        return table


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-6, steps: int = 12) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the active rows."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    reg = ridge * np.eye(z.shape[1])
    reg[-1, -1] = 1e-8
    w = np.zeros(z.shape[1])
    cost = cost / cost.sum()
    for _ in range(steps):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        new = np.linalg.solve(reg + (za * ca[:, None]).T @ za, (za * ca[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            w = new
            break
        w = new
    return w[:-1], float(w[-1])


def _evidence(pos: Counter, neg: Counter, p: int, n: int) -> dict:
    """Signed z-score of log-odds for everything seen in toxic documents (counts are of documents)."""
    return {k: float((np.log((c + .5) / (p + 1.0)) - np.log((neg[k] + .5) / (n + 1.0)))
                     / np.sqrt(1 / (c + .5) + 1 / (neg[k] + .5))) for k, c in pos.items()}


def _plain(word: str) -> str:
    """A word without signs around it, ASCII lower case."""
    return word.lower().strip(".,;:!?|'\"()[]{}<>-_*")


def train(texts: list[str], toxic: list[int], prior: float, landmarks: int = 192, rounds: int = 4) -> Model:
    """Fit kernel SVM and calibration on labelled documents' sentences."""
    empty = np.zeros(1, np.float32)
    if not texts or not 0 < sum(toxic) < len(toxic):
        p = min(max(0.5 * prior, 1e-6), 1 - 1e-6)
        return Model(empty, 0.0, 0.0, float(np.log(p / (1 - p))))
    rng = random.Random(7)
    sentences: list[list[str]] = []                 # toxic ones; clean sentences count through their words
    words_in, grams_in = (Counter(), Counter()), (Counter(), Counter())
    names: dict[str, str] = {}
    for text, t in zip(texts, toxic):
        seen: set = set()
        for part in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            words = [names.setdefault(x, x) for x in map(_plain, part.split()) if 2 < len(x) <= LONG]
            if words:
                seen.update(words)
                if t:
                    sentences.append(words)
        words_in[t].update(seen)
        grams_in[t].update({x[i:i + 4] for x in seen for i in range(len(x) - 3)})
    p, n = sum(toxic), len(toxic) - sum(toxic)
    by_word, by_gram = _evidence(words_in[1], words_in[0], p, n), _evidence(grams_in[1], grams_in[0], p, n)

    def telling(x: str) -> float:
        return max([by_word.get(x, -9.0)] + [by_gram.get(x[i:i + 4], -9.0) for i in range(len(x) - 3)])
    score = {x: telling(x) for x in words_in[1]}
    clean_set = set(words_in[0])
    clean = sorted(clean_set)
    del words_in, grams_in, names, by_word, by_gram
    # a toxic sentence speaks through its most telling word, if that word tells anything
    witness: Counter = Counter()
    for words in sentences:
        best = max(words, key=score.__getitem__)
        if score[best] >= 3.0 and best not in clean_set:
            witness[best] += 1
    if not witness:                                 # no word tells the classes apart
        witness.update(max(words, key=score.__getitem__) for words in sentences)
    chosen = [x for x, _ in witness.most_common(landmarks // 2)]
    marks = Landmarks(chosen + rng.sample(clean, min(len(clean), landmarks - len(chosen))))
    bad = list(witness)
    good = rng.sample(clean, min(len(clean), 6000))
    pool = pa.array(clean, pa.large_string())
    raw, offs = textops.text_bytes(pool)
    pool_spans = Spans(_SYMBOL[raw], offs[:-1], offs[1:], np.arange(len(clean)))
    table, bias = empty, 0.0
    for _ in range(rounds):
        x = marks.features(bad + good)
        y = np.array([1.0] * len(bad) + [-1.0] * len(good))
        cost = np.array([0.5 * (1 + np.log(witness[b])) / len(bad) for b in bad] + [0.5 / len(good)] * len(good))
        weight, bias = _svm(x, y, cost)
        table = marks.fold(weight)
        value = margins(pool_spans, table, bias) if clean else np.empty(0)
        hard = np.argsort(-value)[:2000]
        good = sorted(set(good) | {clean[i] for i in hard if value[i] > -1})
    # calibration on whole documents: logistic in the highest margin, classes weighted to the prior
    top = np.full(len(texts), FLOOR)
    for lo in range(0, len(texts), 64):
        s = spans_of(*textops.text_bytes(pa.array(texts[lo:lo + 64], pa.large_string())))
        np.maximum.at(top, lo + s.row, margins(s, table, bias))
    y = np.array(toxic, float)
    cost = np.where(y > 0, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    z, w = np.stack([top, np.ones(len(y))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w)))
        grad = z.T @ (cost * (p - y)) + 1e-6 * w
        hess = (z * (cost * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return Model(table, bias, max(float(w[0]), 1e-3), float(w[1]))


# ---- Spark ----------------------------------------------------------------------

def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 20_000) -> Model:
    """Model of labelled rows that are not held out; the sample is bounded by its parameters."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.when(F.col("toxic") > 0, 1.0).otherwise(0.0))).first()[0]
    # twice the bound is drawn, since some rows have no text or one longer than max_chars
    picked = [known.where(c).orderBy(F.xxhash64("doc_id")).limit(2 * per_class) for c in ("toxic > 0", "toxic <= 0")]
    sample = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where(
        F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(sample), "doc_id").select(
        "text", "toxic", F.xxhash64("doc_id").alias("h")).where("text <> ''")
    table = rows.orderBy("h", "text").limit(4 * per_class).toArrow()
    got: dict[int, list[str]] = {0: [], 1: []}
    for text, toxic in zip(table.column("text").to_pylist(), table.column("toxic").to_pylist()):
        side = got[1 if toxic > 0 else 0]
        if len(side) < per_class:
            side.append(text)
    return train(got[1] + got[0], [1] * len(got[1]) + [0] * len(got[0]), float(share or 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` columns and ``score`` (0 to 1); map-only."""
    at, schema = docs.columns.index("text"), docs.drop("score").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, at):
                cols = [c for c, n in zip(part.columns, part.schema.names) if n != "score"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(model.rows(part.column(at)))], names=schema.names)
    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score under ``limit``, all columns unchanged; map-only."""
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, at):
                yield part.filter(pa.array(model.rows(part.column(at)) < limit))
    return docs.mapInArrow(run, schema)
