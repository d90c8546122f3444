"""String kernel, its folded weights and the SVM against plain Python."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import textops, toxicity


def symbols(word):
    return [int(toxicity._SYMBOL[b]) for b in word.encode()]


def triples(sym):
    """{triple: summed decay} of every subsequence of three symbols within SPAN places."""
    out = {}
    for i, j, k in itertools.combinations(range(len(sym)), 3):
        if k - i < toxicity.SPAN and sym[i] and sym[j] and sym[k]:
            key = (sym[i], sym[j], sym[k])
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
    return out


def norm(length):
    total = sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in itertools.combinations(range(length), 3)
                if k - i < toxicity.SPAN)
    return max(total, 1.0) ** 0.5


def kernel(a, b):
    x, y = triples(symbols(a)), triples(symbols(b))
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / norm(len(a.encode())) / norm(len(b.encode()))


def test_kernel_and_fold():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeIO013$") for _ in range(rng.randint(3, 14))) for _ in range(24)]
    words += ["ab", "é̇ab", "a.b.c.d"]
    marks = toxicity.Landmarks(sorted(set(words[:9])))
    want = np.array([[kernel(a, b) for b in marks.words] for a in words])
    assert np.allclose(marks.kernel(words), want, atol=1e-5)
    weight = np.array([rng.uniform(-1, 1) for _ in marks.words])
    raw, offs = textops.text_bytes(pa.array(words, pa.large_string()))
    spans = toxicity.Spans(toxicity._SYMBOL[raw], offs[:-1], offs[1:], np.arange(len(words)))
    got = toxicity.margins(spans, marks.fold(weight), 0.25)
    assert np.allclose(got, marks.features(words) @ weight + 0.25, atol=1e-3)


def windows(word):
    """A word, or its windows if it is long."""
    raw = word.encode()
    if len(raw) <= toxicity.LONG:
        return [raw]
    n = -(-(len(raw) - toxicity.WINDOW) // toxicity.STRIDE) + 1
    return [raw[k * toxicity.STRIDE:k * toxicity.STRIDE + toxicity.WINDOW] for k in range(n)]


@pytest.mark.parametrize("sizes", [(25,), (40,), (24, 25, 3), (5, 100, 7, 33, 1), (2000,), (10, 12)])
def test_long_words_are_their_windows_alone(sizes):
    rng = random.Random(sum(sizes))
    words = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in sizes]
    table = np.random.default_rng(5).normal(size=toxicity.SYMBOLS ** 3).astype(np.float32)

    def value(raw):
        got = triples([int(toxicity._SYMBOL[b]) for b in raw])
        s = toxicity.SYMBOLS
        return sum(v * table[a * s * s + b * s + c] for (a, b, c), v in got.items()) / norm(len(raw)) + 0.5
    # words of texts that touch in the byte stream as well
    texts = [" ".join(words), words[0], words[-1]]
    spans = toxicity.spans_of(*textops.text_bytes(pa.array(texts, pa.large_string())))
    got = toxicity.margins(spans, table, 0.5)
    for row, text in enumerate(texts):
        want = sorted(value(w) for x in text.split() for w in windows(x))
        assert np.allclose(sorted(got[spans.row == row]), want, atol=1e-3)


def test_svm_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0.7, 1, (40, 3)), rng.normal(-0.7, 1, (60, 3))])
    y, cost = np.array([1.0] * 40 + [-1.0] * 60), rng.uniform(0.5, 2, 100)
    w, b = toxicity._svm(x, y, cost, ridge=0.01, steps=50)

    def loss(w, b):
        gap = np.maximum(0, 1 - y * (x @ w + b))
        return (cost / cost.sum() * gap ** 2).sum() + 0.01 * (w ** 2).sum() + 1e-8 * b * b
    least = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(0, 1e-2, 3), b + rng.normal(0, 1e-2)) >= least - 1e-12
