"""Fingerprints of windows against a plain SimHash; long items in long documents stay within memory."""

import os
import subprocess
import sys
import textwrap

import numpy as np

from lectern.llm import decontaminate

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(sh, weight):
    out = 0
    for bit in range(64):
        if sum(int(w) if h >> bit & 1 else -int(w) for h, w in zip(sh, weight)) > 0:
            out |= 1 << bit
    return out


def test_fingerprints_of_windows():
    rng = np.random.default_rng(2)
    sh, wt = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2), rng.integers(1, 40, 60)
    begin = np.array([0, 5, 17, 59, 30, 12])
    end = np.array([60, 9, 50, 60, 31, 12])
    got = decontaminate.fingerprints(sh, wt, begin, end)
    assert got.tolist() == [plain([int(x) for x in sh[a:b]], wt[a:b]) for a, b in zip(begin, end)]
    none = np.empty(0, np.int64)
    assert len(decontaminate.fingerprints(sh, wt, none, none)) == 0


def test_long_items_take_linear_memory():
    """An item of 20,000 words, twice in a document of 100,000: less than 500 MB more."""
    script = textwrap.dedent("""
        import random, resource
        import pyarrow as pa
        from lectern.llm import decontaminate
        rng = random.Random(3)
        word = lambda: "".join(rng.choices("abcdefghij", k=6))
        item = " ".join(word() for _ in range(20_000))
        other = " ".join(word() for _ in range(20_000))
        index = decontaminate.ItemIndex([(7, item), (8, "five short words stand here now")])
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        found = index.search_rows(pa.array([" ".join([item, other, other[1000:], item, other]), other, None]))
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
        assert [index.ids[i] for i in found[0]] == [7] and found[0][0][0] == 1.0 and not found[1] and not found[2]
        assert grown < 500_000, grown
    """)
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120, env={**os.environ, "PYTHONPATH": ROOT})
