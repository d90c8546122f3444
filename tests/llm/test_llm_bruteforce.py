"""Registered queries against plain brute force over whole tables (sf0.001)."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lectern.llm import pii_crf
from lectern.llm.queries import word_bpe_path
from lectern.llm.suffix_array import common_prefixes, suffix_array

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s)


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def run(spark, name, key="doc_id"):
    got = QUERIES[name](spark, SF).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def test_op1(spark):
    talks = defaultdict(list)
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    talks[-7] = [(i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    got = run(spark, "op1_chat_windows", "conv_id")
    assert set(got) == set(talks)
    for k, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert tuple(got[k][:5]) == (
            k, len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op2(spark, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe_path())
    got, start = run(spark, "op2_token_shards"), 0
    for k in sorted(docs):
        ids = tok.encode(docs[k], add_special_tokens=False).ids + [2]
        assert tuple(got[k]) == (k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op3(spark, docs):
    got, first = run(spark, "op3_suffix_dedup"), {}
    data = {k: docs[k].encode() for k in sorted(docs)}
    for k, b in data.items():
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], k)
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < k:
                gone[i:i + 50] = b"\1" * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone) if not g)
        assert tuple(got[k]) == (k, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for i in range(400):
        t = rng.integers(0, 1 + i % 4, rng.integers(0, 40)) if i % 5 else np.repeat(rng.integers(0, 1500, 8), 4)
        sa = suffix_array(t)
        assert list(sa) == sorted(range(len(t)), key=lambda j: tuple(t[j:]))
        if len(t):
            p = common_prefixes(t, sa, len(t) - np.arange(len(t)))
            for r in range(1, len(t)):
                a, b = t[sa[r]:], t[sa[r - 1]:]
                m = min(len(a), len(b))
                same = np.flatnonzero(np.append(a[:m] != b[:m], True))[0]
                assert p[sa[r]] == same


def test_op4_learns_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [k for k in toxic if got[k]["held_out"]]
    pos, neg = [got[k]["score"] for k in held if toxic[k]], [got[k]["score"] for k in held if not toxic[k]]
    assert np.mean(np.array(pos)[:, None] > np.array(neg)[None, :]) > 0.7      # the small table has noisy labels
    assert np.mean(np.array(neg) >= 0.5) < 0.05


def test_op6(spark, docs):
    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
                ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
                ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and luhn(d)),
                ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15)]
    got = run(spark, "op6_pii_crf")
    tricky = "a@b.c@d.e 1.2.3.4.5.6.7.8 999.1.1.1 +1 +2 (030) 12-34-56 4111 1111 1111 1111 x@@y.z .@a.b é@a.b.c 00255.1.2.3"
    for text, spans in [(docs[k], got[k]) for k in docs] + [(tricky, None)]:
        base = [f"{kind}:{m.start()}:{m.end()}" for kind, p, ok in patterns for m in re.finditer(p, text)
                if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
        if spans is None:
            assert [f"{pii_crf.KINDS[k]}:{s}:{e}" for k, s, e in pii_crf.pattern_spans(text)] == base
        else:
            assert spans["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert set(base) <= set(spans["spans"].split(",")) | {""}


def test_crf_finds_forms_beside_the_patterns():
    crf = pii_crf.train(list(pii_crf.LABELLED))
    text = "reach sam (at) site (dot) example or dial (305) 555-0142 today, version 2.0 of 1999"
    seqs = pii_crf.sequences(text)
    paths = crf.decode([[text[a:b] for a, b in s] for s in seqs])
    found = {(pii_crf.KINDS[k], text[s:e]) for k, s, e in pii_crf.added_spans(text, seqs, paths, [])}
    assert ("phone", "(305) 555-0142") in found and not any("1999" in t or "2.0" in t for _, t in found)


def test_op7(spark, docs):
    got = run(spark, "op7_mixing_lm")
    tokens = {k: words(fold(t)) + [None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    count = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(count.values()), len(count)
    for k, ws in tokens.items():
        g = got[k]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[k], len(ws), sum(count[w] > 0 for w in ws), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    assert np.mean([g["bits_per_byte"] for k, g in got.items() if held[k] and docs[k]]) < 4


def test_op8(spark, docs):
    got, sets = run(spark, "op8_ngram_join"), {}
    for k, t in docs.items():
        w = words(fold(t))
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1:]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for k in ks:
        assert tuple(got[k]) == (k, len(sets[k]), find(k))


def test_op9(spark, docs):
    split = lambda s: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", fold(s)) if w]
    bag = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    weight = lambda s: sum(len(x.encode()) for x in s)
    items = [Counter(bag(split(r["text"]))) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = run(spark, "op9_benchmark_overlap")
    for k, t in docs.items():
        sh, hits = bag(split(t)), 0
        for item in items:
            m, total = sum(item.values()), sum(weight(s) * c for s, c in item.items())
            if not any(s in item for s in sh):
                continue
            best = 0.0
            for a in range(max(1, len(sh) - m + 1)):
                win = Counter(sh[a:a + m])
                both = sum(min(c, item[s]) * weight(s) for s, c in win.items())
                best = max(best, both / (total + sum(weight(s) * c for s, c in win.items()) - both))
            hits += best >= 0.8
        assert got[k]["n_items"] == hits and got[k]["contaminated"] == (hits > 0)


def test_pipeline_rows(spark, docs):
    rows = entry.queries()["pipeline"](spark, SF).collect()
    assert 0 < len(rows) < len(docs) and [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == sorted(r["doc_id"] for r in rows)
    # the plain decisions that need no model: groups of similar documents and benchmark items
    comp = run(spark, "op8_ngram_join")
    dirty = {k for k, r in run(spark, "op9_benchmark_overlap").items() if r["contaminated"]}
    kept = {r["doc_id"] for r in rows}
    assert not kept & dirty
    assert len({comp[k]["component_id"] for k in kept}) == len(kept)
