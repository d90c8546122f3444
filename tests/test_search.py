"""Exact top-k search (J1, J2, F5, F6, W1-W3) against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import search


def brute(corpus, questions, default_k=5, decimals=None):
    """Python reference: score every pair, sort by score desc then key, cut per question."""
    out = []
    for qid, qv, k, qdoc in questions:
        k = default_k if k is None else k
        scored = []
        for doc, cid, text, cv in corpus:
            if cv is None or len(cv) == 0 or (qdoc is not None and doc != qdoc):
                continue
            n = min(len(qv), len(cv))
            dot = float(np.dot(qv[:n], cv[:n]))
            na, nb = np.sqrt(np.dot(qv, qv)), np.sqrt(np.dot(cv, cv))
            s = 0.0 if na == 0 or nb == 0 else dot / (na * nb)
            if decimals is not None:
                s = round(s, decimals)
            scored.append((-s, doc, cid, s))
        scored.sort()
        for rank, (_, doc, cid, s) in enumerate(scored[:max(k, 0)], 1):
            out.append((qid, rank, doc, cid, round(s, 9)))
    return sorted(out)


def run(spark, corpus, questions, **kw):
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>")
    q = spark.createDataFrame(questions, "query_id string, embedding array<double>, top_k int, doc_id long")
    hits = search.exact_search(c, q, **kw).collect()
    return sorted((h.query_id, h.rank, h.doc_id, h.chunk_id, round(h.score, 9)) for h in hits)


def fixture(seed=0, n=60, dim=6):
    rng = np.random.default_rng(seed)
    corpus = []
    for i in range(n):
        v = rng.integers(-3, 4, dim).astype(float).tolist()
        corpus.append((i // 7, i % 7, f"t{i}", v))
    corpus.append((99, 0, "zero", [0.0] * dim))
    corpus.append((99, 1, "empty", []))
    corpus.append((99, 2, "null", None))
    corpus.append((99, 3, "short", [1.0, 2.0]))
    corpus.append((100, 0, "dup-a", corpus[0][3]))       # exact duplicate vector: a tie
    corpus.append((100, 1, "dup-b", corpus[0][3]))
    return corpus


def test_against_brute_force(spark):
    corpus = fixture()
    qs = [("q0", corpus[0][3], 5, None), ("q1", [1, 0, 0, 0, 0, 0], 3, None),
          ("zero", [0] * 6, 4, None), ("k0", [1] * 6, 0, None), ("neg", [1] * 6, -2, None),
          ("big", [1, 2, 3, 4, 5, 6], 1000, None), ("doc", [1, -1, 1, -1, 1, -1], 5, 3),
          ("nodoc", [1] * 6, 5, 12345), ("dflt", [2, 1, 0, 0, 1, 2], None, None),
          ("longer", [1, 2, 3, 4, 5, 6, 7, 8], 5, None)]
    qs = [(a, [float(x) for x in v], k, d) for a, v, k, d in qs]
    assert run(spark, corpus, qs) == brute(corpus, qs)


def test_blocks_give_the_same_result(spark):
    corpus = fixture(1)
    qs = [(f"q{i}", corpus[i][3], 5, None) for i in range(20)]
    one = run(spark, corpus, qs)
    many = run(spark, corpus, qs, max_block_bytes=200)     # several broadcast blocks
    assert one == many == brute(corpus, qs)


def test_float_vectors(spark):
    rng = np.random.default_rng(3)
    corpus = [(i, 0, "t", rng.standard_normal(16).tolist()) for i in range(80)]
    qs = [(f"q{i}", rng.standard_normal(16).tolist(), 5, None) for i in range(7)]
    assert run(spark, corpus, qs) == brute(corpus, qs, decimals=12)


def test_topk_single(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (0, 3, 0.9), (2, 0, 0.1)],
                               "doc_id long, chunk_id int, score double")
    got = [(r.doc_id, r.chunk_id) for r in search.topk_single(df, 2).collect()]
    assert got == [(0, 3), (1, 1)]
    assert search.topk_single(df, 0).count() == 0


def test_plan_has_no_cross_join_and_limits_before_shuffle(spark):
    corpus = fixture()
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0] * 6, 5, None)], "query_id string, embedding array<double>, top_k int, doc_id long")
    plan = search.exact_search(c, q)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "MapInArrow" in plan


def test_blank_questions_are_rejected(spark):
    from lectern.plans import retrieval
    qs = spark.createDataFrame([("a", " what? ", None), ("b", " 　\n", 3), ("c", None, 2)],
                               "query_id string, question string, top_k int")
    valid, rejected = retrieval.validate_questions(qs)
    assert [(r.query_id, r.question, r.top_k) for r in valid.collect()] == [("a", "what?", 5)]
    assert sorted(r.query_id for r in rejected.collect()) == ["b", "c"]


def test_hits_do_not_depend_on_partitions(spark):
    """Whole and fractional vectors, copies and one zero vector: any split of the corpus gives the same hits."""
    rng = np.random.default_rng(11)
    base = rng.random(12).tolist()
    corpus = [(i // 10, i % 10, "t", base if i % 2 else rng.integers(0, 3, 12).astype(float).tolist()) for i in range(3000)]
    corpus += [(900 + i, 0, "t", rng.random(12).tolist()) for i in range(30)] + [(999, 0, "t", [0.0] * 12)]
    qs = [(f"q{i}", rng.random(12).tolist() if i % 2 else rng.integers(0, 3, 12).astype(float).tolist(), 1 + i % 6, None)
          for i in range(15)]
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>")
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>, top_k int, doc_id long")
    one, many = (sorted(tuple(r) for r in search.exact_search(c.repartition(n), q).collect()) for n in (1, 40))
    assert one == many and len(one) == sum(1 + i % 6 for i in range(15))


def test_repeated_null_keys_and_empty_vectors(spark):
    corpus = [(1, 0, "a", [1.0, 0.0]), (1, 0, "b", [1.0, 0.0]), (None, None, "c", [0.9, 0.1]), (2, 0, "d", [])]
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0], 3), ("y", [], 2)], "query_id string, embedding array<double>, top_k int")
    for n in (1, 4):
        got = search.exact_search(c.repartition(n), q).collect()
        assert sorted((r.rank, r.text) for r in got if r.query_id == "x" and r.rank == 3) == [(3, "c")]
        assert {r.text for r in got if r.query_id == "x"} == {"a", "b", "c"}
        assert [r.score for r in got if r.query_id == "y"] == [0.0, 0.0]


def test_integer_vectors_score_bit_exact(spark):
    """Hash-embedder style counts: scores equal dot / (sqrt(a) * sqrt(b)) to the last bit."""
    rng = np.random.default_rng(21)
    corpus = [(i, 0, "t", rng.integers(0, 4, 32).astype(float).tolist()) for i in range(300)]
    qs = [(f"q{i}", rng.integers(0, 4, 32).astype(float).tolist(), 5, None) for i in range(9)]
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>")
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>, top_k int, doc_id long")
    vec = {d: np.array(v) for d, _, _, v in corpus}
    qv = {k: np.array(v) for k, v, _, _ in qs}
    for h in search.exact_search(c, q).collect():
        a, b = qv[h.query_id], vec[h.doc_id]
        want = float(a @ b) / (np.sqrt(float(a @ a)) * np.sqrt(float(b @ b)))
        assert h.score == want


def test_self_search_finds_itself_first(spark):
    from lectern.session import read_table
    from conftest import SF_SMALL
    vecs = read_table(spark, SF_SMALL, "embeddings")
    qs = vecs.select(F.col("vec_id").alias("query_id"), "embedding")
    top = search.exact_search(vecs, qs, keys=("vec_id",), payload=(), doc_filter=None).where("rank = 1")
    rows = top.collect()
    assert len(rows) == vecs.count()
    # the best match is the vector itself (or an exact copy with a smaller id), at cosine 1
    assert all(abs(r.score - 1.0) < 1e-9 and r.vec_id <= r.query_id for r in rows)


def test_non_integer_top_k_is_rejected(spark):
    from lectern.plans import retrieval
    qs = spark.createDataFrame([("a", "q?", "3"), ("b", "q?", "three"), ("c", "q?", None)],
                               "query_id string, question string, top_k string")
    valid, rejected = retrieval.validate_questions(qs)
    assert sorted((r.query_id, r.top_k) for r in valid.collect()) == [("a", 3), ("c", 5)]
    assert [(r.query_id, r.error) for r in rejected.collect()] == [("b", "top_k is not a whole number")]


def test_large_document_ids_scope_exactly(spark):
    big = 2 ** 53 + 1                       # not representable as float64
    corpus = [(big, 0, "a", [1.0, 0.0]), (big - 1, 0, "b", [1.0, 0.0]), (big + 2, 0, "c", [0.0, 1.0])]
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0], 5, big), ("y", [1.0, 0.0], 5, None)],
                              "query_id string, embedding array<double>, top_k int, doc_id long")
    got = sorted((r.query_id, r.doc_id) for r in search.exact_search(c, q).collect())
    assert got == [("x", big), ("y", big - 1), ("y", big), ("y", big + 2)]


def test_scoped_questions_over_a_hot_document(spark):
    """A document with most of the chunks, asked about by most questions, next to open questions."""
    rng = np.random.default_rng(11)
    corpus = [(7 if i < 5000 else i % 20, i, f"t{i}", rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(7000)]
    qs = [(f"q{i}", rng.integers(-2, 3, 5 + i % 2).astype(float).tolist(), [None, 3, 0, 40][i % 4],
           7 if i % 3 else [None, 12, 999][i % 9 // 3]) for i in range(60)]
    assert run(spark, corpus, qs) == brute(corpus, qs)
    only = [q for q in qs if q[3] is not None]
    assert run(spark, corpus, only) == brute(corpus, only)


def test_scoped_plan_has_no_product_and_collects_nothing(spark):
    corpus = spark.createDataFrame(fixture(), "doc_id long, chunk_id int, text string, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0] * 6, 2, 3)], "query_id string, embedding array<double>, top_k int, doc_id long")
    plan = search.exact_search(corpus, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert re.search(r"(SortMerge|BroadcastHash)Join \[_scope", plan)


def test_blocks_are_cut_and_sorted():
    import pyarrow as pa
    from lectern.operators import blocks
    by = pa.array([1, 1, 1, 1, 1, 4, 9, 9])
    mat = np.arange(16, dtype=np.float32).reshape(8, 2)
    names = ["d", "n", "width", "vectors", "norms", "rows"]
    out = blocks.pack_runs(by, mat, np.arange(8.0), {"c": pa.array(range(8))}, names, rows=2)
    assert out.column("d").to_pylist() == [1, 1, 1, 4, 9] and out.column("n").to_pylist() == [2, 2, 1, 1, 2]
    got = np.concatenate([blocks._matrix(out, r, "")[0] for r in range(5)])
    assert (got == mat).all() and [len(x) for x in out.column("rows").to_pylist()] == [2, 2, 1, 1, 2]


def test_a_task_with_many_batches(spark):
    rng = np.random.default_rng(13)
    corpus = [(i, 0, "t", rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(25_000)]
    qs = [("a", [1.0, 2.0, 3.0], 4, None), ("b", [0.5, -1.0, 0.0], 4, None)]
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>").coalesce(1)
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>, top_k int, doc_id long")
    hits = search.exact_search(c, q).collect()
    got = sorted((h.query_id, h.rank, h.doc_id, h.chunk_id, round(h.score, 9)) for h in hits)
    assert got == brute(corpus, qs, decimals=12)


def test_a_task_stays_small_with_many_questions():
    """Candidates of a batch are dropped while it is scored, not after it (before: 32 bytes for each
    question, hit and 200 vectors at once)."""
    import tracemalloc
    from types import SimpleNamespace
    import pyarrow as pa
    from pyspark.sql import types as T
    rng = np.random.default_rng(17)
    vec = lambda m: pa.array(list(m), pa.list_(pa.float32()))
    qs, items = rng.standard_normal((20_000, 8)).astype(np.float32), rng.standard_normal((6_000, 8)).astype(np.float32)
    tbl = pa.table({"q": pa.array(np.arange(len(qs))), "v": vec(qs), "_k": pa.array(np.full(len(qs), 5), pa.int32())})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(items))), vec(items)], names=["id", "v"])
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("_k", T.IntegerType())])
    run = search._score_partition(SimpleNamespace(value=search._Block(tbl, "q", "v")), ("id",), (), "v", schema)
    tracemalloc.start()
    out = pa.Table.from_batches(list(run([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 5 * len(qs) and peak < 64 << 20, peak
    some = rng.choice(len(qs), 200, replace=False)
    unit = lambda m: m / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    best = np.argsort(-(unit(qs[some]) @ unit(items).T), axis=1)[:, :5]
    got = {int(q): set() for q in some}
    for q, i in zip(out["q"].to_pylist(), out["id"].to_pylist()):
        if q in got:
            got[q].add(i)
    assert [got[int(q)] for q in some] == [set(b.tolist()) for b in best]


def test_blocks_by_hits_carry_payload_of_repeated_and_null_keys(spark):
    """Many blocks: winners are rows of the stored corpus, whatever their keys; scoped questions beside them."""
    corpus = fixture(4) + [(1, 0, "again", [0.5, 1.0, 0.25, 2.0, 1.0, 1.5]), (None, None, "no key", [0.3, 1.0, 2.0, 0.1, 1.0, 0.0])]
    c = spark.createDataFrame(corpus, "doc_id long, chunk_id int, text string, embedding array<double>")
    qs = [(f"q{i}", corpus[i][3], [5, None, 70, 0][i % 4], 3 if i % 6 == 5 else None) for i in range(25)] + [("q1", corpus[9][3], 5, None)]
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>, top_k int, doc_id long")
    one, many = (sorted((r.query_id, r["rank"], r.text, r.score) for r in search.exact_search(c, q, **kw).collect())
                 for kw in ({}, {"max_block_hits": 30}))
    assert one == many and {"again", "no key"} <= {r[2] for r in many}


def test_a_joined_task_sends_out_what_it_cannot_hold(spark, monkeypatch):
    """Winners of many questions leave a task in parts (before: all were held until its end)."""
    import pyarrow as pa
    from lectern.operators import blocks
    held = []
    rng = np.random.default_rng(23)
    schema = "doc long, id long, embedding array<float>"
    c = spark.createDataFrame([(1, i, rng.standard_normal(4).tolist()) for i in range(500)], schema)
    q = spark.createDataFrame([(1, i, rng.standard_normal(4).tolist()) for i in range(3000)], schema).select(
        "doc", F.col("id").alias("query_id"), F.lit(5).alias("_k"), "embedding")
    items = blocks.pack(c, "doc", ["id"], ["id"], "embedding")
    asked = blocks.pack(q, "doc", ["query_id"], ["query_id", "_k"], "embedding", prefix="q_", rows=100)
    joined = asked.join(items, "doc").drop("doc").toArrow()
    monkeypatch.setattr(blocks, "KEPT_ROWS", 2000)
    monkeypatch.setattr(blocks, "_beaten", lambda t, *a, f=blocks._beaten: (held.append(t.num_rows), f(t, *a))[1])
    monkeypatch.setattr(type(items), "mapInArrow", lambda self, f, schema: f)
    run = blocks.score_blocks(items, asked, "doc", "query_id", ("id",), (), 1)
    out = pa.Table.from_batches(list(run(joined.combine_chunks().to_batches())))
    assert max(held) < 20_000 and len(set(out["query_id"].to_pylist())) == 3000


def test_winners_gather_keys_of_ties_only(monkeypatch):
    """Scores alone rank most candidates; keys decide among those of the last place's score, like a full sort."""
    rng = np.random.default_rng(5)
    n, nq = 4000, 40
    keys = ("doc_id", "chunk_id")
    tables = [pa.table({"doc_id": rng.integers(0, 30, 300), "chunk_id": rng.integers(0, 3, 300)}) for _ in range(3)]
    pairs = rng.permutation(nq * 900)[:n]
    q, bt, row = pairs // 900, pairs % 900 // 300, pairs % 300
    score = np.where(q < 20, rng.random(n), rng.integers(0, 4, n) / 4)      # the second half is full of ties
    k = rng.integers(1, 9, nq)
    k[39] = 5000                                                              # more places than candidates
    gathered = []
    plain = search._gather
    monkeypatch.setattr(search, "_gather", lambda t, b, r, name: (gathered.append(len(r)), plain(t, b, r, name))[1])
    cut = [slice(0, 1000), slice(1000, n)]
    got = search._select_winners(tables, [(q[c], bt[c], row[c], score[c]) for c in cut], keys, k)
    assert 0 < max(gathered) <= (q >= 20).sum()
    key = [tuple(tables[b].column(c)[int(r)].as_py() for c in keys) for b, r in zip(bt, row)]
    for one in range(nq):
        want = sorted((-score[i], key[i]) for i in np.flatnonzero(q == one))[:k[one]]
        mine = [(-s, tuple(tables[b].column(c)[int(r)].as_py() for c in keys))
                for s, b, r in zip(got[3][got[0] == one], got[1][got[0] == one], got[2][got[0] == one])]
        assert sorted(mine) == want and [m[0] for m in mine] == [w[0] for w in want]


def _count_vectors(rng, n, width=24):
    """Vectors of counts; among them empty ones, some with counts over a byte, some that are no counts."""
    m = rng.poisson(0.4, (n, width)).astype(np.float32)
    m[::17] = 0
    m[5::29, 3] = 200 + np.arange(len(m[5::29]))
    m[7::31, 4] -= 0.25
    m[9::37, 5] = -3
    return m


def _scored(questions, items, k=5):
    """Hits ``(question, item, score)`` of one task over two batches."""
    from types import SimpleNamespace
    from pyspark.sql import types as T
    vec = lambda m: pa.array(list(m), pa.list_(pa.float32()))
    tbl = pa.table({"q": pa.array(np.arange(len(questions))), "v": vec(questions), "_k": pa.array(np.full(len(questions), k), pa.int32())})
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(len(items))), vec(items)], names=["id", "v"])
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("_k", T.IntegerType())])
    block = search._Block(tbl, "q", "v")
    run = search._score_partition(SimpleNamespace(value=block), ("id",), (), "v", schema)
    out = pa.Table.from_batches(list(run([whole.slice(0, 1500), whole.slice(1500)])))
    return block, sorted(zip(out["q"].to_pylist(), out["id"].to_pylist(), out["score"].to_pylist()))


def test_counts_are_multiplied_as_bytes(monkeypatch):
    """Questions of small counts are held as bytes and multiplied as such; same hits as by floats and by brute force."""
    pytest.importorskip("onnxruntime")
    from lectern.operators import whole
    rng = np.random.default_rng(29)
    questions, items = rng.poisson(0.5, (1300, 24)).astype(np.float32), _count_vectors(rng, 2600)
    questions[3] = 0
    pairs = []
    plain = whole.scaled_product
    monkeypatch.setattr(whole, "scaled_product", lambda a, b, t: pairs.append(len(a) * b.shape[1]) or plain(a, b, t))
    block, got = _scored(questions, items)
    assert block.matrix.dtype == np.uint8 and sum(pairs) == len(questions) * len(items)
    monkeypatch.setattr(whole, "available", lambda: False)
    assert _scored(questions, items)[1] == got and sum(pairs) == len(questions) * len(items)
    q, c = questions.astype(float), items.astype(float)
    by = np.multiply.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1)))
    scores = np.divide(q @ c.T, by, out=np.zeros_like(by), where=by > 0)
    scores = np.where((items == np.rint(items)).all(axis=1), scores, np.round(scores, 12))      # counts score exactly
    best = [sorted(range(len(c)), key=lambda i, s=s: (-s[i], i))[:5] for s in scores]
    assert [(a, b) for a, b, _ in got] == sorted((i, j) for i, five in enumerate(best) for j in five)
    # questions that are no small counts go by floats
    for other in (questions + 0.5, -questions, questions * 200):
        pairs.clear()
        block, _ = _scored(other[:40], items)
        assert block.matrix.dtype == np.float32 and not pairs


def test_products_of_bytes_are_exact():
    pytest.importorskip("onnxruntime")
    from lectern.operators import whole
    assert whole.available()
    rng = np.random.default_rng(31)
    for m, w, n in ((1, 1, 1), (3, 256, 5), (130, 300, 70), (64, 7, 1)):
        a, b = rng.integers(0, 128, (m, w)).astype(np.uint8), rng.integers(-127, 128, (w, n)).astype(np.int8)
        assert (whole.scaled_product(a, b, np.ones(n, np.float32)) == a.astype(np.int64) @ b.astype(np.int64)).all()
        half = np.full(n, 0.5, np.float32)
        assert (whole.scaled_product(a, b, half) == (a.astype(np.int64) @ b.astype(np.int64)) / 2).all()


def test_blocks_share_few_scan_tasks(spark, monkeypatch):
    """Scans of many blocks take no more tasks than keep the cores busy: every task gives hits of its own for each question."""
    rng = np.random.default_rng(37)
    corpus = spark.createDataFrame([(i, 0, "t", rng.poisson(0.5, 8).astype(float).tolist()) for i in range(900)],
                                   "doc_id long, chunk_id int, text string, embedding array<double>").repartition(60)
    asked = spark.createDataFrame([(f"q{i}", rng.poisson(0.5, 8).astype(float).tolist()) for i in range(30)],
                                  "query_id string, embedding array<double>")
    one = sorted(map(tuple, search.exact_search(corpus, asked).collect()))
    tasks = []
    monkeypatch.setattr(search, "_scan", lambda c, blocks, *a, f=search._scan: (
        tasks.append(c._jdf.queryExecution().toRdd().getNumPartitions()), f(c, blocks, *a))[1])
    monkeypatch.setattr(search, "TASKS_A_CORE", 1)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))                  # a split for every file
    try:
        many = sorted(map(tuple, search.exact_search(corpus, asked, max_block_hits=30).collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert many == one and len(tasks) == 2
    assert max(tasks) <= max(spark.sparkContext.defaultParallelism, -(-60 // search.SPLITS_A_TASK)) < 60


def test_workers_give_memory_back(monkeypatch):
    """The tasks of chunking, embedding and scoring give their memory back when they end, also early."""
    from types import SimpleNamespace
    from lectern.operators import chunking, embedding, worker
    given = []
    monkeypatch.setattr(worker, "give_back", lambda: given.append(1))
    docs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text. " * 40])], names=["doc_id", "text"])
    chunks = list(chunking._chunk_batches(["doc_id"], "text", 500, 50)(iter([docs])))
    assert len(given) == 1 and sum(c.num_rows for c in chunks) == 2
    early = embedding._hash_batches("text", "embedding", 16, None)(iter(chunks))
    assert next(early).num_rows == 2
    early.close()
    assert len(given) == 2
    search._score_partition(SimpleNamespace(value=SimpleNamespace(k=[])), ("doc_id",), (), "embedding", SimpleNamespace(fields=[]))
    assert len(given) == 2 and not list(search._score_partition(
        SimpleNamespace(value=SimpleNamespace(k=[])), ("doc_id",), (), "embedding", SimpleNamespace(fields=[]))(iter([])))
    assert len(given) == 3
