"""Stored inverted-file index (A1, A2) against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import ivf, search
from lectern.session import read_table

from conftest import SF_CHECK


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def brute(corpus, questions, cells, probes):
    """``{query: [(key, label, score)…]}`` of all vectors in the probed cells, best first."""
    keys = [c[0] for c in corpus if c[2] is not None and len(c[2])]
    labels = {c[0]: c[1] for c in corpus}
    x = np.array([c[2] for c in corpus if c[2] is not None and len(c[2])], float)
    home = np.argmax(np.round(unit(x) @ cells.T, 9), axis=1)
    out = {}
    for qid, v in questions:
        v = np.array(v, float)
        near = np.argsort(-np.round(unit(v[None])[0] @ cells.T, 9), kind="stable")[:probes]
        den = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
        score = np.round(np.divide(x @ v, den, out=np.zeros(len(x)), where=den > 0), 12)
        rows = [(-s, k) for s, k, h in zip(score, keys, home) if h in near]
        out[qid] = [(k, labels[k], -s) for s, k in sorted(rows)]
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((9, 6))
    corpus = [(i, i % 4, (base[i % 9] + 0.4 * rng.standard_normal(6)).tolist()) for i in range(400)]
    corpus += [(1000 + i, 7, base[0].tolist()) for i in range(250)]       # copies: one hot cell
    corpus += [(5000, 1, None), (5001, 1, []), (5002, None, [0.0] * 6)]
    df = spark.createDataFrame(corpus, "vec_id long, label int, embedding array<double>")
    path = str(tmp_path_factory.mktemp("ivf"))
    cells = ivf.fit_cells(df, ["vec_id"], 12, sample_rows=300)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # as if partitions were large
    ivf.build(df, path, cells, ["vec_id"], ["label"], probes=3, cell_file_rows=40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return corpus, df, path, cells


def asked(corpus, n=40):
    rng = np.random.default_rng(8)
    some = [c for c in corpus if c[2]][:: len(corpus) // n]
    return [(f"q{i}", (np.array(c[2]) + 0.1 * rng.standard_normal(6)).tolist()) for i, c in enumerate(some)]


@pytest.mark.parametrize("probes", [1, 3, 12])
def test_hits_are_the_best_of_the_probed_cells(spark, made, probes):
    corpus, _, path, cells = made
    questions = asked(corpus) + [("zero", [0.0] * 6)]
    q = spark.createDataFrame([(a, v, [5, None, 0, 300][i % 4]) for i, (a, v) in enumerate(questions)],
                              "query_id string, embedding array<double>, top_k int")
    want = brute(corpus, questions, cells, probes)
    got = {}
    for h in ivf.Index(spark, path, ["vec_id"], ["label"]).search(q, probes=probes).orderBy("query_id", "rank").collect():
        got.setdefault(h.query_id, []).append((h.vec_id, h.label, h.score))
        assert h.rank == len(got[h.query_id])
    for i, (a, _) in enumerate(questions):
        mine, his = got.get(a, []), want[a][:[5, 5, 0, 300][i % 4]]
        assert [x[:2] for x in mine] == [x[:2] for x in his]
        assert np.allclose([x[2] for x in mine], [x[2] for x in his], rtol=0, atol=1e-9)


def test_second_session_reads_the_index_by_its_folder(spark, made):
    corpus, _, path, cells = made
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "4")
    questions = asked(corpus, 5)
    q = other.createDataFrame(questions, "query_id string, embedding array<double>")
    index = ivf.Index(other, path, ["vec_id"], ["label"])
    assert np.allclose(index.cells, cells) and index.probes == 3 and index.sizes.sum() == 651
    got = {(h.query_id, h.rank): h.vec_id for h in index.search(q).collect()}
    want = brute(corpus, questions, cells, 3)
    assert got == {(a, i + 1): k for a in want for i, (k, _, _) in enumerate(want[a][:5])}


def test_hot_cell_is_several_files_and_only_probed_cells_are_read(spark, made):
    import glob
    _, _, path, _ = made
    sizes = {f.rsplit("cell=", 1)[1]: len(glob.glob(f + "/*.parquet")) for f in glob.glob(path + "/vectors/cell=*")}
    assert max(sizes.values()) > 3                       # 250 copies at 40 vectors a file
    q = spark.createDataFrame([("a", [1.0] * 6)], "query_id string, embedding array<double>")
    hits = ivf.Index(spark, path, ["vec_id"], ["label"]).search(q, probes=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("mode", ["post", "fill"])
def test_document_filter(spark, made, mode):
    corpus, _, path, cells = made
    questions = asked(corpus, 24)
    labels = [0, 1, 2, 3, 7, 99, None]
    q = spark.createDataFrame([(a, v, 4, labels[i % 7]) for i, (a, v) in enumerate(questions)],
                              "query_id string, embedding array<double>, top_k int, own int")
    want = brute(corpus, questions, cells, 3)
    got = {}
    hits = ivf.Index(spark, path, ["vec_id"], ["label"]).search(q, doc_filter="own", corpus_doc="label", filter_mode=mode)
    for h in hits.orderBy("query_id", "rank").collect():
        got.setdefault(h.query_id, []).append(h.vec_id)
        assert h.rank == len(got[h.query_id])
    for i, (a, _) in enumerate(questions):
        rows = want[a][:4] if mode == "post" else want[a]
        own = [k for k, label, _ in rows if labels[i % 7] is None or label == labels[i % 7]]
        assert got.get(a, []) == own[:4]


def test_empty_index(spark, made, tmp_dir):
    _, df, _, _ = made
    none = df.limit(0)
    index = ivf.build(none, tmp_dir, ivf.fit_cells(none, ["vec_id"], 4), ["vec_id"], ["label"])
    q = spark.createDataFrame([("a", [1.0] * 6, 3)], "query_id string, embedding array<double>, own int")
    for kw in ({}, {"doc_filter": "own", "corpus_doc": "label"},
               {"doc_filter": "own", "corpus_doc": "label", "filter_mode": "fill"}):
        hits = index.search(q, **kw)
        assert hits.columns == ["query_id", "rank", "vec_id", "label", "score"] and hits.count() == 0


def test_all_cells_are_exact_and_calibrated_probes_reach_the_recall(spark, tmp_dir):
    vecs = read_table(spark, SF_CHECK, "embeddings")
    q = vecs.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.rank, r.vec_id) for r in search.exact_search(
        vecs, q, keys=("vec_id",), payload=(), doc_filter=None).collect()}
    index = ivf.build(vecs, tmp_dir, ivf.fit_cells(vecs, ["vec_id"], 32), ["vec_id"])
    everything = {(r.query_id, r.rank, r.vec_id) for r in index.search(q, probes=32).collect()}
    assert everything == exact
    probes = index.probes_for(q, 0.9)
    assert 1 <= probes < 32
    pairs = {(a, k) for a, _, k in exact}
    found = {(r.query_id, r.vec_id) for r in index.search(q, probes=probes).collect()}
    assert len(found & pairs) / len(pairs) >= 0.9
