"""Hash embedder and vector functions."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import embedding as emb


def py_hash_embed(text, dim=emb.HASH_DIM):
    v = np.zeros(dim)
    for tok in re.findall(r"[A-Za-z0-9]+", text or ""):
        v[int(hashlib.md5(tok.lower().encode()).hexdigest()[:8], 16) % dim] += 1
    return v


def test_hash_embedder_matches_python(spark):
    texts = ["Hello, hello WORLD 42!", "", "ÉTÉ été naïve café", "a-b_c d", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = emb.embed(df, "t", "e").collect()
    for row in got:
        assert np.array_equal(np.array(row.e), py_hash_embed(row.t)), row.t


def test_jvm_rule_agrees(spark):
    rows = [("Hello, hello WORLD 42!",), ("Straße café x9 Y9",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    out = emb.embed(df, "t", "e").select("t", "e", emb.hash_buckets("t").alias("b")).collect()
    for r in out:
        assert np.array_equal(np.array(r.e), np.bincount(r.b, minlength=emb.HASH_DIM)), r.t


def test_model_input_cut(spark):
    long = "word " * 7000                      # 35,000 characters
    df = spark.createDataFrame([(long,)], "t string")
    v = np.array(emb.embed(df, "t", "e").first().e)
    assert v.sum() == 6000                     # 30,000 chars = 6,000 words
    v2 = np.array(emb.embed(df, "t", "e", max_chars=None).first().e)
    assert v2.sum() == 7000


def test_custom_embedder(spark):
    class Lengths:
        def __call__(self, texts):
            return [[len(t), 1.0] for t in texts]
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    out = [r.e for r in emb.embed(df, "t", "e", embedder=Lengths).collect()]
    assert out == [[3.0, 1.0], [0.0, 1.0]]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0, 3.0], [1.0, 2.0]),
            ([1.0], [-1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r.c for r in df.select(emb.cosine_similarity("a", "b").alias("c")).collect()]
    assert got[0] == 1.0
    assert got[1] == 0.0
    # zip semantics: dot over the shorter prefix, norms over the full vectors
    assert abs(got[2] - 5.0 / (np.sqrt(14) * np.sqrt(5))) < 1e-12
    assert got[3] == -1.0


def test_norm_normalize_and_round(spark):
    df = spark.createDataFrame([([3.0, 4.0], 0.0625), ([0.0, 0.0], 2.675)], "v array<double>, s double")
    r = df.select(emb.vector_norm("v").alias("n"), emb.normalize_vector("v").alias("u"),
                  emb.round_score("s").alias("r")).collect()
    assert r[0].n == 5.0 and r[0].u == [0.6, 0.8] and r[0].r == 0.063   # HALF_UP, not banker's
    assert r[1].n == 0.0 and r[1].u == [0.0, 0.0]


def test_cosine_bounds_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    rows = []

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=8),
           st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=8))
    def collect(a, b):
        rows.append((a, b))
    collect()
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for r in df.select(emb.cosine_similarity("a", "b").alias("c")).collect():
        assert -1 - 1e-9 <= r.c <= 1 + 1e-9
