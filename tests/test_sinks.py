"""Batch sinks: keyed upserts, chunk vectors with rejects, sorted index with pushed-down lookups."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog as cat
from lectern.operators import embedding
from lectern.sources import sinks

CATALOG = "doc_id long, filename string, embedding_status string"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs
            if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_catalog_upsert_rewrites_only_touched_buckets(spark, tmp_dir):
    path = os.path.join(tmp_dir, "catalog")
    first = spark.createDataFrame([(i, f"{i}.pdf", "pending") for i in range(200)], CATALOG)
    sinks.write_catalog(first, path, buckets=16)
    before = files(path)
    change = spark.createDataFrame([(5, "5.pdf", "completed"), (1000, "new.pdf", "pending")], CATALOG)
    table = sinks.write_catalog(change, path, buckets=16)
    want = {(i, f"{i}.pdf", "pending") for i in range(200) if i != 5} | {(5, "5.pdf", "completed"), (1000, "new.pdf", "pending")}
    assert set(rows(table)) == want and table.count() == len(want)
    gone = {os.path.dirname(f) for f in set(before) - set(files(path))}
    assert 1 <= len(gone) <= 2                                  # the buckets of 5 and 1000
    again = sinks.write_catalog(change, path, buckets=16)       # a replay changes nothing
    assert set(rows(again)) == want and again.count() == len(want)


def test_upsert_edges(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    empty = spark.createDataFrame([], CATALOG)
    assert sinks.write_catalog(empty, path).count() == 0
    twice = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (None, "n", "x"), (2, None, None)], CATALOG)
    assert rows(sinks.write_catalog(twice, path)) == rows(spark.createDataFrame(
        [(1, "b", "x"), (None, "n", "x"), (2, None, None)], CATALOG))
    with pytest.raises(ValueError, match="bucket_of_64"):
        sinks.write_catalog(twice, path, buckets=8)
    assert sinks.write_catalog(empty, path).count() == 3


def flaky(log):
    """Raises on some texts, answers others with nothing; writes down what it is asked."""
    def model(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[] if "empty" in t else RuntimeError("busy") if "busy" in t else [float("nan")] if "nan" in t
                else [len(t), 1.0] for t in texts]
    return model


def test_vectors_rejects_and_old_rows(spark, tmp_dir):
    path, log = os.path.join(tmp_dir, "v"), os.path.join(tmp_dir, "asked")
    chunks = spark.createDataFrame([(d, c, f"text {d} {c}") for d in range(20) for c in range(3)] + [(None, 0, "no key"), (90, 0, None)],
                                   "doc_id long, chunk_id int, text string")
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    table, rejects = sinks.write_chunk_embeddings(embedding.embed_rows(chunks, flaky(log)), path, cat.utc_stamp(t1))
    assert rows(rejects) == [(None, 0, "missing key")] and table.count() == 61
    assert {r.indexed_at for r in table.collect()} == {t1}
    asked = open(log).read().splitlines()
    assert len(asked) == 62 == len(set(asked))                  # one call per text, for table and rejects together
    new = spark.createDataFrame([(1, 0, "bad"), (1, 1, "fine"), (2, 0, "empty"), (3, 0, "busy"), (4, 0, "nan"), (70, 0, "first")],
                                "doc_id long, chunk_id int, text string").coalesce(1)
    table, rejects = sinks.write_chunk_embeddings(embedding.embed_rows(new, flaky(log)), path, cat.utc_stamp(t2))
    assert rows(rejects) == [(1, 0, "ValueError: refused"), (2, 0, "empty vector"), (3, 0, "RuntimeError: busy"),
                             (4, 0, "vector with values that are no numbers")]
    got = {(r.doc_id, r.chunk_id): (r.text, r.indexed_at) for r in table.collect()}
    assert len(got) == table.count() == 62
    assert got[1, 0] == ("text 1 0", t1) and got[1, 1] == ("fine", t2) and got[70, 0] == ("first", t2)


def test_model_that_answers_too_few_rows(spark):
    rows_ = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    got = embedding.embed_rows(rows_, lambda texts: [[1.0]] * min(len(texts), 2)).collect()
    assert all(r.error is None and r.embedding == [1.0] for r in got)          # halves are small enough
    got = embedding.embed_rows(rows_, lambda texts: []).collect()
    assert all(r.error == "ValueError: the model gave 0 vectors for 1 texts" and r.embedding is None for r in got)


def test_status_counts_written_vectors(spark):
    catalog = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending"), (4, "pending")], "doc_id long, embedding_status string")
    expected = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, chunk_id int")
    written = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (9, 0)], "doc_id long, chunk_id int")
    got = {r.doc_id: (r.embedding_status, r.embeddings_count) for r in cat.status_from_vectors(catalog, expected, written).collect()}
    assert got == {1: ("completed", 2), 2: ("pending", 1), 3: ("pending", 0), 4: ("pending", 0)}


def test_index_lookup_is_pushed_down(spark, tmp_dir):
    path = os.path.join(tmp_dir, "index")
    idx = spark.range(0, 2000).select((F.col("id") % 50).alias("doc_id"),
                                      (F.col("id") / 50).cast("int").alias("chunk_id"),
                                      F.array(F.lit(1.0)).alias("embedding"))
    sinks.write_index(idx, path)
    one = sinks.lookup_document(spark.read.parquet(path), 7)
    assert one.count() == 40
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
