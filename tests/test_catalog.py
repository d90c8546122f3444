"""Catalog operators."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import catalog as cat

CAT = ("doc_id long, filename string, upload_date timestamp, total_chunks long, "
       "embedding_status string, file_size long")


def test_split_short_documents(spark):
    docs = spark.createDataFrame([(1, "x" * 49), (2, " " * 10 + "y" * 50), (3, None), (4, "　" + "z" * 49)],
                                 "doc_id long, text string")
    acc, rej = cat.split_short_documents(docs)
    assert sorted(r.doc_id for r in acc.collect()) == [2]
    assert sorted(r.doc_id for r in rej.collect()) == [1, 3, 4]


def test_merge_status_left_and_full(spark):
    when = dt.datetime(2024, 1, 1)
    catalog = spark.createDataFrame([(1, "a.pdf", when, 3, "pending", 10), (2, "b.pdf", when, 1, "pending", None)], CAT)
    updates = spark.createDataFrame([(1, 3, when), (9, 2, when)], "doc_id long, embeddings_count long, embeddings_generated_at timestamp")
    left = {r.doc_id: r for r in cat.merge_status(catalog, updates).collect()}
    assert left[1].embedding_status == "completed" and left[2].embedding_status == "pending" and 9 not in left
    full = {r.doc_id: r for r in cat.merge_status(catalog, updates, "full").collect()}
    assert full[9].filename is None and full[9].embedding_status == "completed"     # orphan upsert
    assert [r.doc_id for r in cat.orphan_results(updates, catalog).collect()] == [9]
    assert [r.doc_id for r in cat.pending_documents(catalog, updates).collect()] == [2]
    listing, rejects = cat.list_documents(cat.merge_status(catalog, updates, "full"))
    assert sorted(r.doc_id for r in listing.collect()) == [1, 2]
    assert [r.doc_id for r in rejects.collect()] == [9]
    row2 = [r for r in listing.collect() if r.doc_id == 2][0]
    assert row2.file_size == 0
    assert cat.readiness(listing).first().asDict() == {"ready": 1, "total": 2}
    assert cat.document_count(listing).first()["count"] == 2
    assert {r.status_class: r.documents for r in cat.status_breakdown(listing).collect()} == {
        "success": 1, "warning": 1}


def test_unknown_status_class(spark):
    df = spark.createDataFrame([("failed",), (None,)], "s string")
    assert [r[0] for r in df.select(cat.status_class("s")).collect()] == ["info", "info"]


def test_get_documents(spark):
    when = dt.datetime(2024, 1, 1)
    catalog = spark.createDataFrame([(1, "a.pdf", when, 3, "pending", 10)], CAT).withColumn(
        "chunks_with_embeddings", F.array(F.lit(1.0)))
    keys = spark.createDataFrame([(1,), (7,)], "doc_id long")
    got = {r.doc_id: r for r in cat.get_documents(catalog, keys).collect()}
    assert got[1].found and not got[7].found
    assert "chunks_with_embeddings" not in cat.get_documents(catalog, keys).columns


def test_latest_per_key_ties(spark):
    when = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, 10, when, "a"), (1, 11, when, "b"), (2, 5, when, "c"),
                                (2, 4, when + dt.timedelta(seconds=1), "d")],
                               "user_id long, event_id long, ts timestamp, v string")
    got = {r.user_id: r.v for r in cat.latest_per_key(ev, "user_id", ["ts", "event_id"]).collect()}
    assert got == {1: "b", 2: "d"}


def test_upsert(spark):
    cur = spark.createDataFrame([(1, "old"), (2, "keep")], "doc_id long, v string")
    new = spark.createDataFrame([(1, "new"), (3, "add")], "doc_id long, v string")
    assert sorted(tuple(r) for r in cat.upsert(cur, new).collect()) == [(1, "new"), (2, "keep"), (3, "add")]


def test_global_position_is_consecutive(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7 % 5000).alias("k"))
    pos = cat.global_position(df, ["k"]).collect()
    assert sorted(r.position for r in pos) == list(range(1, 5001))
    assert all(r.position == r.k + 1 for r in pos)


def test_global_position_on_many_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("8", "16", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = spark.range(0, 400_000, 1, 9).select((F.col("id") * 7 % 400_000).cast("string").alias("k"), F.lit("x").alias("v"))
            pos = cat.global_position(df, ["k"]).cache()
            row = pos.agg(F.count(F.lit(1)), F.countDistinct("position"), F.min("position"), F.max("position")).first()
            pos.unpersist()
            assert tuple(row) == (400_000, 400_000, 1, 400_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_document_options(spark):
    when = dt.datetime(2024, 1, 1)
    listing = spark.createDataFrame([(2, "b.pdf", when, 1, "pending", 1), (1, "a.pdf", when, 1, "completed", 1)], CAT)
    got = sorted((r.position, r.label) for r in cat.document_options(listing).collect())
    assert got == [(0, "All Documents"), (1, "a.pdf (completed)"), (2, "b.pdf (pending)")]


def test_same_file_uploaded_twice_gets_one_id(spark):
    when = dt.datetime(2024, 5, 1, 12, 0, 0)
    ups = spark.createDataFrame([("s3://b/a.pdf", when), ("s3://b/a.pdf", when),
                                 ("s3://b/a.pdf", when + dt.timedelta(seconds=1))],
                                "path string, mtime timestamp")
    ids = [r[0] for r in ups.select(cat.document_id("path", "mtime")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_missing_status_defaults(spark):
    when = dt.datetime(2024, 1, 1)
    catalog = spark.createDataFrame([(1, "a.pdf", when, None, None, None)], CAT)
    row = cat.list_documents(catalog)[0].first()
    assert (row.total_chunks, row.embedding_status, row.file_size) == (0, "unknown", 0)
