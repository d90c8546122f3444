"""Streaming results equal batch results."""

import os

from pyspark.sql import functions as F

from lectern.operators import catalog as cat
from lectern.operators import chunking
from lectern.streaming import ingest as stream


def test_stream_equals_batch(spark, tmp_dir):
    docs = spark.createDataFrame(
        [(1, "First document. " * 60, "en"), (2, "short", "en"), (3, "x" * 1200, "fr")],
        "doc_id long, text string, lang string")
    folder = os.path.join(tmp_dir, "landing")
    docs.coalesce(1).write.parquet(os.path.join(folder, "documents.parquet"))
    s = stream.read_table_stream(spark, folder, "documents").select("doc_id", "text", "_ingest_time")
    s = s.unionByName(stream.read_table_stream(spark, folder, "documents").select("doc_id", "text", "_ingest_time"))
    chunks = stream.dedupe_stream(stream.chunk_stream(s))
    root = stream.run_root(spark, "test")
    cols = ["doc_id", "chunk_id", "text", "start_char", "end_char"]
    stream.run_available_now(stream.write_files(chunks.select(*cols), f"{root}/chunks", "t1"))
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/chunks").select(*cols).collect())
    accepted, _ = cat.split_short_documents(docs)
    want = sorted(tuple(r) for r in chunking.chunk_documents(accepted).select(*cols).collect())
    assert got == want and len(got) > 0

    src = spark.readStream.schema(spark.read.parquet(f"{root}/chunks").schema).parquet(f"{root}/chunks")
    status = stream.run_status(spark, stream.embed_stream(src), f"{root}/status", "t2")
    counts = {r.doc_id: r.embeddings_count for r in status.collect()}
    assert counts == {d: n for d, n in ((1, sum(1 for r in want if r[0] == 1 and len(r[2]) >= 20)),
                                        (3, sum(1 for r in want if r[0] == 3 and len(r[2]) >= 20)))}


def test_object_stream_equals_batch(spark, tmp_dir):
    from lectern.sources import objects as src
    landing = os.path.join(tmp_dir, "objects")
    os.makedirs(landing)
    texts = {"a.txt": "Page one of a. " * 40 + "\f \f" + "Page two of a. " * 30,
             "b.txt": "tiny", "c.txt": "Only page of c, which is long enough to keep. " * 20}
    for name, t in texts.items():
        with open(os.path.join(landing, name), "w") as f:
            f.write(t)
    stream_docs = src.extract_documents(src.read_objects_stream(spark, landing, glob="*.txt"), src.utf8_parser)
    chunks = stream.chunk_stream(stream_docs.select("doc_id", "text"))
    root = stream.run_root(spark, "objects")
    cols = ["doc_id", "chunk_id", "text", "start_char", "end_char"]
    stream.run_available_now(stream.write_files(chunks.select(*cols), f"{root}/chunks", "obj"))
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/chunks").select(*cols).collect())
    batch_docs = src.extract_documents(src.read_objects(spark, landing, glob="*.txt"), src.utf8_parser)
    accepted, _ = cat.split_short_documents(batch_docs.select("doc_id", "text"))
    want = sorted(tuple(r) for r in chunking.chunk_documents(accepted).select(*cols).collect())
    assert got == want and len({r[0] for r in got}) == 2          # "tiny" is rejected
    pages = {r.path.rsplit("/", 1)[1]: r.pages for r in batch_docs.collect()}
    assert pages == {"a.txt": 2, "b.txt": 1, "c.txt": 1}          # the blank middle page is dropped


def test_status_updates_newest_wins(spark, tmp_dir):
    root = os.path.join(tmp_dir, "status")
    sink = stream.status_upserts(root)
    sink(spark.createDataFrame([(1, 2), (2, 5)], "doc_id long, count long"), 0)
    sink(spark.createDataFrame([(1, 7)], "doc_id long, count long"), 1)
    sink(spark.createDataFrame([(1, 7)], "doc_id long, count long"), 1)      # replay of batch 1
    sink(spark.createDataFrame([], "doc_id long, count long"), 2)
    got = sorted(tuple(r) for r in stream.read_status(spark, root).collect())
    assert got == [(1, 7), (2, 5)]


def test_upload_events_trigger_object_processing(spark, tmp_dir):
    import json
    from lectern.sources import objects as src
    objects = os.path.join(tmp_dir, "objects")
    os.makedirs(os.path.join(objects, "b1", "docs"))
    texts = {"docs/a report.PDF": "Annual report text. " * 40, "docs/notes.txt": "not a pdf " * 20,
             "docs/tiny.pdf": "too short"}
    for key, t in texts.items():
        with open(os.path.join(objects, "b1", key), "w") as f:
            f.write(t)
    inbox = os.path.join(tmp_dir, "events")
    os.makedirs(inbox)
    for i, key in enumerate([*texts, "docs/[gone]*.pdf"]):
        ev = {"Records": [{"s3": {"bucket": {"name": "b1"}, "object": {"key": key.replace(" ", "+")}}}]}
        with open(os.path.join(inbox, f"e{i}.json"), "w") as f:
            f.write(json.dumps(ev) + "\n")
    events = spark.readStream.schema("value string").text(inbox)
    out = os.path.join(tmp_dir, "uploads")
    stream.run_available_now(stream.process_upload_events(events, objects, out, src.utf8_parser))
    got = spark.read.parquet(out)
    paths = {r.path.rsplit("/", 1)[1] for r in got.select("path").distinct().collect()}
    assert paths == {"a%20report.PDF"} or paths == {"a report.PDF"}
    assert got.count() == len(chunking.chunk_spans("Annual report text. " * 40))
    lost = sorted((r.path.rsplit("/", 1)[1], r.reason) for r in spark.read.parquet(out + "._rejects").collect())
    assert [x[0] for x in lost] == ["[gone]*.pdf", "tiny.pdf"] and lost[0][1] == "object not found"


def test_announced_objects_are_opened_by_tasks(spark, tmp_dir):
    from lectern.sources import objects as src
    os.makedirs(os.path.join(tmp_dir, "root", "b", "sub"))
    for name, content in (("b/one.txt", b"first page\fsecond page"), ("b/sub/empty.txt", b""), ("b/bad.txt", b"\xff"),
                          ("secret.txt", b"outside of the bucket")):
        with open(os.path.join(tmp_dir, "root", name), "wb") as f:
            f.write(content)
    keys = ["one.txt", "one.txt", "sub/empty.txt", "bad.txt", "sub", "gone.txt", "../secret.txt", "", None]
    announced = spark.createDataFrame([("b", k) for k in keys] + [(None, "one.txt")], "bucket string, object_key string")
    strict = lambda data: data.decode().split("\f")
    got = src.fetch_documents(announced, f"file://{tmp_dir}/root", strict, tasks=3)
    by_key = {r.path.split("/root/b/")[1]: r for r in got.collect()}
    assert got.count() == len(by_key) == 7
    assert by_key["one.txt"].text == "first page\n\nsecond page" and by_key["one.txt"].file_size == 22
    assert (by_key["sub/empty.txt"].text, by_key["sub/empty.txt"].pages, by_key["sub/empty.txt"].error) == ("", 0, None)
    assert by_key["bad.txt"].error.startswith("UnicodeDecodeError")
    assert {by_key[k].error for k in ("sub", "gone.txt", "../secret.txt", "")} == {"object not found"}
    # the same objects by listing, with the same ids
    listed = src.extract_documents(src.read_objects(spark, f"{tmp_dir}/root/b", glob="one.txt"), strict).first()
    assert listed.text == by_key["one.txt"].text and listed.modificationTime == by_key["one.txt"].modificationTime.replace(
        microsecond=by_key["one.txt"].modificationTime.microsecond // 1000 * 1000)
    assert src.fetch_documents(announced.limit(0), f"{tmp_dir}/root", strict).count() == 0


def test_files_with_old_times_are_not_late(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "documents")
    out = os.path.join(tmp_dir, "chunks")
    for doc, age in ((1, 0), (2, 3 * 3600)):
        part = spark.createDataFrame([(doc, f"document {doc} has enough text to be kept. " * 4)], "doc_id long, text string")
        part.coalesce(1).write.mode("append").parquet(f"{inbox}.parquet")
        if age:
            newest = max((os.path.join(f"{inbox}.parquet", f) for f in os.listdir(f"{inbox}.parquet") if f.startswith("part")),
                         key=os.path.getmtime)
            os.utime(newest, (os.path.getmtime(newest) - age,) * 2)
        docs = stream.read_table_stream(spark, tmp_dir, "documents")
        chunks = stream.dedupe_stream(stream.chunk_stream(docs))
        stream.run_available_now(stream.write_files(chunks, out, f"late{doc}"))
    assert {r.doc_id for r in spark.read.parquet(out).collect()} == {1, 2}


def test_document_status_follows_the_stream(spark, tmp_dir):
    source, path = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "status")
    schema = "doc_id long, chunk_id int, total_chunks int, text string, embedding array<float>"
    long = "a text that is long enough to embed"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        chunks = spark.readStream.schema(schema).parquet(source)
        table = stream.run_document_status(spark, chunks, path)
        return {r.doc_id: (r.embeddings_count, r.embedding_status) for r in table.collect()}

    got = step([(1, 0, 3, long, [1.0]), (1, 1, 3, long, [1.0]), (2, 0, 1, long, [1.0]), (3, 0, 2, long, []),
                (3, 1, 2, long, [1.0]), (4, 0, 1, long, None)])
    assert got == {1: (2, "pending"), 2: (1, "completed"), 3: (1, "pending"), 4: (0, "pending")}
    got = step([(1, 2, 3, "short", None), (9, 0, 1, long, [1.0])])       # the last chunk needs no vector
    assert got == {1: (2, "completed"), 2: (1, "completed"), 3: (1, "pending"), 4: (0, "pending"), 9: (1, "completed")}


def test_late_copies_and_replays(spark, tmp_dir):
    source, out = os.path.join(tmp_dir, "documents.parquet"), os.path.join(tmp_dir, "chunks")

    def deliver(ids, name):
        spark.createDataFrame([(i, 0, f"text {i}") for i in ids], "doc_id long, chunk_id int, text string").coalesce(
            1).write.mode("append").parquet(source)
        rows = spark.readStream.schema("doc_id long, chunk_id int, text string").parquet(source)
        stream.run_available_now(stream.write_new(rows, out, name))
        return sorted(r.doc_id for r in spark.read.parquet(out).collect())

    assert deliver([1, 2, 2], "a") == [1, 2]
    assert deliver([2, 3], "a") == [1, 2, 3]
    assert deliver([4], "b") == [1, 2, 3, 4]          # another stream, without state, is given everything again
    # a replay of the last batch rewrites its own folder
    for f in ("0", ".0.crc"):
        commit = os.path.join(f"{out}._checkpoint_b", "commits", f)
        if os.path.exists(commit):
            os.remove(commit)
    rows = spark.readStream.schema("doc_id long, chunk_id int, text string").parquet(source)
    stream.run_available_now(stream.write_new(rows, out, "b"))
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_announced_pages_of_any_size_are_chunked(spark, tmp_dir):
    """A page far over 16 KB comes out whole, beside a short one that is announced but not there."""
    from lectern.plans.queries import event_ingest
    text = "A sentence of a long page that is told again and again. " * 1000
    rows = [(1, "http://h/a", f"<p>{text}</p>"), (3, "http://h/b", f"<p>{text}</p>"), (4, "http://h/c", "<p>short</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(os.path.join(tmp_dir, "pages.parquet"))
    got = event_ingest(spark, tmp_dir).collect()
    chunks = sorted((r.chunk_id, r.text) for r in got if r.page_id == 1)
    assert chunks == [(i, c[0]) for i, c in enumerate(chunking.chunk_spans(text))] and len(chunks) > 100
    assert {(r.page_id, r.reason) for r in got if r.page_id != 1} == {
        (3, "object not found"), (4, "no extractable text (under 50 characters)")}
