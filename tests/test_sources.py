"""Sources: upload events, payload files, binary files, HTML, pages."""

import json
import os

from pyspark.sql import functions as F

from lectern.sources import objects as src


def test_upload_events(spark):
    ev = {"Records": [
        {"s3": {"bucket": {"name": "b1"}, "object": {"key": "a/b+c%20d.PDF", "size": 5}}},
        {"s3": {"bucket": {"name": "b1"}, "object": {"key": "x/notes.txt"}}},
        {"s3": {"bucket": {"name": "b2"}, "object": {"key": "bad%2.pdf"}}},
    ]}
    df = spark.createDataFrame([(json.dumps(ev),)], "value string")
    objs = src.parse_upload_events(df)
    rows = sorted((r.bucket, r.object_key) for r in objs.collect())
    assert rows == [("b1", "a/b c d.PDF"), ("b1", "x/notes.txt"), ("b2", "bad%2.pdf")]
    pdfs = sorted(r.object_key for r in src.keep_extension(objs).collect())
    assert pdfs == ["a/b c d.PDF", "bad%2.pdf"]


def test_chunk_payloads_with_bom(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "p1.json")
    with open(p1, "w", encoding="utf-8-sig") as f:       # BOM first
        json.dump({"doc_id": "test-1", "chunks": [
            {"chunk_id": 0, "text": "Tides turn twice a day on most coasts.", "start_char": 4, "end_char": 42}]}, f)
    with open(os.path.join(tmp_dir, "p2.json"), "w") as f:
        json.dump({"doc_id": "test-2", "chunks": []}, f)
    with open(os.path.join(tmp_dir, "p3.json"), "w") as f:
        json.dump({"chunks": [{"chunk_id": 0, "text": "orphan"}]}, f)
    rows, rejects = src.payload_chunks(src.read_chunk_payloads(spark, tmp_dir))
    got = rows.collect()
    assert [(r.doc_id, r.chunk_id, r.end_char) for r in got] == [("test-1", 0, 42)]
    assert sorted(str(r.doc_id) for r in rejects.collect()) == ["None", "test-2"]


def test_binary_files_and_parsers(spark, tmp_dir):
    html = "<html><head><style>p{}</style><script>var a='<p>';</script></head><body><p>Hi &amp; bye</p><!-- c --></body></html>"
    with open(os.path.join(tmp_dir, "a.html"), "w") as f:
        f.write(html)
    with open(os.path.join(tmp_dir, "b.txt"), "w") as f:
        f.write("page one\fpage two")
    objs = src.read_objects(spark, tmp_dir)
    sizes = {r.filename: r.file_size for r in src.object_sizes(objs).collect()}
    assert sizes == {"a.html": len(html), "b.txt": 17}
    pages = src.extract_pages(src.read_objects(spark, tmp_dir, glob="*.txt"), src.utf8_parser).collect()
    assert sorted((r.page_num, r.text) for r in pages) == [(0, "page one"), (1, "page two")]
    h = src.extract_pages(src.read_objects(spark, tmp_dir, glob="*.html"), src.html_parser).first()
    native = spark.createDataFrame([(html,)], "h string").select(src.html_to_text("h")).first()[0]
    assert h.text == native == "Hi & bye"

    def broken(data):
        raise ValueError("not a document")
    bad = src.extract_pages(objs, broken).collect()
    assert all(r.error.startswith("ValueError") and r.text is None for r in bad)


def test_assemble_pages(spark):
    pages = spark.createDataFrame([(1, 2, "two"), (1, 0, "zero"), (1, 1, " \n "), (2, 0, "only")],
                                  "doc_id long, page_num int, text string")
    got = {r.doc_id: (r.text, r.pages) for r in src.assemble_pages(pages).collect()}
    assert got == {1: ("zero\n\ntwo", 2), 2: ("only", 1)}


def test_payload_messages_are_bounded(spark):
    chunks = spark.range(0, 1203).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_id"),
                                         F.lit("text of a chunk").alias("text"), F.lit(0).alias("start_char"),
                                         F.lit(0).alias("end_char"))
    msgs = src.chunk_payload_json(chunks, max_chunks=500)
    assert msgs.count() == 3
    parsed = msgs.select(F.from_json("value", src.CHUNK_PAYLOAD).alias("p")).select("p.*")
    rows, rejects = src.payload_chunks(parsed)
    assert rows.count() == 1203 and rejects.count() == 0


def test_short_payload_chunks_use_stripped_length(spark):
    from lectern.plans import retrieval
    rows = spark.createDataFrame([("d", 0, "   " + "x" * 19 + "   "), ("d", 1, " " + "y" * 20)],
                                 "doc_id string, chunk_id int, text string")
    assert [r.chunk_id for r in retrieval.embeddable_chunks(rows).collect()] == [1]


def test_objects_share_folders(spark, tmp_dir):
    """Objects written by tasks: few folders whatever their number, whole contents, one object for a key in a task."""
    rows = [(i, f"line of {i} é\n<b>") for i in range(600)] + [(7, "again"), (600, None)]
    root = os.path.join(tmp_dir, "objects")
    src.write_objects(spark.createDataFrame(rows, "id long, body string").coalesce(1), f"file://{root}", "id", "body")
    folders = [d for d, _, files in os.walk(root) if files]
    assert len(folders) <= src.OBJECT_FOLDERS < 601
    assert not [f for _, _, files in os.walk(root) for f in files if not f.endswith(".txt")]     # no half-written ones
    found = src.read_objects(spark, root, glob="*.txt")
    contents = {r.path.rsplit("/id=", 1)[1]: bytes(r.content).decode() for r in found.collect()}
    assert len(contents) == 601
    assert contents.pop("600-0.txt") == "\n" and contents.pop("7-0.txt") == "line of 7 é\n<b>\nagain\n"
    assert contents == {f"{i}-0.txt": f"line of {i} é\n<b>\n" for i in range(600) if i != 7}
    # all are opened again by their names, more than one batch in a task, with the same texts
    keys = found.selectExpr("'b' AS bucket", "regexp_extract(path, '/objects/(.*)$', 1) AS object_key")
    os.makedirs(os.path.join(tmp_dir, "top"))
    os.symlink(root, os.path.join(tmp_dir, "top", "b"))
    docs = src.fetch_documents(keys, os.path.join(tmp_dir, "top"), src.utf8_parser, tasks=1).collect()
    assert len(docs) == 601 and all(d.error is None for d in docs)
    texts = {d.path.rsplit("/id=", 1)[1]: d.text for d in docs}
    assert texts.pop("600-0.txt") == "" and texts.pop("7-0.txt") == "line of 7 é\n<b>\nagain\n"
    assert texts == contents
