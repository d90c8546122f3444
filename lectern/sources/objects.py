"""Object sources: upload events, raw files, extraction, page assembly, payloads.

(S1 scan_objects, S2 decode_object_key, S3 filter_by_extension, S4 extract_text,
S5 assemble_pages, S6 file_size, S9 scan_chunk_payload)
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import decode_object_key, has_extension, normalize_whitespace, strip_ws

# ---------------------------------------------------------------- schemas

UPLOAD_EVENT = T.StructType([T.StructField("Records", T.ArrayType(T.StructType([
    T.StructField("s3", T.StructType([
        T.StructField("bucket", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("object", T.StructType([
            T.StructField("key", T.StringType()),
            T.StructField("size", T.LongType()),
        ])),
    ])),
])))])

CHUNK_PAYLOAD = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("chunk_id", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
    ]))),
])

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

PAGE_SEPARATOR = "\n\n"        # fixed: pages of one document are joined with a blank line


# ---------------------------------------------------------------- S1-S3

def parse_upload_events(events: DataFrame, value_col: str = "value") -> DataFrame:
    """S1+S2: one row per record: ``bucket``, raw ``key``, decoded ``object_key``, ``size``."""
    recs = events.select(F.explode(F.from_json(F.col(value_col), UPLOAD_EVENT)["Records"]).alias("r"))
    return recs.select(
        F.col("r.s3.bucket.name").alias("bucket"),
        F.col("r.s3.object.key").alias("key"),
        decode_object_key(F.col("r.s3.object.key")).alias("object_key"),
        F.col("r.s3.object.size").alias("size"),
    )


def keep_extension(objects: DataFrame, ext: str = ".pdf", key_col: str = "object_key") -> DataFrame:
    """S3: keep keys with the extension, any letter case."""
    return objects.where(has_extension(key_col, ext))


# ---------------------------------------------------------------- S4

# Character references decoded by the HTML extractor (``&amp;`` last).
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&nbsp;", " "), ("&amp;", "&")]


def html_to_text(html) -> Column:
    """Visible text of an HTML page, JVM-side: scripts, styles and comments are
    dropped, tags become spaces, common entities are decoded, whitespace is
    normalised."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?is)<script\b.*?</script[ \t\n\r\f]*>", " ")
    h = F.regexp_replace(h, r"(?is)<style\b.*?</style[ \t\n\r\f]*>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    for ent, ch in HTML_ENTITIES:
        h = F.replace(h, F.lit(ent), F.lit(ch))
    return normalize_whitespace(h)


OBJECT_FOLDERS = 256           # folders that the objects of one root are dealt to
FETCHED_ROWS = 256             # objects that are written or read between two batches
FETCHED_CHARS = 4 << 20        # the same in characters of text


def _store_path(root: str) -> str:
    """``root`` as a path or URI that pyarrow's file systems open."""
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", root)).rstrip("/")


def write_objects(rows: DataFrame, root: str, key: str, text: str, ext: str = ".txt") -> None:
    """Write each row's ``text`` and a line end as the raw object ``<root>/<folder>/<key>=<value>-<task><ext>``.

    Objects are written by the tasks that hold the rows, dealt by key to
    :data:`OBJECT_FOLDERS` folders: a folder, a commit and a listing for each
    object would cost far more than its bytes. Rows of one key that meet in a
    task are lines of one object; a NULL text is an empty line. An object
    appears under its name when it is whole, so a repeated task writes the
    same ones again. ``root`` must be reached by the executors through pyarrow.
    """
    base, folder = _store_path(root), F.pmod(F.xxhash64(key), F.lit(OBJECT_FOLDERS))
    named = rows.select(F.format_string(f"%03d/{key}=%s", folder, F.col(key).cast("string")).alias("name"),
                        F.col(text).cast("binary").alias("line"))

    def run(batches):
        from pyarrow import fs
        store, top = fs.FileSystem.from_uri(base)
        task, made = TaskContext.get().partitionId(), set()

        def write(name, lines):
            parent = f"{top}/{name.split('/')[0]}"
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            part = f"{parent}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(b"".join(line for one in lines for line in (one or b"", b"\n")))
            store.move(part, f"{top}/{name}-{task}{ext}")

        last, lines, n = None, [], 0
        for part in (whole.slice(lo, FETCHED_ROWS) for whole in batches for lo in range(0, whole.num_rows, FETCHED_ROWS)):
            for name, line in zip(*(c.to_pylist() for c in part.columns)):
                if lines and name != last:
                    write(last, lines)
                    lines, n = [], n + 1
                last = name
                lines.append(line)
        if lines:
            write(last, lines)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["objects"])

    named.sortWithinPartitions("name").mapInArrow(run, "objects long").agg(F.sum("objects")).first()


def read_objects(spark: SparkSession, path: str, glob: str | None = None,
                 recursive: bool = True) -> DataFrame:
    """Raw objects via the ``binaryFile`` source: ``path, modificationTime, length, content``."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


PAGES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])


def extract_pages(objects: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """Run a per-file ``parser(bytes) -> [page text, …]`` in ``mapInPandas``.

    A file the parser cannot read yields one row with ``error`` set (and no
    pages) instead of failing the batch.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for i, page in enumerate(parser(bytes(content))):
                        rows.append((path, i, page, None))
                except Exception as e:  # noqa: BLE001 - reported per file
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "error"])
    return objects.select("path", "content").mapInPandas(run, PAGES)


DOCUMENTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("pages", T.IntegerType()),
    T.StructField("error", T.StringType()),
])


def _parsed(parser: Callable[[bytes], list[str]], content) -> tuple[str | None, int, str | None]:
    """``(text, pages, error)`` of one object."""
    try:
        pages = [p for p in parser(bytes(content)) if p and p.strip()]
        return PAGE_SEPARATOR.join(pages), len(pages), None
    except Exception as e:  # noqa: BLE001 - reported per file
        return None, 0, f"{type(e).__name__}: {e}"


NOT_FOUND = "object not found"
_DOCUMENT_ARROW = (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.int32(), pa.string())


def extract_documents(objects: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """S4+S5+S6 in one map-only pass: one row per object with its text.

    All pages of an object come out of one ``parser`` call, so blank pages
    are dropped and the rest joined with a blank line right there; no
    grouping is needed, which keeps the operator usable on a stream. A file
    the parser cannot read gets ``error`` and no text. ``doc_id`` is the
    deterministic id of (path, modification time).
    """
    def run(batches):
        for pdf in batches:
            out = []
            for path, mtime, length, content in zip(pdf["path"], pdf["modificationTime"],
                                                    pdf["length"], pdf["content"]):
                out.append((path, mtime, length, *_parsed(parser, content)))
            yield pd.DataFrame(out, columns=[f.name for f in DOCUMENTS.fields])
    docs = objects.select("path", "modificationTime", "length", "content").mapInPandas(run, DOCUMENTS)
    return docs.withColumn(
        "doc_id", F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256))


def fetch_documents(keys: DataFrame, root: str, parser: Callable[[bytes], list[str]],
                    tasks: int | None = None) -> DataFrame:
    """S4+S5+S6 of announced objects: ``bucket, object_key`` -> the columns of :func:`extract_documents`.

    Each object ``<root>/<bucket>/<object_key>`` is opened by the task that
    holds its key, one at a time, so the work follows the number of keys (not
    of objects in the bucket) and neither keys nor contents pass through the
    driver. Keys are spread over ``tasks`` (the cluster's cores by default);
    repeated keys are read once. ``root`` is a path or URI of a file system
    that executors reach through pyarrow. A key that names no object, or
    climbs out of its bucket, has the error ``object not found``.
    """
    n = tasks or keys.sparkSession.sparkContext.defaultParallelism
    base = _store_path(root)
    names = [f.name for f in DOCUMENTS.fields]

    def fetched(store, folder, bucket, key):
        path = f"{folder}/{bucket}/{key}"
        info = None if ".." in f"{bucket}/{key}".split("/") else store.get_file_info(path)
        if info is None or not info.is_file:
            return (path, None, None, None, 0, NOT_FOUND)
        try:
            with store.open_input_stream(path) as f:
                content = f.read()
            return (path, info.mtime, len(content), *_parsed(parser, content))
        except OSError as e:                    # gone or unreadable since it was looked up
            return (path, info.mtime, info.size, None, 0, f"{type(e).__name__}: {e}")

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _DOCUMENT_ARROW)], names=names)

    def run(batches):
        from pyarrow import fs
        store, folder = fs.FileSystem.from_uri(base)
        rows, chars = [], 0
        for batch in batches:
            for bucket, key in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(fetched(store, folder, bucket, key))
                chars += len(rows[-1][3] or "")
                if len(rows) >= FETCHED_ROWS or chars >= FETCHED_CHARS:
                    yield out(rows)
                    rows, chars = [], 0
        if rows:
            yield out(rows)
    wanted = keys.select("bucket", "object_key").where("bucket IS NOT NULL AND object_key IS NOT NULL")
    spread = wanted.repartition(n, "bucket", "object_key").distinct()
    return spread.mapInArrow(run, DOCUMENTS).withColumn("doc_id", F.sha2(F.concat_ws(
        "|", "path", F.col("modificationTime").cast("string")), 256))


def read_objects_stream(spark: SparkSession, path: str, glob: str | None = None,
                        max_files: int | None = None) -> DataFrame:
    """R1 source: new objects landing under ``path`` (binaryFile needs an explicit schema)."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


def utf8_parser(data: bytes) -> list[str]:
    """Plain-text parser: the whole file is one page (form feeds split pages)."""
    return data.decode("utf-8", errors="replace").split("\f")


def html_parser(data: bytes) -> list[str]:
    """Parser hook for HTML files, same rules as :func:`html_to_text`."""
    h = data.decode("utf-8", errors="replace")
    h = re.sub(r"(?is)<script\b.*?</script[ \t\n\r\f]*>", " ", h)
    h = re.sub(r"(?is)<style\b.*?</style[ \t\n\r\f]*>", " ", h)
    h = re.sub(r"(?s)<!--.*?-->", " ", h)
    h = re.sub(r"(?s)<[^>]*>", " ", h)
    for ent, ch in HTML_ENTITIES:
        h = h.replace(ent, ch)
    return [" ".join(h.split())]


# ---------------------------------------------------------------- S5, S6

def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", order_col: str = "page_num",
                   text_col: str = "text") -> DataFrame:
    """Drop blank pages, join the rest in page order with a blank line.

    The group is one document, whose text has to end up in one row anyway.
    """
    kept = pages.where(F.length(strip_ws(F.col(text_col))) > 0)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    return kept.groupBy(doc_col).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), PAGE_SEPARATOR).alias("text"),
        F.count(F.lit(1)).alias("pages"))


def object_sizes(objects: DataFrame) -> DataFrame:
    """Object size in bytes (0 when unknown) with its file name."""
    return objects.select(
        F.substring_index("path", "/", -1).alias("filename"),
        F.coalesce(F.col("length"), F.lit(0).cast("bigint")).alias("file_size"))


# ---------------------------------------------------------------- S9

def read_chunk_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``{doc_id, chunks[]}`` JSON messages, one per file, pretty-printed or
    not, with or without a UTF-8 byte-order mark (which Spark's JSON reader
    rejects): each file is read whole as text, the mark is dropped, then parsed."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_replace("value", "^\uFEFF", "")
    return raw.select(F.from_json(body, CHUNK_PAYLOAD).alias("p")).select("p.*")


def payload_chunks(payloads: DataFrame):
    """``(chunks, rejects)``; a payload without ``doc_id`` or chunks is rejected."""
    bad = F.col("doc_id").isNull() | (F.col("doc_id") == "") | F.coalesce(F.size("chunks") <= 0, F.lit(True))
    rejects = payloads.where(bad).select("doc_id", F.lit("payload names no document or holds no chunk").alias("reason"))
    rows = payloads.where(~bad).select("doc_id", F.explode("chunks").alias("c")).select(
        "doc_id", "c.chunk_id", "c.text",
        F.coalesce("c.start_char", F.lit(0)).alias("start_char"),
        F.coalesce("c.end_char", F.lit(0)).alias("end_char"))
    return rows, rejects


MAX_PAYLOAD_CHUNKS = 500      # chunks per message; a long document sends several


def chunk_payload_json(chunks: DataFrame, max_chunks: int = MAX_PAYLOAD_CHUNKS) -> DataFrame:
    """Inverse of :func:`payload_chunks`: JSON messages of at most ``max_chunks``
    consecutive chunks of one document, so no message (and no group) grows
    with the size of a document."""
    items = F.array_sort(F.collect_list(F.struct("chunk_id", "text", "start_char", "end_char")))
    part = F.floor(F.col("chunk_id") / max_chunks).alias("part")
    return chunks.groupBy("doc_id", part).agg(items.alias("chunks")).select(
        F.col("doc_id").cast("string").alias("doc_id"), "part",
        F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "chunks")).alias("value"))
