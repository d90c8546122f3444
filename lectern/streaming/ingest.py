"""Structured Streaming ingest (R1 stream_ingest, R2 stream_embed,
R3 stream_status, R4 stream_dedupe).

The streaming queries reuse the batch column functions and operators
unchanged: the chunk walk (``mapInArrow``) and the embedder are stateless
per row, so each micro-batch computes exactly what the batch job computes.

Sinks are exactly-once: chunk and vector tables use the parquet file sink
(its metadata log commits each micro-batch once), and status updates are
upserted by document in ``foreachBatch``, so a replay after a failure writes
the same rows again instead of appending duplicates.
Checkpoints and outputs live under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog as cat
from lectern.operators import chunking, embedding
from lectern.plans import retrieval
from lectern.session import checkpoint_dir
from lectern.sources import sinks

DEDUPE_WINDOW = "1 hour"      # replays of one object arriving within this span are dropped


def run_root(spark: SparkSession, name: str) -> str:
    """Fresh folder for one streaming run under the shared checkpoint dir."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def read_table_stream(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """Stream the parquet files of ``table`` as they land in ``folder``.

    The schema is fixed up front (a streaming file source cannot infer it),
    taken from the files already there. ``_ingest_time`` is the time of the
    micro-batch that reads the file, the event time used for replay
    de-duplication: a copied or back-filled file keeps an old modification
    time, but it can never arrive late by its arrival.
    """
    name = f"{table}.parquet" if not table.endswith(".parquet") else table
    if _is_dir(spark, f"{folder}/{name}"):        # a table written by Spark: a folder of parts
        src, opts = f"{folder}/{name}", {}
    else:                                          # one file per table next to the others
        src, opts = folder, {"pathGlobFilter": name}
    schema = spark.read.options(**opts).parquet(src).schema
    r = spark.readStream.schema(schema).options(**opts)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    s = r.parquet(src)
    return s.withColumn("_ingest_time", F.current_timestamp())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def chunk_stream(docs: DataFrame, text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Accepted documents of a stream -> chunk rows (same operator as batch).

    ``partitions`` spreads each micro-batch round-robin first, for sources
    that deliver few large files per trigger.
    """
    if partitions:
        docs = docs.repartition(partitions)
    accepted, _ = cat.split_short_documents(docs, text_col)
    return chunking.chunk_documents(accepted, text_col=text_col)


def dedupe_stream(chunks: DataFrame, keys=("doc_id", "chunk_id"), event_time: str = "_ingest_time",
                  window: str = DEDUPE_WINDOW) -> DataFrame:
    """Drop re-deliveries of the same chunk key.

    State is kept per key only while the watermark allows, so it stays
    bounded on an endless stream.
    """
    return chunks.withWatermark(event_time, window).dropDuplicatesWithinWatermark(list(keys))


def write_new(chunks: DataFrame, out: str, name: str, keys=("doc_id", "chunk_id")):
    """R4 without a time limit: only rows whose key is not in ``out`` yet are written.

    Each micro-batch is de-duplicated and anti-joined with the key columns
    already written, by whatever stream and however long ago; no state is
    kept, so none expires. Batches go to ``stream=<name>/batch=<n>``; a
    replayed batch leaves its own folder out of the comparison and rewrites
    it. ``name`` must be one stream's own, and streams into one folder must
    not run at the same time. The key columns of the whole table are read per
    micro-batch: :func:`dedupe_stream` is the cheaper form where copies come soon.
    """
    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        if _exists(spark, out):
            own = (F.col("stream") == name) & (F.col("batch") == batch_id)
            written = spark.read.parquet(out).where(~own).select(*keys)
            new = new.join(written, list(keys), "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/stream={name}/batch={batch_id}")

    return (chunks.writeStream.queryName(name).foreachBatch(sink)
            .option("checkpointLocation", f"{out}._checkpoint_{name}"))


def write_files(df: DataFrame, out: str, name: str):
    """Parquet file sink (exactly-once through its ``_spark_metadata`` log; a
    downstream file stream reading ``out`` sees only committed files)."""
    return (df.writeStream.queryName(name).format("parquet").option("path", out)
            .option("checkpointLocation", out + "._checkpoint").outputMode("append"))


def embed_stream(chunks: DataFrame, embedder=None, dim: int = embedding.HASH_DIM) -> DataFrame:
    """R2: chunk stream -> embedded chunk stream (F2 filter, then E1)."""
    kept = retrieval.embeddable_chunks(chunks)
    return embedding.embed(kept, "text", "embedding", embedder=embedder, dim=dim)


def status_upserts(path: str):
    """R3 sink: each micro-batch upserts its updated per-document counts into the
    keyed status table (only the buckets they fall in); a replayed batch
    writes the same rows again, so the sink is idempotent."""
    def sink(batch: DataFrame, batch_id: int):
        sinks.upsert(batch.select("doc_id", F.col("count").alias("embeddings_count")), path, ["doc_id"])
    return sink


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Current status: one row per document."""
    return sinks.read_keyed(spark, path)


def run_status(spark: SparkSession, embedded: DataFrame, root: str, name: str = "status") -> DataFrame:
    """Run the status query to completion; returns the current status table."""
    writer = (status_stream(embedded).writeStream.queryName(name).outputMode("update")
              .foreachBatch(status_upserts(root)).option("checkpointLocation", root + "._checkpoint"))
    run_available_now(writer)
    return read_status(spark, root)


def document_status_stream(chunks: DataFrame) -> DataFrame:
    """Running status per document, ``pending`` until every chunk is settled.

    ``chunks`` are all chunk rows with ``doc_id, total_chunks, text`` and
    ``embedding`` (NULL or empty: failed). A chunk is settled when it has a
    vector or is too short for one. Deliver each chunk once
    (:func:`dedupe_stream` or :func:`write_new` before it). JVM state only: a
    count per document, which is kept (there is no timer).
    """
    short = ~F.coalesce(retrieval.embeddable(F.col("text")), F.lit(False))
    written = F.coalesce(F.size("embedding") > 0, F.lit(False))
    counts = chunks.groupBy("doc_id").agg(
        F.max(F.col("total_chunks").cast("bigint")).alias("total"), F.count_if(written & ~short).alias("embeddings_count"),
        F.count_if(written | short).alias("settled"))
    done = (F.col("settled") >= F.col("total")) & (F.col("embeddings_count") > 0)
    return counts.select("doc_id", "embeddings_count", F.when(done, F.lit(cat.STATUS_COMPLETED))
                         .otherwise(F.lit(cat.STATUS_PENDING)).alias("embedding_status"))


def run_document_status(spark: SparkSession, chunks: DataFrame, path: str, name: str = "status") -> DataFrame:
    """Run the status query over what is there; returns the keyed status table."""
    def sink(batch: DataFrame, batch_id: int):
        sinks.upsert(batch, path, ["doc_id"])
    run_available_now(document_status_stream(chunks).writeStream.queryName(name).outputMode("update")
                      .foreachBatch(sink).option("checkpointLocation", path + "._checkpoint"))
    return read_status(spark, path)


def status_stream(embedded: DataFrame) -> DataFrame:
    """Running vector count per document (stateful aggregation, update mode)."""
    return embedded.groupBy("doc_id").count()


def run_available_now(writer) -> None:
    """Process everything available, then stop (tests, scheduled catch-up runs)."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def process_upload_events(events: DataFrame, object_root: str, out: str, parser,
                          ext: str = ".pdf", name: str = "uploads", tasks: int | None = None):
    """R1 in the reference's shape: upload-event messages trigger object reads.

    ``events`` is a stream of event JSON (column ``value``). Each micro-batch
    parses its records (S1, S2), keeps keys with ``ext`` (S3) and has its tasks
    open exactly those objects ``<object_root>/<bucket>/<key>`` and extract
    their text (S4, S5; :func:`lectern.sources.objects.fetch_documents`).
    The documents are written once to ``out._documents/batch=<n>``; from there
    short ones are rejected (F1), the chunks go to ``out/batch=<n>`` and every
    object that gave none (missing, unreadable, too short) to
    ``out._rejects/batch=<n>``. A replayed batch rewrites its own folders.
    Nothing is collected. An object announced again in a later batch is read
    again, under the same id while it is unchanged (:func:`write_new` drops
    such chunks).
    Returns the stream writer (call ``.start()`` or :func:`run_available_now`).
    """
    from lectern.sources import objects as src

    def sink(batch: DataFrame, batch_id: int):
        spark, folder = batch.sparkSession, f"batch={batch_id:012d}"
        keys = src.keep_extension(src.parse_upload_events(batch), ext)
        src.fetch_documents(keys, object_root, parser, tasks).write.mode("overwrite").parquet(f"{out}._documents/{folder}")
        docs = spark.read.parquet(f"{out}._documents/{folder}")
        short = cat.is_short(F.col("text"))
        chunking.chunk_documents(docs.where(F.col("error").isNull() & ~short).select("doc_id", "path", "text")).write.mode(
            "overwrite").parquet(f"{out}/{folder}")
        docs.where(F.col("error").isNotNull() | short).select(
            "path", F.coalesce("error", F.lit(cat.SHORT_REASON % cat.MIN_DOCUMENT_CHARS)).alias("reason")).write.mode(
            "overwrite").parquet(f"{out}._rejects/{folder}")

    return (events.writeStream.queryName(name).foreachBatch(sink)
            .option("checkpointLocation", out + "._checkpoint"))
