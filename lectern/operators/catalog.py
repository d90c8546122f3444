"""Document catalog: build, status merge, listings and reports.

(F1, F7, F8, T3, T6, K1, K3, J3-J6, G1-G3, G7, C2, C6, C7, U1, W5)

The catalog is one row per document; chunk lists are kept in their own
(child) table instead of nested arrays, so no operator here gathers all
chunks of a document into one row.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import basename, document_label, short_id, stripped_length, thousands
from lectern.session import checkpoint_dir

# Fixed values.
MIN_DOCUMENT_CHARS = 50
STATUS_EXTRACTED = "text_extracted"
STATUS_PENDING = "pending"
STATUS_COMPLETED = "completed"
ALL_DOCUMENTS = "All Documents"
UNKNOWN = "unknown"
SHORT_REASON = "no extractable text (under %d characters)"

CATALOG_COLUMNS = ("doc_id", "filename", "bucket", "s3_key", "upload_date", "file_size",
                   "total_characters", "total_chunks", "processing_status", "embedding_status")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def document_id(path, modification_time) -> Column:
    """Deterministic document id (replays of the same upload get the same id)."""
    return F.sha2(F.concat_ws("|", _col(path), _col(modification_time).cast("string")), 256)


def utc_stamp(at: _dt.datetime | None = None) -> Column:
    """Ingest time as a naive UTC wall-clock ``TIMESTAMP_NTZ`` (the
    reference stores ``utcnow().isoformat()``); pass ``at`` to make runs
    reproducible."""
    if at is None:
        return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return F.to_timestamp_ntz(F.lit(at.strftime("%Y-%m-%d %H:%M:%S")))


def is_short(text: Column, min_chars: int = MIN_DOCUMENT_CHARS) -> Column:
    """no text, or less than ``min_chars`` characters of it when stripped."""
    return F.coalesce(stripped_length(text), F.lit(0)) < min_chars


def split_short_documents(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_DOCUMENT_CHARS):
    """``(accepted, rejected)``; a document whose stripped text is shorter
    than ``min_chars`` is rejected with a reason instead of failing the batch."""
    short = is_short(F.col(text_col), min_chars)
    accepted = docs.where(~short)
    rejected = docs.where(short).select("doc_id", F.lit(SHORT_REASON % min_chars).alias("reason"))
    return accepted, rejected


def catalog_from_chunks(chunks: DataFrame, upload_date: Column | None = None) -> DataFrame:
    """One catalog row per document, map-only.

    ``chunks`` must carry the document fields ``bucket, s3_key, file_size,
    total_characters`` and the chunker's ``total_chunks``; the row of chunk 0
    stands for its document (every accepted document has at least one chunk).
    """
    first = chunks.where(F.col("chunk_id") == 0)
    return first.select(
        "doc_id",
        basename("s3_key").alias("filename"),
        "bucket", "s3_key",
        (upload_date if upload_date is not None else utc_stamp()).alias("upload_date"),
        F.coalesce(F.col("file_size").cast("bigint"), F.lit(0).cast("bigint")).alias("file_size"),
        F.col("total_characters").cast("bigint").alias("total_characters"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"),
        F.lit(STATUS_EXTRACTED).alias("processing_status"),
        F.lit(STATUS_PENDING).alias("embedding_status"),
    )


def embeddings_count(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """G1: vectors per document (partial + final aggregation)."""
    return index.groupBy(key).agg(F.count(F.lit(1)).alias("embeddings_count"))


def merge_status(catalog: DataFrame, updates: DataFrame, how: str = "left") -> DataFrame:
    """Apply embedding results ``(doc_id, embeddings_count, embeddings_generated_at)``.

    A document is ``completed`` only when a result row exists for it, so the
    status is derived from written vectors. ``how='full'`` reproduces an
    upsert that also creates rows for unknown ids (orphans, without filename).
    """
    u = updates.select("doc_id", "embeddings_count", "embeddings_generated_at").withColumn("_seen", F.lit(True))
    j = catalog.join(u, "doc_id", how)
    return j.withColumn(
        "embedding_status",
        F.when(F.col("_seen"), F.lit(STATUS_COMPLETED)).otherwise(F.col("embedding_status")),
    ).drop("_seen")


def status_from_vectors(catalog: DataFrame, expected: DataFrame, written: DataFrame) -> DataFrame:
    """K3: status of every document from the vectors that really are in the table.

    ``expected`` and ``written`` are rows keyed by ``doc_id`` (the chunks to be
    embedded, the stored vectors). A document is ``completed`` when it has
    vectors and none is missing; with a failed or empty one it stays as it is.
    """
    both = (expected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_expected"))
            .join(embeddings_count(written), "doc_id", "left"))
    n = F.coalesce(F.col("embeddings_count"), F.lit(0))
    return catalog.join(both, "doc_id", "left").withColumn("embeddings_count", n).withColumn(
        "embedding_status", F.when((n > 0) & (n >= F.col("_expected")), F.lit(STATUS_COMPLETED))
        .otherwise(F.col("embedding_status"))).drop("_expected")


def orphan_results(updates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Results whose document is not in the catalog."""
    return updates.join(catalog.select("doc_id"), "doc_id", "left_anti")


def pending_documents(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Catalog documents with no embedding result yet."""
    return catalog.join(updates.select("doc_id"), "doc_id", "left_anti")


def ready_documents(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Catalog documents that have results (semi join)."""
    return catalog.join(updates.select("doc_id"), "doc_id", "left_semi")


def status_class(status) -> Column:
    """Dashboard class of a status."""
    s = _col(status)
    return (F.when(s == STATUS_COMPLETED, F.lit("success"))
            .when(s == STATUS_PENDING, F.lit("warning"))
            .otherwise(F.lit("info")))


def list_documents(catalog: DataFrame):
    """``(listing, rejects)``. The listing has the six display columns with
    defaults; rows lacking ``filename`` or ``upload_date`` go to ``rejects``
    instead of failing the whole list."""
    ok = F.col("filename").isNotNull() & F.col("upload_date").isNotNull()
    listing = catalog.where(ok).select(
        "doc_id", "filename", "upload_date",
        F.coalesce(F.col("total_chunks").cast("bigint"), F.lit(0).cast("bigint")).alias("total_chunks"),
        F.coalesce(F.col("embedding_status"), F.lit(UNKNOWN)).alias("embedding_status"),
        F.coalesce(F.col("file_size").cast("bigint"), F.lit(0).cast("bigint")).alias("file_size"),
    )
    rejects = catalog.where(~ok).select("doc_id", F.lit("missing filename or upload_date").alias("reason"))
    return listing, rejects


def document_count(listing: DataFrame) -> DataFrame:
    """Size of the listing."""
    return listing.agg(F.count(F.lit(1)).alias("count"))


def readiness(listing: DataFrame) -> DataFrame:
    """Documents ready for questions out of all."""
    return listing.agg(
        F.count_if(F.col("embedding_status") == STATUS_COMPLETED).alias("ready"),
        F.count(F.lit(1)).alias("total"))


def status_breakdown(listing: DataFrame) -> DataFrame:
    """Documents per dashboard class."""
    return listing.groupBy(status_class("embedding_status").alias("status_class")).agg(
        F.count(F.lit(1)).alias("documents"))


def get_documents(catalog: DataFrame, keys: DataFrame, heavy=("chunks_with_embeddings",)) -> DataFrame:
    """Look up many ids at once; ``found`` is false for unknown ids.

    Heavy columns are dropped before the join, so they are never read.
    """
    cat = catalog.drop(*[c for c in heavy if c in catalog.columns]).withColumn("found", F.lit(True))
    return keys.select("doc_id").join(cat, "doc_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def display_fields(listing: DataFrame) -> DataFrame:
    """Strings shown per document."""
    return listing.select(
        "doc_id",
        short_id("doc_id").alias("short_id"),
        F.date_format("upload_date", "yyyy-MM-dd").alias("upload_day"),
        thousands("file_size").alias("file_size_text"),
        document_label("filename", "embedding_status").alias("label"),
        status_class("embedding_status").alias("status_class"),
    )


def global_position(df: DataFrame, order_cols, name: str = "position", start: int = 1) -> DataFrame:
    """Consecutive 1-based positions in ``order_cols`` order without a single-task window.

    The sort range-partitions the rows; they are written once with the number
    of their partition and their place in it. Offsets are running sums over
    one small row per partition of that written copy, so a second evaluation
    of the sort cannot disagree with the first.
    """
    sorted_df = df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    path = f"{checkpoint_dir(df.sparkSession)}/positions-{uuid.uuid4().hex}"
    sorted_df.write.parquet(path)
    tagged = df.sparkSession.read.schema(sorted_df.schema).parquet(path)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(
        name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_row") + F.lit(start))
    return out.drop("_pid", "_row", "_off")


def document_options(listing: DataFrame) -> DataFrame:
    """Selector entries: ``All Documents`` first, then one label per document."""
    labelled = listing.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        document_label("filename", "embedding_status").alias("label"))
    numbered = global_position(labelled, ["doc_id"], start=1)
    first = listing.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("doc_id"), F.lit(ALL_DOCUMENTS).alias("label"),
        F.lit(0).cast("bigint").alias("position"))
    return first.unionByName(numbered)


def latest_per_key(df: DataFrame, key: str, order_cols) -> DataFrame:
    """Last write wins per key.

    Written as ``max_by`` over a struct, so each map task reduces a hot key
    to one row before the shuffle; a window would sort the hot key in one task.
    """
    rest = [c for c in df.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(key).agg(F.max_by(payload, ordering).alias("_row")).select(key, "_row.*")


def upsert(current: DataFrame, changes: DataFrame, key: str = "doc_id",
           version: str = "_version") -> DataFrame:
    """K1 upsert: the newer row per key wins over (current ∪ changes).

    Write the result to a *new* path (never over the table being read).
    """
    cur = current.withColumn(version, F.lit(0))
    new = changes.withColumn(version, F.lit(1))
    return latest_per_key(cur.unionByName(new, allowMissingColumns=True), key, [version]).drop(version)
