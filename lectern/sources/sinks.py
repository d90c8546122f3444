"""Batch sinks: keyed tables (K1 write_catalog, K2 write_chunk_embeddings) and the bulk index.

No lakehouse format is assumed. A keyed table is a Parquet folder partitioned
by a hash bucket of its key. An upsert merges the changes into the buckets
they fall in and replaces only those with Spark's dynamic partition overwrite
(staged files, moved in by the job's commit), so its cost follows the change,
not the table. Replaying an upsert writes the same rows again. One writer at a
time per table, as for any plain Parquet folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog as cat
from lectern.session import stored

BUCKETS = 64                 # hash buckets of a table; more for larger tables, fixed once it exists
RUN = 1024                   # consecutive chunk ids of a document that stay in one bucket
EMBEDDED_KEYS = ("doc_id", "chunk_id")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _bucket_name(df: DataFrame) -> str:
    return next((c for c in df.columns if c.startswith("bucket_of_")), "")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of a keyed table."""
    df = spark.read.parquet(path)
    return df.drop(_bucket_name(df))


def upsert(changes: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (),
           buckets: int = BUCKETS, run_of: str | None = None) -> DataFrame:
    """Insert or replace the rows of ``changes`` by key; returns the table as it is now.

    Of several changes of one key the one greatest in ``order`` (else in its
    other columns) wins. ``run_of`` names an integer column of which
    :data:`RUN` consecutive values share a bucket, so that a small document
    stays in one bucket and a huge one is spread. The number of buckets is
    part of the partition column's name; another number is an error.
    """
    return _merge(stored(changes, "upsert"), path, keys, order, buckets, run_of)


def _merge(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (),
           buckets: int = BUCKETS, run_of: str | None = None) -> DataFrame:
    """The upsert of changes that are already written somewhere (they are read twice).

    Old rows of the touched buckets and new ones go through one shuffle by
    bucket, and the latest of each key is taken where they meet.
    """
    spark = new.sparkSession
    name = f"bucket_of_{buckets}"
    spread = F.xxhash64(*[k for k in keys if k != run_of])
    if run_of:
        spread = spread + F.floor(F.coalesce(F.col(run_of), F.lit(0)) / RUN)
    new = new.withColumn(name, F.pmod(spread, F.lit(buckets)).cast("int")).withColumn("_new", F.lit(1))
    touched = [r[0] for r in new.select(name).distinct().collect()]        # at most ``buckets`` numbers
    there = _exists(spark, path)
    if not touched:
        return read_keyed(spark, path) if there else new.drop(name, "_new")
    both = new
    if there:
        old = spark.read.parquet(path)
        if _bucket_name(old) != name:
            raise ValueError(f"the table is kept in {_bucket_name(old)}, not {name}")
        both = old.where(F.col(name).isin(touched)).withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, name)]
    ordering = ["_new", *(order or [c for c in rest if c != "_new"])]
    latest = both.repartition(name).groupBy(name, *keys).agg(
        F.max_by(F.struct(*rest), F.struct(*ordering)).alias("_row")).select(name, *keys, "_row.*").drop("_new")
    (latest.sortWithinPartitions(name, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(name).parquet(path))
    return read_keyed(spark, path)


def write_catalog(changes: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """K1: upsert catalog rows by document."""
    return upsert(changes, path, ["doc_id"], buckets=buckets)


def write_chunk_embeddings(vectors: DataFrame, path: str, indexed_at: Column | None = None,
                           error: str | None = "error", buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """K2: upsert chunk vectors by ``(doc_id, chunk_id)`` with ``indexed_at``.

    Returns ``(table, rejects)``. A row with a model error (column ``error``),
    without a vector or without a key is not written: it goes to ``rejects
    (doc_id, chunk_id, reason)`` and leaves any older row of its key as it was.
    """
    said = F.col(error) if error and error in vectors.columns else F.lit(None).cast("string")
    reason = (F.when(F.col("doc_id").isNull() | F.col("chunk_id").isNull(), F.lit("missing key"))
              .when(said.isNotNull(), said)
              .when(F.col("embedding").isNull() | (F.size("embedding") == 0), F.lit("empty vector")))
    rows = vectors.withColumn("_reason", reason)
    rows = stored(rows.drop(error) if error else rows, "vectors")       # the model runs once for both sides
    good = rows.where(F.col("_reason").isNull()).drop("_reason").withColumn(
        "indexed_at", cat.utc_stamp() if indexed_at is None else indexed_at)
    rejects = rows.where(F.col("_reason").isNotNull()).select("doc_id", "chunk_id", F.col("_reason").alias("reason"))
    return _merge(good, path, EMBEDDED_KEYS, buckets=buckets, run_of="chunk_id"), rejects


def write_index(index: DataFrame, path: str) -> None:
    """K2 in bulk: chunk vectors by document, each file sorted on ``(doc_id, chunk_id)``.

    Sorted files give tight ``doc_id`` statistics per row group, so a lookup of
    one document (F5, S8) skips almost every row group. Runs of a very large
    document go to different files. The plan of ``index`` runs once (a range
    partitioning would run it twice, to sample it), and AQE sizes the files.
    """
    (index.repartition("doc_id", F.floor(F.col("chunk_id") / RUN))
     .sortWithinPartitions("doc_id", "chunk_id")
     .write.mode("overwrite").parquet(path))


def lookup_document(index: DataFrame, doc_id) -> DataFrame:
    """One document's chunks; the equality reaches the parquet scan."""
    return index.where(F.col("doc_id") == F.lit(doc_id))
