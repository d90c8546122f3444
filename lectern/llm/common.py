"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import checkpoint_dir

#: Separators of words, as in the class [\x20\x09-\x0D].
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{root.rstrip('/')}/lectern-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use at several places of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra input columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
