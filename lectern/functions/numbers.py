"""Number column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_number(x: Column, name: str = "value") -> tuple[Column, Column]:
    """An integral number as ``BIGINT`` (``<name>_int``), any other as ``DOUBLE``
    (``<name>_float``); one Spark column holds one type, so there are two."""
    integral = (x % 1) == 0
    return (F.when(integral, x.cast("bigint")).alias(f"{name}_int"),
            F.when(~integral, x.cast("double")).alias(f"{name}_float"))
