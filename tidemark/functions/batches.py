"""The size of the batches in which rows go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows in an Arrow batch, in place of Spark's default of 64 MB: trees of pages take many times their HTML, and so do products of vectors.
BATCH_BYTES, _DEFAULT_BYTES = 8 << 20, "67108864b"


def bound(spark: SparkSession | None = None) -> None:
    """Small batches in this session (the active one, if none is named), unless it asks for a size of its own."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == _DEFAULT_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
