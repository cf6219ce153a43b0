"""What every corpus job asks of its session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quotemill.functions.shipping import ship

#: Rows of an Arrow batch: whole texts travel in them, so far fewer than the default keep a Python worker small.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and keep Arrow batches of texts small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
