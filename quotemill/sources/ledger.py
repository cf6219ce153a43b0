"""Append-only quote ledger and the tables a collection or index run leaves behind.

Both keep a log of commits (``commits``): rows count from the moment their attempt has an entry, all at once or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import hashing
from quotemill.functions.staging import staged
from quotemill.sources import commits

LEDGER_KEY = ("content_hash", "collected_at")


def _packed_keys(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("content_hash", hashing.packed(F.col("content_hash")))


def new_quotes(incoming: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Incoming rows without duplicates and without keys the ledger already holds. Hashes move as bytes, which are half as many as their digits."""
    fresh = _packed_keys(incoming).dropDuplicates(list(LEDGER_KEY))
    if existing is not None:
        fresh = fresh.join(_packed_keys(existing.select(*LEDGER_KEY)), list(LEDGER_KEY), "left_anti")
    return fresh.withColumn("content_hash", hashing.unpacked(F.col("content_hash"))).select(*incoming.columns)


def read_ledger(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """The quotes of all committed batches, or of those committed after a version. Folders of other attempts, which may go meanwhile, are not opened."""
    done = [r.attempt for r in commits.entries(spark, path).where(F.col("version") > after).select("attempt").toLocalIterator()]  # a name a batch
    return commits.read_attempts(spark, path).where(F.col("attempt").isin(done)).drop("attempt")


def append_quotes(incoming: DataFrame, path: str, batch_id: str | None = None) -> bool:
    """Append a batch to the ledger, partitioned by collection day. Keys already there are skipped; only the days present in the batch
    are read back. False if the batch was there before: a batch is appended once, however often it is sent.

    Two writers may append at once. The one that commits second looks at what the first has added: if a day is in both, its own attempt may hold
    keys that are in the ledger by now, so it is made again from what it had written and the entries added since, and thrown away; otherwise it stands.
    A batch's rows move once, to meet their keys; every task then writes the days it holds, so a batch of few days makes large files.
    """
    spark = incoming.sparkSession
    batch_id = batch_id or uuid.uuid4().hex
    day = F.to_date("collected_at")
    days = staged(incoming.select(day.alias("collected_day")).distinct(), "days")  # read by every attempt
    looked, left = 0, None  # the version that the attempt left behind has seen, and its folder
    while True:
        seen = commits.last_version(spark, path)
        done = commits.entries(spark, path)
        if seen and not done.where(F.col("key") == batch_id).isEmpty():
            commits.discard_attempt(spark, [left] if left else [])
            return False
        existing = read_ledger(spark, path, looked).join(days, "collected_day", "left_semi") if seen else None
        rows = spark.read.schema(incoming.schema).parquet(left).select(*incoming.columns) if left else incoming
        attempt = commits.new_attempt()
        folder = f"{path}/attempt={attempt}"
        new_quotes(rows, existing).withColumn("collected_day", day).write.partitionBy("collected_day").option("compression", "zstd").parquet(folder)
        commits.discard_attempt(spark, [left] if left else [])
        # one text a day of the batch: the calendar bounds them
        touched = sorted(str(r.collected_day) for r in days.toLocalIterator())

        def clash(newer: DataFrame, touched=touched) -> bool:
            theirs = newer.select("key", F.explode(F.split("touched", ";")).alias("day"))
            return not theirs.where(F.col("day").isin(touched) | (F.col("key") == batch_id)).isEmpty()

        if commits.commit(spark, path, batch_id, attempt, seen, touched, clash=clash):
            return True
        looked, left = seen, folder


def scan_window(quotes: DataFrame, start: Column, as_of: Column, columns: list[str] | None = None) -> DataFrame:
    """Quotes collected in [start, as_of]; filter and projection reach the scan."""
    q = quotes.where(F.col("query_date").between(start, as_of))
    return q.select(*columns) if columns else q


def scan_runs(runs: DataFrame, start, end) -> DataFrame:
    """Collection runs started in [start, end), with their collection day."""
    s = F.col("started_at")
    return runs.where((s >= F.lit(start).cast("timestamp")) & (s < F.lit(end).cast("timestamp"))).withColumn(
        "query_date", F.to_date("started_at")
    )


def write_run(frames: Mapping[str, DataFrame], out: str, run_id: str, meta: Mapping[str, object]) -> None:
    """Write every table of a run under ``out/<table>/index_run_id=<run_id>@<attempt>`` and commit all of them by one entry.

    A run written again replaces its tables at that moment; until then, and if a table fails, readers go on seeing the earlier ones whole. Of two
    writers of one run the later entry counts.
    """
    spark = next(iter(frames.values())).sparkSession
    attempt = commits.new_attempt()
    seen = commits.last_version(spark, out)
    folders = {name: f"{out}/{name}/index_run_id={run_id}@{attempt}" for name in frames}
    try:
        for name, df in frames.items():
            df.write.parquet(folders[name])
    except Exception:
        commits.discard_attempt(spark, list(folders.values()))
        raise
    commits.commit(spark, out, run_id, attempt, seen, detail={"tables": sorted(frames), **meta})


def committed_runs(spark: SparkSession, out: str) -> DataFrame:
    """(index_run_id, attempt, detail) of every committed run; ``detail`` is its manifest, as JSON."""
    return commits.latest(spark, out).withColumnRenamed("key", "index_run_id")


def read_run_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of all committed runs of one table, each from the attempt committed last."""
    done = committed_runs(spark, out).select(F.concat_ws("@", "index_run_id", "attempt").alias("__folder"), F.col("index_run_id").alias("__run"))
    rows = commits.read_attempts(spark, f"{out}/{table}").withColumnRenamed("index_run_id", "__folder")
    return rows.join(done, "__folder").drop("__folder").withColumnRenamed("__run", "index_run_id")
