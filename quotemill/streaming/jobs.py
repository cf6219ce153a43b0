"""Structured Streaming jobs: ledger ingestion, daily fare series, surge watch.

Every job takes a streaming DataFrame and returns one; ``run_available`` drives a job over what is
there now and stops, which is how a scheduled sweep runs it. State is bounded by the watermark
(ledger, series) or by N values per route (surges).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.config import SurgeOptions
from quotemill.functions.staging import scratch_path
from quotemill.sources.ledger import append_quotes


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream with a declared schema. A single file is read by its folder and a name filter."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def ledger_stream(quotes: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each (content_hash, collected_at) once. Copies arriving within the lateness are dropped with
    bounded state; the ledger's own anti-join covers anything later."""
    return quotes.withWatermark("collected_at", lateness).dropDuplicatesWithinWatermark(["content_hash", "collected_at"])


#: Share of a day's values by which the median's rank may be off: the accuracy asked of the sketch.
MEDIAN_RANK_ERROR = 1e-4


def daily_fares(quotes: DataFrame, keys: list[str], lateness: str = "1 day", ts: str = "collected_at", price: str = "total_fare") -> DataFrame:
    """Tumbling daily fare statistics per route, emitted once a day is past the watermark. Mean and count are exact; the median comes from a
    mergeable quantile sketch, whose size does not grow with the day, and its rank is off by at most MEDIAN_RANK_ERROR of the day's values."""
    return (
        quotes.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 day"), *keys)
        .agg(
            F.avg(price).alias("mean_fare"),
            F.percentile_approx(price, 0.5, round(1 / MEDIAN_RANK_ERROR)).alias("median_fare"),
            F.count(F.lit(1)).alias("n_quotes"),
        )
        .select(*keys, F.to_date("window.start").alias("day"), "mean_fare", "median_fare", "n_quotes")
    )


_OUT = (
    "route_code string, travel_date date, fare double, baseline_median double, baseline_mad double, baseline_available boolean, is_surge boolean, is_late boolean"
)
_STATE = "days array<date>, fares array<double>, timer long"
_DAY_MS = 86_400_000


def _trailing(fares: np.ndarray, n_known: int, opts: SurgeOptions) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of the up to ``baseline_rows`` values before each value from place ``n_known`` on; NaN where there
    are fewer than ``min_history``. Full windows are taken together, the first few one by one."""
    median = np.full(len(fares) - n_known, np.nan)
    spread = median.copy()
    width = opts.baseline_rows
    for k in range(max(n_known, opts.min_history), min(width, len(fares))):
        median[k - n_known] = np.median(fares[:k])
        spread[k - n_known] = np.median(np.abs(fares[:k] - median[k - n_known]))
    first = max(n_known, width)
    if first < len(fares):
        past = np.lib.stride_tricks.sliding_window_view(fares[first - width : -1], width)
        middle = np.median(past, axis=1)
        median[first - n_known :] = middle
        spread[first - n_known :] = np.median(np.abs(past - middle[:, None]), axis=1)
    return median, spread


class SurgeWatch(StatefulProcessor):
    """Keeps the last values of each route, and a timer that forgets a route nothing was heard of for ``idle_days``."""

    def __init__(self, opts: SurgeOptions, idle_days: int):
        self.opts, self.idle_days = opts, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("baseline", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days, fares, timer = self.state.get() if self.state.exists() else ([], [], None)
        days, fares = list(days), np.array(fares, dtype=float)
        given = pd.concat(list(rows)).sort_values(["travel_date", "fare"], ignore_index=True)
        late = given["travel_date"].duplicated()
        if days:
            late |= given["travel_date"] <= days[-1]
        fresh = given[~late]
        everything = np.concatenate([fares, fresh["fare"].to_numpy(dtype=float)])
        median, spread = _trailing(everything, len(fares), self.opts)
        now = everything[len(fares) :]
        with np.errstate(invalid="ignore"):
            surge = (spread > 0) & (np.abs(now - median) > self.opts.k * spread)
        out = pd.DataFrame({"route_code": key[0], "travel_date": fresh["travel_date"], "fare": now, "baseline_median": median, "baseline_mad": spread})
        out["baseline_available"], out["is_surge"], out["is_late"] = ~np.isnan(median), surge, False
        if late.any():
            behind = given[late]
            nothing = pd.DataFrame({"route_code": key[0], "travel_date": behind["travel_date"], "fare": behind["fare"], "baseline_median": np.nan, "baseline_mad": np.nan})
            nothing["baseline_available"], nothing["is_surge"], nothing["is_late"] = False, False, True
            out = pd.concat([out, nothing]) if len(out) else nothing
        if len(fresh):
            keep = self.opts.baseline_rows
            days = [*days, *fresh["travel_date"]][-keep:]
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (days[-1] - dt.date(1970, 1, 1)).days * _DAY_MS + self.idle_days * _DAY_MS
            self.handle.registerTimer(timer)
            self.state.update((days, everything[-keep:].tolist(), timer))
        yield out.astype({"baseline_median": object, "baseline_mad": object}).where(out.notna(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def surge_stream(daily: DataFrame, opts: SurgeOptions = SurgeOptions(), lateness: str = "30 days", idle_days: int = 90) -> DataFrame:
    """Surge check of each (route_code, travel_date, fare) against the route's last N values.

    State is the last N daily values of a route. Rows of one micro-batch are taken in date order; a day at or before the newest one kept, or a second
    value of a day, comes out as ``is_late`` without a verdict and is left to the batch check. Days behind the watermark (``lateness`` after the newest day of any
    route) are dropped by Spark and counted in its progress report. A route without a new day for ``idle_days`` of event time is forgotten by a
    timer; if it returns, it starts afresh.
    """
    timed = daily.select("route_code", "travel_date", "fare", F.col("travel_date").cast("timestamp").alias("event_time")).withWatermark("event_time", lateness)
    return timed.groupBy("route_code").transformWithStateInPandas(SurgeWatch(opts, idle_days), _OUT, "append", "EventTime")


def append_stream(quotes: DataFrame, ledger_path: str, checkpoint: str) -> None:
    """Append everything available to the ledger, each micro-batch under its own name.

    No watermark: a copy is dropped however late it comes, as each batch is held against the days that the ledger has. A batch that is run again after a
    failure has the name it had, and is appended once.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_quotes(batch, ledger_path, f"{checkpoint}#{number}")

    q = quotes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


#: Keeps each state variable and timer of ``transformWithState`` in a column family of its own.
_STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, label: str, mode: str = "append", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a job over everything available into a table of the shared folder (a fresh one, or the one named) and read it."""
    spark = stream.sparkSession
    out, checkpoint = out or scratch_path(spark, label), checkpoint or scratch_path(spark, f"{label}-state")
    name, provider = _STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        # the query takes the setting when it starts
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
