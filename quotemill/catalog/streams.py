"""Streaming jobs run over the event table as it stands."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import views as V
from quotemill.catalog.registry import query
from quotemill.catalog.watch import SURGE, SURGE_ROWS, daily
from quotemill.catalog.views import with_views
from quotemill.functions.hashing import sha256_text
from quotemill.functions.staging import scratch_path
from quotemill.sources.ledger import read_ledger
from quotemill.streaming import jobs


def event_stream(spark, d):
    return jobs.read_stream(spark, f"{d}/events.parquet", V.TABLES["events"])


@query("st1_ledger_stream", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS day FROM events) GROUP BY 1")
def ledger_stream(spark, d):
    """One ledger row per (type, user, day): the hash ignores everything else, so repeats drop out."""
    e = event_stream(spark, d).select(
        "event_type",
        F.date_trunc("day", "ts").cast("timestamp").alias("collected_at"),
        sha256_text(F.concat_ws("|", "event_type", "user_id", F.to_date("ts"))).alias("content_hash"),
    )
    out = jobs.run_available(jobs.ledger_stream(e, "60 days"), "ledger")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _ledger_rows(e):
    return e.select(
        "event_type", "ts",
        F.date_trunc("day", "ts").cast("timestamp").alias("collected_at"),
        sha256_text(F.concat_ws("|", "event_type", "user_id", F.to_date("ts"))).alias("content_hash"),
    )


@query("st1_ledger_sink", "SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY ALL")
def ledger_sink(spark, d):
    """Events arrive in files of seven days each; with every file all earlier days of the same half of the users are sent once more, far beyond any
    lateness. The ledger holds each key once."""
    inbox, path, state = (scratch_path(spark, n) for n in ("inbox", "ledger", "ledger-state"))
    e = V.table(spark, d, "events")
    span = F.floor(F.datediff("ts", F.lit("1970-01-01")) / 7)
    sent = e.withColumn("part", F.explode(F.array(span, F.when(F.col("user_id") % 2 == 0, span + 1).otherwise(span + 2)))).repartition("part")
    # one file a part; names in order of time are read in order
    sent.sortWithinPartitions("part").write.option("maxRecordsPerFile", 0).partitionBy("part").parquet(inbox)
    stream = jobs.read_stream(spark, inbox, V.TABLES["events"], files_per_batch=2)
    jobs.append_stream(_ledger_rows(stream), path, state)
    jobs.append_stream(_ledger_rows(stream), path, state)  # nothing new: nothing is appended
    return read_ledger(spark, path).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "st2_daily_fares",
    """SELECT event_type AS route_code, CAST(ts AS DATE) AS day, count(*) AS n_quotes, round(avg(value), 6) AS mean_fare, TRUE AS median_within FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def daily_fares(spark, d):
    """Days already past the watermark. The median comes from a sketch; its rank among the day's values, counted in batch, must lie within the
    stated error of one half."""
    e = event_stream(spark, d).select(F.col("event_type").alias("route_code"), F.col("ts").cast("timestamp").alias("collected_at"), F.col("value").alias("total_fare"))
    out = jobs.run_available(jobs.daily_fares(e, ["route_code"]), "daily")
    rows = V.table(spark, d, "events").select(F.col("event_type").alias("route_code"), F.to_date("ts").alias("day"), "value")
    m = F.col("median_fare")
    placed = rows.join(out, ["route_code", "day"]).groupBy("route_code", "day", "n_quotes", "mean_fare").agg(
        F.count_if(F.col("value") < m).alias("below"), F.count_if(F.col("value") <= m).alias("upto")
    )
    slack = F.ceil(F.col("n_quotes") * jobs.MEDIAN_RANK_ERROR)
    half = F.col("n_quotes") / 2
    return placed.select("route_code", "day", "n_quotes", F.round("mean_fare", 6).alias("mean_fare"), ((F.col("below") <= half + slack) & (F.col("upto") >= half - slack)).alias("median_within"))


@query(
    "st3_surge_stream",
    with_views(
        """SELECT route_code, travel_date, med IS NOT NULL AS baseline_available, coalesce(mad > 0 AND abs(fare - med) > 3.0 * mad, FALSE) AS is_surge FROM s""",
        "fx_daily", s=SURGE_ROWS,
    ),
)
def surge_stream(spark, d):
    path = scratch_path(spark, "daily-fares")
    daily(spark, d).write.parquet(path)
    stream = jobs.read_stream(spark, path, "route_code string, travel_date date, fare double")
    return jobs.run_available(jobs.surge_stream(stream, SURGE), "surges").select("route_code", "travel_date", "baseline_available", "is_surge")
