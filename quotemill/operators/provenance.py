"""As-of policy decisions and the chain behind a quote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.core import null_safe_join


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Latest right row at or before each left row, per key; every left row is kept.

    Each key's timeline is cut into buckets, so a hot key spreads over its buckets: inside a bucket
    one ordered pass over the stacked rows answers left rows that have a right row in it, and the
    rest take the last right row of an earlier bucket, which is found on one row per (key, bucket).
    Right rows sort first at equal times, so ties count.
    """
    keys = list(keys)
    bucket = lambda ts: F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    payload = F.struct(F.col(right_ts).alias("__at"), *[F.col(c).alias(c) for c in columns])
    row = F.struct(*left.columns)
    events = right.select(
        *keys, bucket(right_ts).alias("__b"), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), payload.alias("__r"),
        F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType).alias("__l"),
    )
    asks = left.select(
        *keys, bucket(left_ts).alias("__b"), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"),
        F.lit(None).cast(events.schema["__r"].dataType).alias("__r"), row.alias("__l"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        events.unionByName(asks)
        .withColumn("__hit", F.last("__r", ignorenulls=True).over(inside))
        .where(F.col("__side") == 1)
        .select(*keys, "__b", "__l", "__hit")
    )
    # last right row per (key, bucket), carried into later buckets the left side uses
    ends = events.groupBy(*keys, "__b").agg(F.max_by("__r", F.struct("__ts", "__r")).alias("__end"))
    used = left.select(*keys, bucket(left_ts).alias("__b")).distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))
    points = ends.unionByName(used).groupBy(*keys, "__b").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.select(*keys, "__b", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    out = null_safe_join(seen, carried, [*keys, "__b"], "left")
    hit = F.coalesce("__hit", "__carry")
    return out.select("__l.*", hit["__at"].alias(f"matched_{right_ts}"), *[hit[c].alias(c) for c in columns])


def decisions_for_quotes(quotes: DataFrame, decisions: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Latest policy decision for each quote's (source, url hash) at or before its collection."""
    return as_of_join(
        quotes, decisions, ["source_id", "url_hash"], "collected_at", "decided_at", ["decision"], bucket_seconds
    )


def provenance_chain(
    quotes: DataFrame,
    runs: DataFrame,
    sources: DataFrame,
    policies: DataFrame,
    routes: DataFrame,
    clean: DataFrame,
    lineage: DataFrame,
) -> DataFrame:
    """Quote -> run -> source -> policy, route, treatment and number of index contributions.

    ``chain_broken`` names the first missing link; such quotes are reported, not dropped.
    """
    treatment = clean.select("quote_id", "clean_id", "is_outlier", "outlier_rule", "is_imputed")
    used = lineage.groupBy("clean_id").agg(F.count(F.lit(1)).alias("contributions"))
    # the narrow rows meet first; the wide ones are moved once
    treatment = treatment.join(used, "clean_id", "left")
    out = (
        quotes.join(runs.withColumn("__run", F.lit(True)), "collection_run_id", "left")
        .join(sources.withColumn("__source", F.lit(True)), "source_id", "left")
        .join(policies, "source_id", "left")
        .join(routes, "route_code", "left")
        .join(treatment, "quote_id", "left")
    )
    out = out.select("clean_id", *[c for c in out.columns if c != "clean_id"])
    broken = F.when(F.col("__run").isNull(), "collection_run").when(F.col("__source").isNull(), "source")
    return out.withColumn("chain_broken", broken).withColumn(
        "contributions", F.coalesce("contributions", F.lit(0).cast("long"))
    ).drop("__run", "__source")


def broken_chains(quotes: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Quotes whose run or source does not exist."""
    no_run = quotes.join(runs.select("collection_run_id"), "collection_run_id", "left_anti").select("quote_id", F.lit("collection_run").alias("missing_link"))
    no_source = quotes.join(sources.select("source_id"), "source_id", "left_anti").select("quote_id", F.lit("source").alias("missing_link"))
    return no_run.unionByName(no_source)
