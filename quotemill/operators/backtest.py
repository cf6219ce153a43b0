"""Scoring an index against a reference series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(index: DataFrame, reference: DataFrame) -> DataFrame:
    """(scope, period, a, r) present and non-null on both sides."""
    a = index.select("scope", "period", F.col("value").cast("double").alias("a"))
    r = reference.select("scope", "period", F.col("value").cast("double").alias("r"))
    return a.join(r, ["scope", "period"]).where(F.col("a").isNotNull() & F.col("r").isNotNull())


def score(index: DataFrame, reference: DataFrame, min_periods: int = 5, rebase: bool = False) -> DataFrame:
    """Overlap, correlation, MAPE and directional accuracy per scope, all scopes in one plan.

    Fewer than ``min_periods`` shared periods leave every metric null and say so. ``rebase`` divides
    both series by their first shared value before the error is taken. Each scope holds one row per
    period, so its window is bounded by the calendar.
    """
    if min_periods < 2:
        raise ValueError("min_periods must be at least 2")
    order = Window.partitionBy("scope").orderBy("period")
    d = align(index, reference)
    if rebase:
        d = d.withColumn("__ea", F.try_divide(F.col("a"), F.first("a").over(order))).withColumn("__er", F.try_divide(F.col("r"), F.first("r").over(order)))
    else:
        d = d.withColumn("__ea", F.col("a")).withColumn("__er", F.col("r"))
    d = d.withColumn("__da", F.signum(F.col("a") - F.lag("a").over(order))).withColumn(
        "__dr", F.signum(F.col("r") - F.lag("r").over(order))
    )
    moved = F.coalesce(F.col("__dr") != 0, F.lit(False))
    agg = d.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min("period").alias("period_from"),
        F.max("period").alias("period_to"),
        # null for a constant side; the built-in correlation divides by zero there
        F.try_divide(F.covar_pop("a", "r"), F.stddev_pop("a") * F.stddev_pop("r")).alias("__corr"),
        (F.avg(F.abs(F.try_divide(F.col("__ea") - F.col("__er"), F.col("__er")))) * 100).alias("__mape"),
        (F.count_if(moved & (F.col("__da") == F.col("__dr"))) / F.nullif(F.count_if(moved), F.lit(0)) * 100).alias("__dir"),
    )
    scopes = index.select("scope").unionByName(reference.select("scope")).distinct()
    out = scopes.join(agg, "scope", "left").withColumn("n_periods", F.coalesce("n_periods", F.lit(0).cast("long")))
    ok = F.col("n_periods") >= min_periods
    note = (
        F.when(F.col("n_periods") == 0, "no overlapping periods")
        .when(~ok, F.format_string(f"only %d overlapping period(s); {min_periods} required", "n_periods"))
        .otherwise(F.format_string("%d overlapping period(s) scored", "n_periods"))
    )
    return out.select(
        "scope",
        "n_periods",
        "period_from",
        "period_to",
        F.when(ok, F.col("__corr")).alias("correlation"),
        F.when(ok, F.col("__mape")).alias("mape"),
        F.when(ok, F.col("__dir")).alias("directional_accuracy"),
        note.alias("coverage_note"),
    )


def common_scopes(index: DataFrame, reference: DataFrame, always: Sequence[str] = ("national",)) -> DataFrame:
    """Scopes scored: the national one always, routes only when both sides have them."""
    both = index.select("scope").intersect(reference.select("scope"))
    keep = index.select("scope").unionByName(reference.select("scope")).where(F.col("scope").isin(*always))
    return both.unionByName(keep).distinct()


def score_national_and_routes(index: DataFrame, reference: DataFrame, min_periods: int = 5, rebase: bool = False) -> DataFrame:
    return score(index, reference, min_periods, rebase).join(common_scopes(index, reference), "scope", "left_semi")


def reference_national(reference: DataFrame) -> DataFrame:
    """Unweighted mean across routes of per-period route means."""
    per_route = reference.groupBy("route_code", "period").agg(F.avg("fare").alias("fare"))
    return per_route.groupBy("period").agg(F.avg("fare").alias("value"), F.count(F.lit(1)).alias("n_routes"))


def backtest_inputs(latest: DataFrame, reference: DataFrame, prefix: str = "PX") -> tuple[DataFrame, DataFrame]:
    """(index, reference) with a common scope column from published series and reference fares."""
    parts = F.split("series_code", r"\.")
    scope = F.when(F.col("series_code") == f"{prefix}.ALL.M", "national").when(
        F.get(parts, F.lit(1)) == "ROUTE", F.get(parts, F.lit(2))
    )
    index = latest.withColumn("scope", scope).where(F.col("scope").isNotNull()).select("scope", "period", "value")
    routes = reference.groupBy(F.col("route_code").alias("scope"), "period").agg(F.avg("fare").alias("value"))
    national = reference_national(reference).select(F.lit("national").alias("scope"), "period", "value")
    return index, routes.unionByName(national)
