"""Market-integrity checks: dispersion, sell-out velocity, surges, probe frequency, rail comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.config import SurgeOptions
from quotemill.functions.quantiles import grouped_quantiles


def dispersion(observations: DataFrame, keys: Sequence[str] = ("source_code", "flight_key", "probed_at"), population: bool = False) -> DataFrame:
    """Coefficient of variation of the fare across sessions per probe; one session gives 0."""
    std = F.stddev_pop("total_fare") if population else F.stddev_samp("total_fare")
    return observations.groupBy(*keys).agg(
        F.lit("coefficient_of_variation").alias("statistic_name"),
        (F.coalesce(std, F.lit(0.0)) / F.nullif(F.avg("total_fare"), F.lit(0.0))).alias("value"),
        F.count("total_fare").alias("n_sessions"),
        F.min("total_fare").alias("min_fare"),
        F.max("total_fare").alias("max_fare"),
    )


def sellout_velocity(missing: DataFrame, keys: Sequence[str], lead: str = "advance_days", min_group: int = 5) -> DataFrame:
    """Earliest lead at which a group was sold out, where it was sold out often enough."""
    return (
        missing.where(F.col("missing_reason") == "sold_out")
        .groupBy(*keys)
        .agg(F.max(lead).alias("first_sold_out_lead"), F.count(F.lit(1)).alias("sold_out_count"))
        .where(F.col("sold_out_count") >= min_group)
    )


def daily_median_fare(clean: DataFrame, keys: Sequence[str] = ("route_code", "travel_date"), lead: int | None = None, price: str = "total_fare") -> DataFrame:
    """Median fare per route and day; a fixed ``lead`` keeps the lead mix out of it."""
    q = clean if lead is None else clean.where(F.col("advance_days") == lead)
    return grouped_quantiles(q, keys, price, {"fare": 0.5}).drop("n_values")


def median_of(sorted_array: Column) -> Column:
    n = F.size(sorted_array)
    at = lambda i: F.get(sorted_array, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def detect_surges(fares: DataFrame, opts: SurgeOptions = SurgeOptions(), key: str = "route_code", day: str = "travel_date") -> DataFrame:
    """Fare against the median and MAD of up to N previous rows of its route, itself excluded.

    Input holds one row per (route, day), so a route's window is bounded by the calendar and each
    trailing array by N. Too little history is reported as unavailable; zero MAD flags nothing.
    """
    past = F.collect_list("fare").over(Window.partitionBy(key).orderBy(day).rowsBetween(-opts.baseline_rows, -1))
    d = fares.withColumn("__h", F.sort_array(past))
    enough = F.size("__h") >= opts.min_history
    d = d.withColumn("baseline_median", F.when(enough, median_of(F.col("__h"))))
    dev = F.sort_array(F.transform("__h", lambda x: F.abs(x - F.col("baseline_median"))))
    d = d.withColumn("baseline_mad", F.when(enough, median_of(dev)))
    hit = (F.col("baseline_mad") > 0) & (F.abs(F.col("fare") - F.col("baseline_median")) > F.lit(opts.k) * F.col("baseline_mad"))
    return d.select(
        key,
        day,
        "fare",
        "baseline_median",
        "baseline_mad",
        F.col("baseline_median").isNotNull().alias("baseline_available"),
        F.coalesce(hit, F.lit(False)).alias("is_surge"),
    )


def probe_allowed(probes: DataFrame, sources: DataFrame, now: Column, min_hours: float = 12.0) -> DataFrame:
    """Per source: hours since its last probe and whether a new one is allowed (never probed: yes)."""
    last = probes.groupBy("source_code").agg(F.max("probed_at").alias("last_probed_at"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last_probed_at")) / F.lit(3600.0)
    return sources.select("source_code").join(last, "source_code", "left").select(
        "source_code", "last_probed_at", hours.alias("hours_since"), F.coalesce(hours >= min_hours, F.lit(True)).alias("allowed")
    )


def compare_to_rail(airfare: DataFrame, rail: DataFrame) -> DataFrame:
    """Ratio and spread of air over rail fare per (route, period)."""
    return airfare.join(rail, ["route_code", "period"]).select(
        "route_code",
        "period",
        F.col("fare").alias("airfare"),
        "rail_fare",
        F.try_divide("fare", "rail_fare").alias("ratio"),
        (F.col("fare") - F.col("rail_fare")).alias("spread"),
    )
