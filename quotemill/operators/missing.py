"""Expected grid, missing cells, imputation and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.config import RAN_STATUSES
from quotemill.functions.core import exact_avg, null_safe_join, require

CELL = (
    "source_id",
    "route_id",
    "carrier_iata",
    "flight_number",
    "advance_days",
    "query_date",
    "travel_date",
)


def latest_runs(
    runs: DataFrame, keys: Sequence[str] = ("source_id", "route_id", "query_date"), order: str = "started_at"
) -> DataFrame:
    """Status of the newest run per key: one aggregation, combined map-side."""
    return runs.groupBy(*keys).agg(F.max_by("status", order).alias("status"))


def expected_from_history(quotes: DataFrame, runs: DataFrame, flight_columns: Sequence[str]) -> DataFrame:
    """Every flight seen from a source, expected on each day that source's run succeeded.

    The days of a source are one array, bounded by the calendar: a handful of rows meets the flights, so
    the planner broadcasts them and no task receives all flights of a source.
    """
    flights = quotes.select(*flight_columns).distinct()
    days = runs.where(F.col("status").isin(*RAN_STATUSES)).groupBy("source_id").agg(F.collect_set("query_date").alias("__days"))
    per_day = flights.join(days, "source_id").withColumn("query_date", F.explode("__days")).drop("__days")
    return per_day.withColumn(
        "travel_date", F.date_add("query_date", F.col("advance_days").cast("int"))
    )


def sampling_grid(routes: DataFrame, sources: Sequence[str], windows, query_date) -> DataFrame:
    """Planned cells: each route by each configured source and window, lead at the window middle.

    Sources and windows are configuration (a handful of literals), so the product is two array
    expansions of the route table and needs no join.
    """
    wins = F.array(
        *[F.struct(F.lit(w[0]).alias("code"), F.lit((w[1] + w[2]) // 2).alias("lead")) for w in windows]
    )
    return (
        routes.withColumn("source_code", F.explode(F.array(*[F.lit(s) for s in sources])))
        .withColumn("__w", F.explode(wins))
        .withColumn("advance_window", F.col("__w")["code"])
        .withColumn("advance_days", F.col("__w")["lead"])
        .drop("__w")
        .withColumn("query_date", query_date)
        .withColumn("travel_date", F.date_add("query_date", F.col("advance_days")))
    )


def missing_cells(expected: DataFrame, observed: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Expected cells without an observed row; null matches null on every identity column."""
    require(expected, keys, "missing_cells: expected")
    require(observed, keys, "missing_cells: observed")
    seen = observed.select(*keys).distinct()
    return null_safe_join(expected.select(*keys), seen, keys, "left_anti")


def classify_missing(
    missing: DataFrame,
    runs: DataFrame,
    run_keys: Sequence[str] = ("source_id", "route_id", "query_date"),
    ran: Sequence[str] = RAN_STATUSES,
) -> DataFrame:
    """``sold_out`` where the newest run looked and found nothing, else ``not_collected``."""
    status = latest_runs(runs, run_keys)
    looked = F.coalesce(F.col("status").isin(*ran), F.lit(False))
    return (
        null_safe_join(missing, status, run_keys, "left")
        .withColumn("missing_reason", F.when(looked, "sold_out").otherwise("not_collected"))
        .drop("status")
    )


def group_stats(clean: DataFrame, keys: Sequence[str], price: str = "total_fare") -> DataFrame:
    return clean.groupBy(*keys).agg(exact_avg(price).alias("cell_mean"), F.count(price).alias("cell_n"))


def impute_sold_out(
    sold_out: DataFrame,
    clean: DataFrame,
    keys: Sequence[str] = ("route_id", "advance_days", "carrier_type"),
    min_size: int = 3,
    price: str = "total_fare",
    method: str = "cell_mean",
) -> tuple[DataFrame, DataFrame]:
    """(imputed, unresolved). ``clean`` must already exclude flagged outliers."""
    require(sold_out, keys, "impute_sold_out")
    require(clean, [*keys, price], "impute_sold_out")
    w = null_safe_join(sold_out, group_stats(clean, keys, price), keys, "left")
    enough = F.coalesce(F.col("cell_n") >= min_size, F.lit(False))
    imputed = (
        w.where(enough)
        .withColumn(price, F.col("cell_mean"))
        .withColumn("is_imputed", F.lit(True))
        .withColumn("imputation_method", F.lit(method))
        .drop("cell_mean", "cell_n")
    )
    return imputed, w.where(~enough).drop("cell_mean", "cell_n")


def coverage(
    expected: DataFrame,
    observed: DataFrame,
    missing: DataFrame,
    imputed: DataFrame | None = None,
    keys: Sequence[str] = ("route_id", "advance_days"),
    cell: Sequence[str] = CELL,
    only_expected: bool = False,
) -> DataFrame:
    """Expected, observed, missing-by-reason and imputed counts per group, in one shuffle.

    The four inputs are tagged and stacked, so one conditional aggregation replaces a chain of
    joins. ``only_expected`` leaves observed cells outside the grid out of the count.
    """
    seen = observed.select(*cell).distinct()
    if only_expected:
        seen = null_safe_join(seen, expected.select(*cell).distinct(), cell, "left_semi")
    parts = [
        expected.select(*keys, F.lit("expected").alias("__kind")),
        seen.select(*keys, F.lit("observed").alias("__kind")),
        missing.select(*keys, F.col("missing_reason").alias("__kind")),
    ]
    if imputed is not None:
        parts.append(imputed.select(*keys, F.lit("imputed").alias("__kind")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    n = {k: F.count_if(F.col("__kind") == k) for k in ("expected", "observed", "not_collected", "sold_out", "imputed")}
    return (
        stacked.groupBy(*keys)
        .agg(*[c.alias(f"{k}_count") for k, c in n.items()])
        .where(F.col("expected_count") > 0)
        .withColumn("coverage_pct", F.lit(100.0) * F.col("observed_count") / F.col("expected_count"))
    )


def sold_out_share(missing: DataFrame, observed: DataFrame, lead: str, flight_day: Sequence[str]) -> DataFrame:
    """Share of distinct flight-days sold out, by lead."""
    a = missing.select(lead, *flight_day).distinct().select(lead, F.lit(1).alias("__m"))
    b = observed.select(lead, *flight_day).distinct().select(lead, F.lit(0).alias("__m"))
    return (
        a.unionByName(b)
        .groupBy(lead)
        .agg(F.sum("__m").alias("missing_n"), (F.count(F.lit(1)) - F.sum("__m")).alias("observed_n"))
        .withColumn("sold_out_share", F.col("missing_n") / (F.col("missing_n") + F.col("observed_n")))
    )
