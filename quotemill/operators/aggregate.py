"""Weighted geometric roll-ups and the series hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.core import require, union_all


def combine_windows(values: DataFrame, weights: DataFrame, keys: Sequence[str], total_weight: float) -> DataFrame:
    """Weighted geometric mean over the windows present, weights renormalised; coverage is the
    weight present over ``total_weight``."""
    v = values.join(weights, "advance_window")
    return v.groupBy(*keys).agg(
        F.exp(F.try_divide(F.sum(F.col("weight") * F.log("index_value")), F.sum("weight"))).alias("index_value"),
        (F.lit(100.0) * F.sum("weight") / F.lit(total_weight)).alias("coverage_pct"),
    )


def weighted_rollup(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Weighted geometric mean of ``index_value``; ``n_quotes`` summed; coverage weighted by quotes."""
    require(df, [*keys, weight, "index_value", "n_quotes", "coverage_pct"], "weighted_rollup")
    w, n = F.col(weight), F.col("n_quotes")
    total = F.nullif(F.sum(w).cast("double"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.exp(F.sum(w * F.log("index_value")) / total).alias("index_value"),
        F.sum(n).alias("n_quotes"),
        F.coalesce(
            F.sum(n * F.col("coverage_pct")) / F.nullif(F.sum(n).cast("double"), F.lit(0.0)), F.lit(0.0)
        ).alias("coverage_pct"),
    )


def with_weight(df: DataFrame, weights: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(weighted rows, keys without a weight)."""
    j = df.join(weights.select(on, "weight"), on, "left")
    return j.where(F.col("weight").isNotNull()), j.where(F.col("weight").isNull()).select(on).distinct()


def assert_all_weighted(unweighted: DataFrame, what: str) -> None:
    """Action: refuse to roll up when a key has no configured weight."""
    rows = unweighted.limit(20).collect()
    if rows:
        raise ValueError(f"no weight configured for {what}: {sorted(str(r[0]) for r in rows)}")


def route_index(cells: DataFrame, booking_weights: DataFrame) -> DataFrame:
    """Route level: windows weighted by the booking profile."""
    weighted, _ = with_weight(cells, booking_weights, "advance_window")
    return weighted_rollup(weighted, ["route_code"], "weight")


def national_index(routes: DataFrame, pax_share: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one national row, excluded routes). Routes without a share are left out and listed."""
    weighted, excluded = with_weight(routes, pax_share, "route_code")
    total = weighted_rollup(weighted, [], "weight").where(F.col("index_value").isNotNull())
    return total, excluded


def sub_index_by(cells: DataFrame, column: str, weight: str = "n_quotes") -> DataFrame:
    return weighted_rollup(cells, [column], weight)


def series_hierarchy(
    cells: DataFrame, booking_weights: DataFrame, pax_share: DataFrame, prefix: str = "PX"
) -> DataFrame:
    """Route, headline, carrier-type and window series of one cross-section, with series codes.

    Each level has its own weights, so this is a union of roll-ups and not grouping sets.
    """
    cols = ["series_code", "index_value", "n_quotes", "coverage_pct"]

    def coded(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.withColumn("series_code", F.concat(F.lit(f"{prefix}.{kind}."), F.col(key), F.lit(".M"))).select(cols)

    by_window = weighted_rollup(cells, ["route_code", "advance_window"], "n_quotes")
    routes = route_index(by_window, booking_weights)
    national, _ = national_index(routes, pax_share)
    known = cells.withColumn("carrier_type", F.coalesce("carrier_type", F.lit("UNKNOWN")))
    return union_all(
        [
            coded(routes, "ROUTE", "route_code"),
            national.withColumn("series_code", F.lit(f"{prefix}.ALL.M")).select(cols),
            coded(sub_index_by(known, "carrier_type"), "CARRIERTYPE", "carrier_type"),
            coded(sub_index_by(cells, "advance_window"), "WINDOW", "advance_window"),
        ]
    )


def passenger_shares(routes: DataFrame, pairs: DataFrame, total_pax: int | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(route shares, routes missing from the extract). Half-even at eight places.

    ``total_pax`` is a number, or one row with a column of that name; a total that is not positive gives no shares. Shares are emitted only when no basket route is missing: an incomplete weight vector is never
    produced.
    """
    if isinstance(total_pax, int):
        if total_pax <= 0:
            raise ValueError("total_pax must be positive")
        total_pax = routes.sparkSession.range(1).select(F.lit(total_pax).alias("total_pax"))
    j = routes.join(pairs, ["origin_city", "dest_city"], "left")
    missing = j.where(F.col("passengers").isNull()).select("route_code")
    gaps = j.agg(F.count_if(F.col("passengers").isNull()).alias("__gaps"))  # one row
    share = F.bround((F.col("passengers").cast("decimal(18,0)") / F.col("__total")).cast("decimal(38,20)"), 8)
    total = total_pax.select(F.col("total_pax").cast("decimal(18,0)").alias("__total")).where("__total > 0")  # one row
    complete = j.crossJoin(F.broadcast(gaps)).where("__gaps = 0").crossJoin(F.broadcast(total))
    return complete.select("route_code", share.cast("decimal(9,8)").alias("pax_share")), missing
