"""Exact split of an index movement into price, mix and tax effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.core import require

ELEMENTARY = (
    "route_code",
    "advance_window",
    "carrier_iata",
    "n_quotes_prior",
    "n_quotes_current",
    "index_value_prior",
    "index_value_current",
)


def bennet_two_factor(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price and mix effect of a weighted log sum: columns w0, w1, x0, x1."""
    w_bar, x_bar = (F.col("w0") + F.col("w1")) / 2, (F.col("x0") + F.col("x1")) / 2
    return df.groupBy(*keys).agg(
        F.sum(w_bar * (F.col("x1") - F.col("x0"))).alias("price_effect"),
        F.sum(x_bar * (F.col("w1") - F.col("w0"))).alias("mix_effect"),
    )


def _fold(df: DataFrame, keys: Sequence[str], w0: str, w1: str, mix: str, carried: Sequence[str]) -> DataFrame:
    """One level up: shares of (w0, w1) within ``keys`` weigh (x0, x1) and the carried effects.

    A share is a weight over its group's total, so every share-weighted sum is a plain weighted sum
    over that total: one aggregation, combined map-side, with no join back for the totals.
    """
    a, b, x0, x1 = (F.col(c) for c in (w0, w1, "x0", "x1"))
    mean0 = lambda c: F.try_divide(F.sum(a * c), F.sum(a))
    mean1 = lambda c: F.try_divide(F.sum(b * c), F.sum(b))
    x_bar = (x0 + x1) / 2
    return df.groupBy(*keys).agg(
        mean0(x0).alias("__x0"),
        mean1(x1).alias("__x1"),
        (mean1(x_bar) - mean0(x_bar)).alias(mix),
        *[((mean0(F.col(c)) + mean1(F.col(c))) / 2).alias(c) for c in carried],
    ).withColumnsRenamed({"__x0": "x0", "__x1": "x1"})


def hierarchy_change(
    elementary: DataFrame, booking: DataFrame, pax: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Telescoped split over carrier, window and route for each group of ``keys``.

    ``booking``: (advance_window, weight_prior, weight_current); ``pax``: (route_code, weight_prior,
    weight_current). Cells without a weight are left out; check them with ``unweighted``.
    """
    require(elementary, [*keys, *ELEMENTARY], "hierarchy_change")
    keys = list(keys)
    cell = elementary.withColumn("x0", F.log("index_value_prior")).withColumn("x1", F.log("index_value_current"))
    cell = cell.withColumn("pure_price_effect", F.col("x1") - F.col("x0"))
    by_window = _fold(
        cell, [*keys, "route_code", "advance_window"], "n_quotes_prior", "n_quotes_current",
        "carrier_mix_effect", ["pure_price_effect"],
    )
    by_route = _fold(
        by_window.join(booking, "advance_window"), [*keys, "route_code"], "weight_prior", "weight_current",
        "advance_window_mix_effect", ["pure_price_effect", "carrier_mix_effect"],
    )
    top = by_route.join(pax, "route_code").withColumn("__k", F.lit(1))
    out = _fold(
        top, [*keys, "__k"], "weight_prior", "weight_current", "route_mix_effect",
        ["pure_price_effect", "carrier_mix_effect", "advance_window_mix_effect"],
    )
    return out.withColumn("total_change", F.col("x1") - F.col("x0")).drop("x0", "x1", "__k")


def unweighted(elementary: DataFrame, booking: DataFrame, pax: DataFrame) -> DataFrame:
    """Windows and routes without a configured weight."""
    w = elementary.select(F.col("advance_window").alias("code")).distinct().join(
        booking.select(F.col("advance_window").alias("code")), "code", "left_anti"
    ).select(F.lit("advance_window").alias("kind"), "code")
    r = elementary.select(F.col("route_code").alias("code")).distinct().join(
        pax.select(F.col("route_code").alias("code")), "code", "left_anti"
    ).select(F.lit("route_code").alias("kind"), "code")
    return w.unionByName(r)


def decompose_movement(
    total: DataFrame, base: DataFrame, booking: DataFrame, pax: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Price, carrier, window and route mix from the base-fare cells; tax and fee effect is what the
    total-fare movement adds to the base-fare movement. ``residual`` is zero up to rounding."""
    keys = list(keys)
    t = hierarchy_change(total, booking, pax, keys).select(*keys, F.lit(1).alias("__k"), "total_change")
    b = hierarchy_change(base, booking, pax, keys).withColumnRenamed("total_change", "base_change").withColumn("__k", F.lit(1))
    parts = ["pure_price_effect", "carrier_mix_effect", "advance_window_mix_effect", "route_mix_effect", "tax_fee_effect"]
    out = t.join(b, [*keys, "__k"]).withColumn("tax_fee_effect", F.col("total_change") - F.col("base_change"))
    summed = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return out.select(*keys, "total_change", *parts, (F.col("total_change") - summed).alias("residual"))
