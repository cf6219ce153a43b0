"""Multilateral indices for every cell in one plan.

A panel is long: one row per (cell..., period, product_id) with ``price`` and ``share``. The row
key must be unique (see the panel builders in ``elementary``), so one (cell, product) never holds
more rows than the window has periods; that bounds the pair join below whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.core import case_chain, null_safe_join, require
from quotemill.functions.smallstats import full_rank, plain_objects
from quotemill.functions.staging import staged
from quotemill.operators.cleaning import product_id
from quotemill.operators.elementary import consecutive_pairs, mean_price_panel

PANEL = ("period", "product_id", "price", "share")


def panel_problems(panel: DataFrame, cells: Sequence[str], max_span: int | None = None) -> DataFrame:
    """Per cell: row and period counts, whether it has no weights at all, and ``skip_reason`` where
    the panel is unusable."""
    require(panel, [*cells, *PANEL], "panel_problems")
    dated = dict(panel.dtypes)["period"] in ("date", "timestamp")
    last, first = F.max("period"), F.min("period")
    span = F.datediff(last, first) if dated else (last - first)
    out = panel.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(F.col("price") <= 0, F.lit(True))).alias("__bad_price"),
        F.count_if(F.coalesce(F.col("share") < 0, F.lit(True))).alias("__bad_share"),
        F.size(F.collect_set("period")).cast("long").alias("n_periods"),  # bounded by the calendar
        span.cast("long").alias("__span"),
        (F.max("share") == 0).alias("weightless"),  # all-zero shares mean equal weights
    )
    tests = [
        (F.col("__bad_price") > 0, "prices must be strictly positive"),
        (F.col("__bad_share") > 0, "shares must be non-negative"),
        (F.col("n_periods") < 2, "needs at least two periods"),
    ]
    if max_span is not None:
        tests.append((F.col("__span") > max_span, "window longer than declared"))
    return out.withColumn("skip_reason", case_chain(tests)).drop("__bad_price", "__bad_share", "__span")


def bilateral_links(panel: DataFrame, cells: Sequence[str]) -> DataFrame:
    """ln Törnqvist between every ordered pair (l < t) of periods in each cell.

    Self-join on (cell, product) with ``l < t``; the reverse direction is the negative, so half the
    pairs are enough. Both sides are the same exchange, which the planner reuses.
    """
    product = [*cells, "product_id"]
    a = panel.select(*product, F.col("period").alias("l"), F.col("price").alias("p0"), F.col("share").alias("s0"))
    b = panel.select(*product, F.col("period").alias("t"), F.col("price").alias("p1"), F.col("share").alias("s1"))
    pairs = null_safe_join(a, b, product).where(F.col("l") < F.col("t"))
    w = (F.col("s0") + F.col("s1")) / 2
    r = F.log(F.try_divide("p1", "p0"))
    return pairs.groupBy(*cells, "l", "t").agg(
        F.count(F.lit(1)).alias("n_products"),
        (F.sum(w * r) / F.nullif(F.sum(w), F.lit(0.0))).alias("ln_index"),
    ).where(F.col("ln_index").isNotNull())  # matched shares summing to zero give no link


def geks_tornqvist(
    panel: DataFrame, cells: Sequence[str], max_span: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(levels, skips). Levels: cells, period, ``index_value`` with the first period at 1.

    C_t is the mean over all periods l of ln P(l, t), the own-period term being 0, and the level is
    exp(C_t - C_first). A period pair sharing no product fails its cell instead of being averaged
    over what is left: every period must have M - 1 links.
    """
    checked = panel_problems(panel, cells, max_span)
    links = bilateral_links(panel, cells)
    ends = F.array(
        F.struct(F.col("t").alias("period"), F.col("ln_index").alias("x")),
        F.struct(F.col("l").alias("period"), (-F.col("ln_index")).alias("x")),
    )
    per_period = (
        links.select(*cells, F.inline(ends))
        .groupBy(*cells, "period")
        .agg(F.sum("x").alias("__sum"), F.count(F.lit(1)).alias("__links"))
    )
    # Left join from the cells: one with no link at all must still be reported.
    w = null_safe_join(checked, per_period, cells, "left")
    by_cell = Window.partitionBy(*cells)  # one row per period of a cell
    m = F.col("n_periods")
    w = w.withColumn("__full", F.sum(F.coalesce("__links", F.lit(0))).over(by_cell) == m * (m - 1))
    good = F.col("skip_reason").isNull() & F.col("__full")
    levels = (
        w.where(good)
        .withColumn("__c", F.col("__sum") / m)
        .withColumn("__c0", F.min_by("__c", "period").over(by_cell))
        .select(*cells, "period", F.exp(F.col("__c") - F.col("__c0")).alias("index_value"))
    )
    skips = w.where(~good).groupBy(*cells).agg(
        F.coalesce(F.first("skip_reason"), F.lit("a pair of periods shares no product")).alias("skip_reason")
    )
    return levels, skips


# --- time-product dummy ---------------------------------------------------------------------


def tpd_normal_matrix(panel: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Weighted normal equations of the two-way dummy regression with products absorbed.

    A[t, s] = [t = s] w_t - sum_i w_it w_is / w_i and b[t] = sum_i w_it (y_it - ybar_i): one row
    per (cell, t, s). ``panel`` carries ``w`` and ``y``. A product's totals and its period pairs
    share one partitioning; what is left per cell after the sum is periods x periods.
    """
    product = [*cells, "product_id"]
    own = Window.partitionBy(*product)  # at most one row per period
    p = panel.withColumn("wi", F.sum("w").over(own)).withColumn("mean", F.try_divide(F.sum(F.col("w") * F.col("y")).over(own), F.col("wi")))
    p = p.where(F.col("wi") > 0)
    left = p.select(*product, F.col("period").alias("t"), F.col("w").alias("wt"), "wi", (F.col("w") * (F.col("y") - F.col("mean"))).alias("bt"))
    right = p.select(*product, F.col("period").alias("s"), F.col("w").alias("ws"))
    diagonal = F.col("t") == F.col("s")
    return (
        null_safe_join(left, right, product)
        .groupBy(*cells, "t", "s")
        .agg(
            F.sum(F.when(diagonal, F.col("wt")).otherwise(F.lit(0.0)) - F.col("wt") * F.col("ws") / F.col("wi")).alias("a"),
            F.sum(F.when(diagonal, F.col("bt")).otherwise(F.lit(0.0))).alias("b"),
        )
    )


def _solve_tpd(pdf: pd.DataFrame, cells: Sequence[str]) -> pd.DataFrame:
    """One cell's (t, s) normal equations to levels; the first period is the reference."""
    periods = sorted(pdf["t"].unique())
    pos = {t: i for i, t in enumerate(periods)}
    m = len(periods)
    a, b = np.zeros((m, m)), np.zeros(m)
    i, j = pdf["t"].map(pos).to_numpy(), pdf["s"].map(pos).to_numpy()
    np.add.at(a, (i, j), pdf["a"].to_numpy())
    np.add.at(b, i, pdf["b"].to_numpy())
    out = pd.DataFrame({"period": periods})
    sub = a[1:, 1:]
    if m >= 2 and full_rank(sub):
        out["index_value"] = np.exp(np.concatenate([[0.0], np.linalg.solve(sub, b[1:])]))
    else:
        out["index_value"] = np.nan
    for c in cells:
        out[c] = pdf[c].iloc[0]
    return plain_objects(out, list(out.columns))


def time_product_dummy(
    panel: DataFrame, cells: Sequence[str], max_span: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(levels, skips) of the share-weighted time-product-dummy index."""
    checked = panel_problems(panel, cells, max_span)
    usable = checked.where(F.col("skip_reason").isNull()).select(*cells, "weightless")
    weighted = null_safe_join(panel, usable, cells).select(
        *cells,
        "product_id",
        "period",
        F.when(F.col("weightless"), F.lit(1.0)).otherwise(F.col("share").cast("double")).alias("w"),
        F.log(F.col("price").cast("double")).alias("y"),
    )
    normal = tpd_normal_matrix(weighted, cells)
    schema = T.StructType(
        [
            T.StructField("period", normal.schema["t"].dataType),
            T.StructField("index_value", T.DoubleType()),
            *[normal.schema[c] for c in cells],
        ]
    )
    cells = list(cells)
    solved = normal.groupBy(*cells).applyInPandas(lambda pdf: _solve_tpd(pdf, cells), schema)
    solvable = F.col("index_value").isNotNull() & ~F.isnan("index_value")
    good = solved.where(solvable).select(*cells, "period", "index_value")
    deficient = (
        solved.where(~solvable).select(*cells).distinct().withColumn("skip_reason", F.lit("rank deficient"))
    )
    skips = checked.where(F.col("skip_reason").isNotNull()).select(*cells, "skip_reason").unionByName(deficient)
    return good, skips


def tpd_two_periods(panel: DataFrame, cells: Sequence[str], following: Column) -> DataFrame:
    """Closed form between each period and the one before: products weigh w0 w1 / (w0 + w1)."""
    h = F.try_divide(F.col("s0") * F.col("s1"), F.col("s0") + F.col("s1"))
    pairs = consecutive_pairs(
        panel, [*cells, "product_id"], "period", following, {"price": ("p1", "p0"), "share": ("s1", "s0")}
    )
    return pairs.groupBy(*cells, "period").agg(
        F.exp(F.try_divide(F.sum(h * F.log(F.try_divide("p1", "p0"))), F.sum(h))).alias("index_value")
    )


# --- elementary cells -----------------------------------------------------------------------


def elementary_cells(
    quotes: DataFrame,
    cells: Sequence[str],
    products: Sequence[str],
    period: str,
    as_of: Column,
    max_span: int | None = None,
    price: str = "total_fare",
) -> tuple[DataFrame, DataFrame]:
    """(cells, skips): GEKS level at the first period and at ``as_of``, quotes at ``as_of`` and the
    share of first-period products still observed at ``as_of``."""
    work = quotes.select(*cells, F.col(period).alias("period"), product_id(products).alias("product_id"), price)
    # the panel is an aggregate that five branches read
    panel = staged(mean_price_panel(work, [*cells, "period", "product_id"], price), "panel")
    levels, skips = geks_tornqvist(panel, cells, max_span)
    marked = null_safe_join(panel, panel.groupBy(*cells).agg(F.min("period").alias("__first")), cells)
    marks = marked.where((F.col("period") == F.col("__first")) | (F.col("period") == as_of))
    per_product = marks.groupBy(*cells, "product_id").agg(
        F.bool_or(F.col("period") == F.col("__first")).alias("__at_first"),
        F.bool_or(F.col("period") == as_of).alias("__at_last"),
        F.sum(F.when(F.col("period") == as_of, F.col("n_quotes"))).alias("__q"),
    )
    overlap = per_product.groupBy(*cells).agg(
        F.coalesce(F.sum("__q"), F.lit(0)).alias("n_quotes"),
        (F.lit(100.0) * F.count_if(F.col("__at_first") & F.col("__at_last")) / F.count_if("__at_first")).alias(
            "coverage_pct"
        ),
    )
    ends = levels.groupBy(*cells).agg(
        F.min_by("index_value", "period").alias("index_value_prior"),
        F.max(F.when(F.col("period") == as_of, F.col("index_value"))).alias("index_value"),
    )
    absent = ends.where(F.col("index_value").isNull()).select(*cells).withColumn(
        "skip_reason", F.lit("no observation at the as-of period")
    )
    good = null_safe_join(ends.where(F.col("index_value").isNotNull()), overlap, cells)
    return good, skips.unionByName(absent)
