"""Unweighted and bilateral price index formulas as aggregate expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.core import exact_avg, require

Formula = Callable[[Column, Column], Column]


def jevons(p_t: Column, p_0: Column) -> Column:
    return F.exp(F.avg(F.log(p_t / p_0)))


def dutot(p_t: Column, p_0: Column) -> Column:
    return F.avg(p_t) / F.avg(p_0)


def carli(p_t: Column, p_0: Column) -> Column:
    """Comparison only: biased upwards, not accepted as a published formula."""
    return F.avg(p_t / p_0)


_FORMULAS: dict[str, Formula] = {"jevons": jevons, "dutot": dutot, "carli": carli}
_UNPUBLISHABLE = {"carli"}


def register_formula(name: str, formula: Formula, publishable: bool = True) -> None:
    """Add an elementary formula: a function of (p_t, p_0) columns giving an aggregate column."""
    _FORMULAS[name] = formula
    if not publishable:
        _UNPUBLISHABLE.add(name)


def formula(name: str) -> Formula:
    try:
        return _FORMULAS[name]
    except KeyError:
        raise ValueError(f"unknown elementary formula {name!r}; have {sorted(_FORMULAS)}") from None


def publishable_formula(name: str) -> Formula:
    if name in _UNPUBLISHABLE:
        raise ValueError(f"{name!r} may be compared but not published")
    return formula(name)


def elementary_index(
    pairs: DataFrame, keys: Sequence[str], name: str = "jevons", p_t: str = "p_t", p_0: str = "p_0"
) -> DataFrame:
    """Index per group over matched pairs; pairs with a non-positive price give a null index."""
    require(pairs, [*keys, p_t, p_0], "elementary_index")
    a, b = F.col(p_t).cast("double"), F.col(p_0).cast("double")
    good = (a > 0) & (b > 0)
    bad = F.count_if(~F.coalesce(good, F.lit(False)))
    a, b = F.when(good, a), F.when(good, b)
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.when(bad == 0, formula(name)(a, b)).alias("index_value"),
    )


def formula_comparison(
    pairs: DataFrame, keys: Sequence[str], names: Sequence[str] = ("jevons", "dutot", "carli"), baseline: str = "jevons"
) -> DataFrame:
    """Several formulas side by side from one aggregation, with the change against the baseline."""
    a, b = F.col("p_t").cast("double"), F.nullif(F.col("p_0").cast("double"), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("n_pairs"), *[formula(n)(a, b).alias(n) for n in names]]
    out = pairs.groupBy(*keys).agg(*aggs)
    extra = [((F.try_divide(n, baseline) - 1) * 100).alias(f"{n}_vs_{baseline}_pct") for n in names if n != baseline]
    return out.select("*", *extra)


def boundary_pairs(
    quotes: DataFrame, product: Sequence[str], period: str, start, end, price: str = "total_fare"
) -> DataFrame:
    """Matched prices of each product at two periods (mean where a product has several quotes).

    One scan filtered to the two periods and one aggregation; both periods must be present.
    """
    at_start, at_end = F.col(period) == start, F.col(period) == end
    p = F.col(price)
    mean = lambda cond: F.sum(F.when(cond, p)).cast("double") / F.count(F.when(cond, p))
    return (
        quotes.where(at_start | at_end)
        .groupBy(*product)
        .agg(mean(at_start).alias("p_0"), mean(at_end).alias("p_t"))
        .where(F.col("p_0").isNotNull() & F.col("p_t").isNotNull())
    )


def consecutive_pairs(
    panel: DataFrame, product: Sequence[str], period: str, following: Column, values: dict[str, tuple[str, str]]
) -> DataFrame:
    """Each product's values beside its own values one period earlier.

    ``values`` maps a column to its (current, base) names and ``following`` gives the next period.
    Every row plays both roles, current at its own period and base at the following one, so one
    scan and one grouping replace a self-join. The panel holds one row per (product, period).
    """
    current = [F.col(c).alias(now) for c, (now, _) in values.items()]
    base = [F.col(c).alias(before) for c, (_, before) in values.items()]
    blank = lambda cols: [F.lit(None).cast("double").alias(n) for n in cols]
    nows, befores = [v[0] for v in values.values()], [v[1] for v in values.values()]
    roles = F.array(
        F.struct(F.col(period).alias(period), *current, *blank(befores)),
        F.struct(following.alias(period), *blank(nows), *base),
    )
    both = panel.select(*product, F.inline(roles)).groupBy(*product, period)
    out = both.agg(*[F.max(n).alias(n) for n in (*nows, *befores)])
    return out.where(F.col(nows[0]).isNotNull() & F.col(befores[0]).isNotNull())


def tornqvist_bilateral(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Törnqvist over matched products: columns p0, p1, s0, s1. Weights are the mean share,
    renormalised over the matched set; matched shares summing to zero give null."""
    w = (F.col("s0") + F.col("s1")) / 2
    r = F.log(F.try_divide("p1", "p0"))
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_products"),
        F.exp(F.sum(w * r) / F.nullif(F.sum(w), F.lit(0.0))).alias("index_value"),
    )


def unit_value_panel(
    sales: DataFrame, keys: Sequence[str], amount: Column, quantity: Column
) -> DataFrame:
    """Unit value ``price`` and expenditure ``share`` (not normalised) per key."""
    return sales.groupBy(*keys).agg(
        F.try_divide(F.sum(amount), F.sum(quantity)).alias("price"), F.sum(amount).alias("share")
    )


def mean_price_panel(quotes: DataFrame, keys: Sequence[str], price: str = "total_fare") -> DataFrame:
    """Mean price per (cell, period, product) with equal shares; also makes the key unique."""
    return quotes.groupBy(*keys).agg(
        exact_avg(price).alias("price"), F.lit(1.0).alias("share"), F.count(F.lit(1)).alias("n_quotes")
    )
