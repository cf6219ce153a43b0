"""Exact grouped quantiles that never hold an unbounded group in one task.

Rows collapse to (group, value) counts, combined map-side, so copies of a value vanish before the
shuffle and a hot group spreads over all its values. That table is written once. A group is cut into
value buckets about 1 % wide, whatever the magnitude of the values: bucket totals give each bucket's
first rank (at most a few thousand buckets a group in use), and only the buckets holding a wanted rank
are ranked by value, one task per (group, bucket).

Quantiles are linearly interpolated between order statistics at ``(n - 1) * q``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.core import null_safe_join
from quotemill.functions.staging import staged

BUCKETS_PER_OCTAVE = 64
#: More than the bucket of the smallest positive double is below zero.
BELOW = 1100 * BUCKETS_PER_OCTAVE


def value_bucket(v: Column) -> Column:
    """Monotone bucket number, about 1 % wide at every magnitude; zero has a bucket of its own."""
    mag = F.floor(F.log2(F.abs(v)) * BUCKETS_PER_OCTAVE) + BELOW
    return F.when(v < 0, -mag).when(v > 0, mag).otherwise(0).cast("int")


def value_counts(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """(keys, v, n) as a written table: how often each non-null value occurs in each group."""
    v = F.col(value) if isinstance(value, str) else value
    counts = (
        df.select(*keys, v.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return staged(counts, "counts")


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], qs: dict[str, float], transform=None) -> DataFrame:
    """Quantiles of a (keys, v, n) table. ``transform`` maps values and must be increasing (for example
    ``F.log``). Returns keys, ``n_values`` and one column per entry of ``qs``."""
    keys = list(keys)
    f = transform or (lambda c: c)
    cv = counts.withColumn("v", F.col("v").cast("double")).withColumn("__b", value_bucket(F.col("v")))

    by_key = Window.partitionBy(*(keys or [F.lit(0)]))
    buckets = cv.groupBy(*keys, "__b").agg(F.sum("n").alias("__nb"))
    running = by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.select(
        *keys,
        "__b",
        "__nb",
        (F.sum("__nb").over(running) - F.col("__nb")).alias("__before"),
        F.sum("__nb").over(by_key).alias("__total"),
    )

    def bounds(q: float, total: Column) -> tuple[Column, Column, Column]:
        pos = (total - F.lit(1)) * F.lit(float(q))
        return pos, F.floor(pos), F.ceil(pos)

    def wanted(first: Column, size: Column) -> Column:
        tests = []
        for q in qs.values():
            _, lo, hi = bounds(q, F.col("__total"))
            tests += [(lo >= first) & (lo < first + size), (hi >= first) & (hi < first + size)]
        return reduce(lambda a, b: a | b, tests)

    target = buckets.where(wanted(F.col("__before"), F.col("__nb"))).drop("__nb")
    cand = null_safe_join(cv, target, [*keys, "__b"])
    in_bucket = (
        Window.partitionBy(*keys, "__b")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cand = cand.withColumn(
        "__first", F.col("__before") + F.sum("n").over(in_bucket) - F.col("n")
    )

    picks = [F.first("__total").alias("n_values")]
    for name, q in qs.items():
        _, lo, hi = bounds(q, F.col("__total"))
        for side, rank in (("lo", lo), ("hi", hi)):
            hit = (rank >= F.col("__first")) & (rank < F.col("__first") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col("v"))).alias(f"__{name}_{side}"))
    got = cand.groupBy(*keys).agg(*picks)

    out = []
    for name, q in qs.items():
        pos, lo, _ = bounds(q, F.col("n_values"))
        a, b = f(F.col(f"__{name}_lo")), f(F.col(f"__{name}_hi"))
        out.append((a + (b - a) * (pos - lo)).alias(name))
    return got.select(*keys, "n_values", *out)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    qs: dict[str, float],
    transform=None,
) -> DataFrame:
    """Exact quantiles of ``value`` per group. See the module text."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, qs, transform)
