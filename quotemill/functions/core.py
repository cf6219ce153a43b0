"""Shared column helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Sequence[str], who: str) -> None:
    """Refuse a frame that lacks a column, naming the operator and what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{who}: missing columns {missing}")


def exact_avg(col: Column | str) -> Column:
    """Mean of an exact numeric as double. The decimal sum is order independent, so reruns agree."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).cast("double") / F.count(c)


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the key columns come from the left side.

    ``<=>`` stays an equi-join key for the planner, so this shuffles and sorts like any other
    equi-join and keeps AQE skew handling.
    """
    tagged = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(tagged[f"__r_{k}"]) for k in keys]
    )
    out = left.join(tagged, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def case_chain(pairs: Sequence[tuple[Column, object]], default=None) -> Column:
    """First matching condition wins."""
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out if default is None else out.otherwise(default)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def month_start(col: Column | str) -> Column:
    return F.trunc(col, "month")
