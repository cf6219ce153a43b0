"""Hedonic time-dummy index per group, from sufficient statistics.

Rows collapse to distinct (period, quality) combinations with a count and sums of ln(price); their
non-zero regressor pairs are then summed into the cross-product matrix, keyed by term names. Only
that matrix (never rows) reaches the Python solver. Levels of one categorical never meet in a row, so
their block is diagonal: the widest categorical is eliminated through it, and what is solved densely
has only the other terms. A group may have any number of levels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.core import require
from quotemill.functions.smallstats import plain_objects, t_two_sided_p
from quotemill.functions.staging import staged

_SCHEMA = (
    "term string, kind string, period string, coefficient double, std_err double, p_value double, "
    "index_value double, r_squared double, n_obs long, skip_reason string"
)


def cross_products(
    df: DataFrame, keys: Sequence[str], quality: Sequence[str], period: str = "period", price: str = "total_fare"
) -> DataFrame:
    """(keys, i, j, v): sums of x_i x_j over rows, ``__y`` standing for ln(price)."""
    require(df, [*keys, period, price, *quality], "hedonic")
    types = dict(df.dtypes)
    numeric = {q for q in quality if types[q].split("(")[0] in ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")}
    y = F.log(F.col(price).cast("double"))
    bad = F.coalesce(F.col(price).cast("double") <= 0, F.lit(True))
    absent = F.lit(False)
    for q in sorted(numeric):
        absent = absent | F.col(q).isNull() | F.isnan(F.col(q).cast("double"))
    compact = df.groupBy(*keys, period, *quality).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(y).alias("__sy"),
        F.sum(y * y).alias("__syy"),
        F.count_if(bad).alias("__bad"),
        F.count_if(absent).alias("__absent"),
    )
    one = F.lit(1.0)
    terms = [
        F.struct(F.lit("const").alias("t"), one.alias("x")),
        F.struct(F.concat(F.lit("period_"), F.col(period).cast("string")).alias("t"), one.alias("x")),
    ]
    for q in quality:
        if q in numeric:
            terms.append(F.struct(F.lit(q).alias("t"), F.col(q).cast("double").alias("x")))
        else:
            name = F.concat(F.lit(f"{q}__"), F.coalesce(F.col(q).cast("string"), F.lit("nan")))
            terms.append(F.struct(name.alias("t"), one.alias("x")))
    # (term, x) twice plus one entry for ln(price): every pair with i's position <= j's position
    pairs = []
    for a in range(len(terms)):
        for b in range(a, len(terms)):
            pairs.append(
                F.struct(
                    terms[a]["t"].alias("i"), terms[b]["t"].alias("j"),
                    (terms[a]["x"] * terms[b]["x"] * F.col("__n")).alias("v"),
                )
            )
        pairs.append(
            F.struct(terms[a]["t"].alias("i"), F.lit("__y").alias("j"), (terms[a]["x"] * F.col("__sy")).alias("v"))
        )
    pairs.append(F.struct(F.lit("__y").alias("i"), F.lit("__y").alias("j"), F.col("__syy").alias("v")))
    for flag in ("__bad", "__absent"):
        pairs.append(F.struct(F.lit(flag).alias("i"), F.lit(flag).alias("j"), F.col(flag).cast("double").alias("v")))
    return (
        compact.select(*keys, F.explode(F.array(*pairs)).alias("p"))
        .select(*keys, "p.i", "p.j", "p.v")
        .groupBy(*keys, "i", "j")
        .agg(F.sum("v").alias("v"))
    )


def _skip(reason: str, n: int = 0) -> pd.DataFrame:
    return pd.DataFrame([{"term": None, "kind": "skip", "n_obs": n, "skip_reason": reason}])


def _solve(pdf: pd.DataFrame, categorical: Sequence[str], reference: str | None, min_r2: float) -> pd.DataFrame:
    m = {(i, j): v for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"])}
    if m.get(("__bad", "__bad"), 0.0) > 0:
        return _skip("prices must be strictly positive")
    n = int(round(m[("const", "const")]))
    if m.get(("__absent", "__absent"), 0.0) > 0:
        return _skip("a numeric quality column has missing values", n)
    names = sorted({x for x in {*pdf["i"], *pdf["j"]} if not x.startswith("__")} - {"const"})
    periods = [x for x in names if x.startswith("period_")]
    if len(periods) < 2:
        return _skip("needs at least two periods", n)
    ref = f"period_{reference}" if reference is not None else periods[0]
    if ref not in periods:
        return _skip("reference period absent", n)
    levels = {q: [x for x in names if x.startswith(f"{q}__")][1:] for q in categorical}  # first category held out
    widest = max(levels.values(), key=len, default=[])
    dropped = {ref, *widest}
    for q in categorical:
        dropped.update([x for x in names if x.startswith(f"{q}__")][:1])
    inner = ["const", *[x for x in names if x not in dropped]]
    terms = [*inner, *widest]
    k, n_inner = len(terms), len(inner)
    at = {t: p for p, t in enumerate(terms)}
    a, cross = np.zeros((n_inner, n_inner)), np.zeros((n_inner, len(widest)))
    own, b = np.zeros(len(widest)), np.zeros(k)
    for (i, j), v in m.items():
        p, q = at.get(i), at.get(j)
        if j == "__y" and p is not None:
            b[p] = v
        elif p is None or q is None:
            continue
        elif max(p, q) < n_inner:
            a[p, q] = a[q, p] = v
        elif min(p, q) < n_inner:
            cross[min(p, q), max(p, q) - n_inner] = v
        else:
            own[p - n_inner] = v
    if n <= k or np.any(own <= 0) or np.any(np.diag(a) <= 0):
        return _skip("rank deficient", n)
    share = cross / own
    rest = a - share @ cross.T  # the inner terms' cross products within levels
    scale = np.sqrt(np.diag(a))
    spectrum = np.linalg.eigvalsh(rest / np.outer(scale, scale)) if np.all(np.isfinite(rest)) else np.zeros(1)
    if not spectrum[0] > 1e-10 * max(spectrum[-1], 1.0):
        return _skip("rank deficient", n)
    inv = np.linalg.inv(rest)
    head = inv @ (b[:n_inner] - share @ b[n_inner:])
    beta = np.concatenate([head, (b[n_inner:] - cross.T @ head) / own])
    spread = np.concatenate([np.diag(inv), 1.0 / own + np.einsum("kl,kl->l", share, inv @ share)])
    yy = m[("__y", "__y")]
    ssr = max(yy - float(beta @ b), 0.0)
    sst = yy - b[0] ** 2 / n
    r2 = 1.0 - ssr / sst if sst > 0 else float("nan")
    se = np.sqrt(np.maximum(spread * ssr / (n - k), 0.0))
    rows = []
    for name, coef, err in zip(terms, beta, se):
        t = coef / err if err > 0 else float("inf")
        rows.append(
            {
                "term": name,
                "kind": "period" if name.startswith("period_") else "regressor",
                "period": name[len("period_"):] if name.startswith("period_") else None,
                "coefficient": coef,
                "std_err": err,
                "p_value": t_two_sided_p(t, n - k),
                "index_value": float(np.exp(coef)) if name.startswith("period_") else None,
            }
        )
    rows.append({"term": ref, "kind": "reference", "period": ref[len("period_"):], "coefficient": 0.0, "index_value": 1.0})
    out = pd.DataFrame(rows)
    out["r_squared"], out["n_obs"] = r2, n
    out["skip_reason"] = f"R2 below {min_r2}" if not r2 >= min_r2 else None
    return out


def hedonic_time_dummy(
    df: DataFrame,
    keys: Sequence[str],
    quality: Sequence[str],
    min_r_squared: float = 0.3,
    reference_period=None,
    period: str = "period",
    price: str = "total_fare",
) -> DataFrame:
    """ln(price) on time dummies and quality, per group of ``keys``.

    Numeric quality columns are continuous, others one-hot with the first category held out. Rows:
    one per term (kind period / reference / regressor) with R2 and n, or a ``skip`` row (also where a
    numeric quality is null or NaN). A fit
    under ``min_r_squared`` keeps its rows but carries a ``skip_reason``.
    """
    keys = list(keys)
    gram = staged(cross_products(df, keys, quality, period, price), "gram")
    on = keys or ["__all"]
    if not keys:
        gram = gram.withColumn("__all", F.lit(1))
    types = dict(df.dtypes)
    categorical = [q for q in quality if types[q] in ("string", "boolean", "date")]
    ref = None if reference_period is None else str(reference_period)
    fields = [f"{k} {gram.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, _SCHEMA])
    columns = [c.split()[0] for c in schema.split(", ")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _solve(pdf, categorical, ref, min_r_squared)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return plain_objects(out, columns)

    return gram.groupBy(*on).applyInPandas(solve, schema)
