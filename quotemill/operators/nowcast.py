"""Lagged regressions per series: bridge nowcast and distributed-lag pass-through."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.config import BridgeOptions
from quotemill.functions.core import null_safe_join
from quotemill.functions.smallstats import chi2_2_tail, full_rank, plain_objects, robust_cov, t_quantile, t_two_sided_p


def dlog(col: str, over) -> Column:
    x = F.log(F.col(col).cast("double"))
    return x - F.lag(x).over(over)


def lag_features(
    obs: DataFrame, keys: Sequence[str], regressors: dict[str, Sequence[int]], target: str, include_base: bool = True
) -> DataFrame:
    """Differences of logs and their lags, per series ordered by period.

    ``regressors`` maps a level column to the lags of its log difference to emit as
    ``d_<column>_lag<l>``; ``y`` is the target's log difference. ``known_at`` is the latest time any
    value used became known: lags up to the deepest one, plus the row before it, which the deepest
    difference also reads (``include_base=False`` leaves that row out). Rows are not dropped here.
    One row per (series, period), so each window is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy("period")
    d = obs.withColumn("y", dlog(target, w))
    for c in regressors:
        d = d.withColumn(f"__d_{c}", dlog(c, w))
    deepest = max(max(lags) for lags in regressors.values())
    known = [F.lag("collected_at", i).over(w) for i in range(deepest + 1 + int(include_base))]
    feats = [
        F.lag(f"__d_{c}", lag).over(w).alias(f"d_{c}_lag{lag}") for c, lags in regressors.items() for lag in lags
    ]
    return d.select(*keys, "period", *feats, "y", F.greatest(F.col("collected_at"), *known[1:]).alias("known_at"))


def feature_names(regressors: dict[str, Sequence[int]]) -> list[str]:
    return [f"d_{c}_lag{lag}" for c, lags in regressors.items() for lag in lags]


def complete_rows(features: DataFrame, names: Sequence[str]) -> DataFrame:
    return features.dropna(subset=[*names, "y", "known_at"])


def duplicate_periods(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series with more than one row for a period: refused, not guessed at."""
    return obs.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*keys).distinct()


_COEF = "term string, estimate double, std_error double, t_stat double, p_value double"
_FIT = (
    "n_obs long, r_squared double, adj_r_squared double, residual_std_error double, durbin_watson double, "
    "jarque_bera_pvalue double, point_growth double, low_growth double, high_growth double, skip_reason string"
)
FIT_SCHEMA = f"{_COEF}, {_FIT}"


def fit_rows(pdf: pd.DataFrame, names: Sequence[str], min_obs: int, cov: str, maxlags: int, level: float) -> pd.DataFrame:
    """OLS of one series. Rows with ``role = train`` are fitted, the ``role = predict`` row is forecast."""
    train = pdf[pdf["role"] == "train"].sort_values("period")
    n, k = len(train), len(names) + 1
    if n < max(min_obs, k + 1):
        return pd.DataFrame([{"n_obs": n, "skip_reason": f"only {n} usable rows; {max(min_obs, k + 1)} required"}])
    x = np.column_stack([np.ones(n), train[list(names)].to_numpy(float)])
    y = train["y"].to_numpy(float)
    xtx = x.T @ x
    if not full_rank(xtx):
        return pd.DataFrame([{"n_obs": n, "skip_reason": "rank deficient"}])
    inv = np.linalg.inv(xtx)
    beta = inv @ (x.T @ y)
    e = y - x @ beta
    dof = n - k
    ssr, sst = float(e @ e), float(((y - y.mean()) ** 2).sum())
    v = robust_cov(x, e, inv, cov, maxlags)
    se = np.sqrt(np.maximum(np.diag(v), 0.0))
    r2 = 1.0 - ssr / sst if sst > 0 else float("nan")
    m2, m3, m4 = (float((e**p).mean()) for p in (2, 3, 4))  # OLS residuals with a constant have mean 0
    jb = n / 6.0 * ((m3 / m2**1.5) ** 2 + (m4 / m2**2 - 3.0) ** 2 / 4.0) if m2 > 0 else float("nan")
    fit = {
        "n_obs": n,
        "r_squared": r2,
        "adj_r_squared": 1.0 - (1.0 - r2) * (n - 1) / dof,
        "residual_std_error": float(np.sqrt(ssr / dof)),
        "durbin_watson": float((np.diff(e) ** 2).sum() / ssr) if ssr > 0 else float("nan"),
        "jarque_bera_pvalue": chi2_2_tail(jb),
    }
    ahead = pdf[pdf["role"] == "predict"]
    if len(ahead):
        px = np.concatenate([[1.0], ahead[list(names)].to_numpy(float)[0]])
        mean = float(px @ beta)
        half = t_quantile(0.5 + level / 2.0, dof) * float(np.sqrt(px @ v @ px + ssr / dof))
        fit.update(point_growth=mean, low_growth=mean - half, high_growth=mean + half)
    rows = []
    for name, b, s in zip(["const", *names], beta, se):
        t = b / s if s > 0 else float("inf")
        rows.append({"term": name, "estimate": b, "std_error": s, "t_stat": t, "p_value": t_two_sided_p(t, dof), **fit})
    return pd.DataFrame(rows)


def grouped_regression(
    rows: DataFrame, keys: Sequence[str], names: Sequence[str], min_obs: int, cov: str = "nonrobust", maxlags: int = 0, level: float = 0.95
) -> DataFrame:
    """One small regression per series. A series is one row per period (checked upstream), so a
    group is bounded by the calendar; everything before and after stays in the JVM."""
    keys = list(keys)
    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, FIT_SCHEMA])
    columns = [c.split()[0] for c in schema.split(", ")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_rows(pdf, names, min_obs, cov, maxlags, level)
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return plain_objects(out, columns)

    return rows.groupBy(*keys).applyInPandas(solve, schema)


def fit_bridge(
    obs: DataFrame, target_period, as_of, opts: BridgeOptions = BridgeOptions(), keys: Sequence[str] = ("series_code",)
) -> tuple[DataFrame, DataFrame]:
    """(coefficients, nowcasts) of the bridge regression for every series.

    ``obs``: keys, period, index_value, target_value (nullable), collected_at. Rows depending on
    anything known after ``as_of`` are a look-ahead error: the series is refused, with a reason.
    """
    if opts.covariance not in ("HAC", "HC1"):
        raise ValueError(f"unsupported covariance {opts.covariance!r}")
    keys = list(keys)
    regressors = {"index_value": range(opts.n_index_lags + 1), "target_value": range(1, opts.n_target_lags + 1)}
    names = feature_names(regressors)
    dupes = duplicate_periods(obs, keys)
    clean = null_safe_join(obs, dupes, keys, "left_anti")
    feats = lag_features(clean, keys, regressors, "target_value")
    limit = F.lit(as_of).cast("timestamp")
    train = complete_rows(feats, names)
    late = train.where(F.col("known_at") > limit).select(*keys).distinct()
    # the target period's own row is forecast from its lags; it trains only once its value is known
    ahead = feats.where((F.col("period") == F.lit(target_period)) & F.expr(" and ".join(f"{n} is not null" for n in names)))
    rows = train.withColumn("role", F.lit("train")).unionByName(ahead.withColumn("role", F.lit("predict")))
    rows = null_safe_join(rows, late, keys, "left_anti").drop("known_at")
    fitted = grouped_regression(rows, keys, names, opts.min_observations, opts.covariance, opts.maxlags, opts.level)
    base = (
        clean.where(F.col("target_value").isNotNull() & (F.col("period") < F.lit(target_period)))
        .groupBy(*keys)
        .agg(F.max_by("target_value", "period").cast("double").alias("base_level"))
    )
    head = fitted.where(F.coalesce("term", F.lit("const")) == "const")
    fit_cols = ["n_obs", "r_squared", "adj_r_squared", "residual_std_error", "durbin_watson", "jarque_bera_pvalue"]
    level = lambda g: F.col("base_level") * F.exp(F.col(g))
    reason = F.coalesce(
        F.col("skip_reason"),
        F.when(F.col("point_growth").isNull(), "the target period has no complete lag structure"),
        F.when(F.col("base_level").isNull(), "no target value before the target period"),
    )
    nowcasts = null_safe_join(head, base, keys, "left").select(
        *keys,
        F.lit(target_period).alias("target_period"),
        *fit_cols,
        level("point_growth").alias("point_estimate"),
        level("low_growth").alias("ci_low"),
        level("high_growth").alias("ci_high"),
        reason.alias("skip_reason"),
    )
    empty = lambda df, why: df.select(*keys, F.lit(why).alias("skip_reason"))
    refused = empty(late, "look-ahead: a row depends on a value known after the as-of date").unionByName(
        empty(dupes, "more than one row for a period")
    )
    nowcasts = nowcasts.unionByName(refused.withColumn("target_period", F.lit(target_period)), allowMissingColumns=True)
    return fitted.where(F.col("skip_reason").isNull()).select(*keys, "term", "estimate", "std_error", "t_stat", "p_value"), nowcasts


def fit_passthrough(
    obs: DataFrame, max_lag: int = 6, min_obs: int = 24, as_of=None, keys: Sequence[str] = ("series_code",)
) -> DataFrame:
    """Distributed-lag regression of a fare on an input price, per series. ``obs``: keys, period,
    fare_value, input_price, collected_at."""
    keys = list(keys)
    regressors = {"input_price": range(max_lag + 1)}
    names = feature_names(regressors)
    clean = null_safe_join(obs, duplicate_periods(obs, keys), keys, "left_anti")
    train = complete_rows(lag_features(clean, keys, regressors, "fare_value"), names)
    if as_of is not None:
        late = train.where(F.col("known_at") > F.lit(as_of).cast("timestamp")).select(*keys).distinct()
        train = null_safe_join(train, late, keys, "left_anti")
    rows = train.drop("known_at").withColumn("role", F.lit("train"))
    return grouped_regression(rows, keys, names, min_obs).drop("point_growth", "low_growth", "high_growth")


def cumulative_passthrough(fit: DataFrame, keys: Sequence[str] = ("series_code",)) -> DataFrame:
    """Per lag: coefficient, standard error and running sum, in lag order."""
    lag = F.regexp_extract("term", r"_lag(\d+)$", 1)
    rows = fit.where(lag != "").withColumn("lag", lag.cast("int"))
    order = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *keys, "lag", F.col("estimate").alias("coefficient"), "std_error", F.sum("estimate").over(order).alias("cumulative_coefficient")
    )


def with_target_vintages(index: DataFrame, target: DataFrame, keys: Sequence[str] = ("period",)) -> DataFrame:
    """Index values left-joined to target values; known when the later of the two was."""
    t = target.select(*keys, "target_value", F.col("collected_at").alias("__t"))
    return index.join(t, list(keys), "left").withColumn("collected_at", F.greatest("collected_at", "__t")).drop("__t")
