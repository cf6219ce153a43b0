"""Knowledge-time filters, lag features, regressions, movement decomposition, back-test."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quotemill.catalog import views as V
from quotemill.catalog.registry import query
from quotemill.catalog.views import with_views
from quotemill.config import ADVANCE_WINDOWS, BOOKING_WEIGHTS, BridgeOptions
from quotemill.functions.staging import staged
from quotemill.operators import backtest, decomposition, nowcast, vintages


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- knowledge time --------------------------------------------------------------------------


@query("p12_filter_as_of", with_views("SELECT query_month, count(*) AS n FROM fx_quote WHERE collected_at <= TIMESTAMP '1998-06-15 00:00:00' GROUP BY 1", "fx_quote"))
def filter_as_of(spark, d):
    q = vintages.filter_as_of(V.quotes(spark, d, "query_month", "collected_at"), dt.date(1998, 6, 15))
    return q.groupBy("query_month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_look_ahead_report",
    with_views(
        """SELECT route_code, count(CASE WHEN collected_at > TIMESTAMP '2001-05-01 12:00:00' THEN 1 END) AS late_rows, max(CASE WHEN collected_at > TIMESTAMP '2001-05-01 12:00:00' THEN collected_at END) AS latest
FROM fx_quote GROUP BY 1""",
        "fx_quote",
    ),
)
def look_ahead_report(spark, d):
    return vintages.look_ahead_report(V.quotes(spark, d, "route_code", "collected_at"), "2001-05-01 12:00:00", keys=["route_code"])


# --- monthly series: mean price of one source (index) and of the other (target), per route ----

SERIES = """SELECT route_code AS series_code, query_month AS period, sum(CASE WHEN source_code = 'O' THEN total_c END) / 100.0 / count(CASE WHEN source_code = 'O' THEN 1 END) AS index_value,
  sum(CASE WHEN source_code = 'F' THEN total_c END) / 100.0 / count(CASE WHEN source_code = 'F' THEN 1 END) AS target_value,
  CAST(query_month + INTERVAL 40 DAY AS TIMESTAMP) AS collected_at FROM fx_quote GROUP BY ALL"""


def monthly(spark, d):
    q = V.quotes(spark, d, "route_code", "query_month", "source_code", "total_c")
    def mean(source: str):
        own = F.col("source_code") == source
        return F.try_divide(F.sum(F.when(own, F.col("total_c"))).cast("double") / 100, F.count_if(own))

    out = q.groupBy(F.col("route_code").alias("series_code"), F.col("query_month").alias("period")).agg(
        mean("O").alias("index_value"), mean("F").alias("target_value")
    )
    return out.withColumn("collected_at", F.date_add("period", 40).cast("timestamp"))


LAGS = """SELECT series_code, period, dx AS d_index_value_lag0, lag(dx, 1) OVER w AS d_index_value_lag1, lag(dx, 2) OVER w AS d_index_value_lag2, lag(y, 1) OVER w AS d_target_value_lag1, y,
  greatest(collected_at, lag(collected_at, 1) OVER w, lag(collected_at, 2) OVER w, lag(collected_at, 3) OVER w) AS known_at
FROM (SELECT *, ln(index_value) - lag(ln(index_value)) OVER w AS dx, ln(target_value) - lag(ln(target_value)) OVER w AS y FROM series WINDOW w AS (PARTITION BY series_code ORDER BY period))
WINDOW w AS (PARTITION BY series_code ORDER BY period)"""


@query(
    "w04_lag_features",
    with_views(
        """SELECT series_code, period, round(d_index_value_lag0, 6) AS d_index_value_lag0, round(d_index_value_lag1, 6) AS d_index_value_lag1, round(d_index_value_lag2, 6) AS d_index_value_lag2,
  round(d_target_value_lag1, 6) AS d_target_value_lag1, round(y, 6) AS y, known_at FROM lags
WHERE d_index_value_lag0 IS NOT NULL AND d_index_value_lag1 IS NOT NULL AND d_index_value_lag2 IS NOT NULL AND d_target_value_lag1 IS NOT NULL AND y IS NOT NULL""",
        "fx_quote", series=SERIES, lags=LAGS,
    ),
)
def lag_features(spark, d):
    r = {"index_value": range(3), "target_value": range(1, 2)}
    names = nowcast.feature_names(r)
    out = nowcast.complete_rows(nowcast.lag_features(monthly(spark, d), ["series_code"], r, "target_value"), names)
    return rounded(out, *names, "y")


@query(
    "j17_target_vintages",
    with_views(
        """SELECT a.series_code, a.period, a.index_value, b.target_value, greatest(a.collected_at, b.released) AS collected_at FROM series a
LEFT JOIN (SELECT series_code, period, target_value, collected_at + INTERVAL 5 DAY AS released FROM series WHERE month(period) <> 2) b USING (series_code, period)""",
        "fx_quote", series=SERIES,
    ),
)
def target_vintages(spark, d):
    m = staged(monthly(spark, d), "monthly")
    t = m.where(F.month("period") != 2).select("series_code", "period", "target_value", (F.col("collected_at") + F.expr("interval 5 days")).alias("collected_at"))
    return nowcast.with_target_vintages(m.drop("target_value"), t, ["series_code", "period"])


def bridge(spark, d):
    return nowcast.fit_bridge(staged(monthly(spark, d), "monthly"), dt.date(2001, 7, 1), dt.date(2002, 1, 1), BridgeOptions())


_BRIDGE_TERMS = ("const", "d_index_value_lag0", "d_index_value_lag1", "d_index_value_lag2", "d_target_value_lag1")
_BRIDGE_X = "[1.0, " + ", ".join(_BRIDGE_TERMS[1:]) + "]"
BRIDGE_STEPS = dict(
    series=SERIES,
    lags=LAGS,
    lagged=f"SELECT series_code AS key, period, {_BRIDGE_X} AS x, y FROM lags",
    complete="SELECT * FROM lagged WHERE y IS NOT NULL AND len(list_filter(x, lambda z: z IS NULL)) = 0",
    xrows="SELECT * FROM complete WHERE key IN (SELECT key FROM complete GROUP BY 1 HAVING count(*) >= 24)",
    **V.ols_steps(),
    # long-run covariance of x e with Bartlett weights up to three lags; an order t of rows per series
    ordered="SELECT key, row_number() OVER (PARTITION BY key ORDER BY period) AS t, list_transform(x, lambda z: z * e) AS u FROM residuals",
    long_run="""SELECT key, a, b, sum(v) AS v FROM (
  SELECT p.key, l, a, b, sum(p.u[a] * q.u[b] + p.u[b] * q.u[a]) * CASE WHEN l = 0 THEN 0.5 ELSE 1 - l / 4.0 END AS v
  FROM (SELECT *, unnest([0, 1, 2, 3]) AS l FROM ordered) p JOIN ordered q ON q.key = p.key AND q.t = p.t - p.l, range(1, 6) x(a), range(1, 6) y(b) GROUP BY p.key, l, a, b) GROUP BY key, a, b""",
    robust="""SELECT key, i, any_value(beta[i]) AS estimate, sqrt(greatest(sum(inverse[i][a] * inverse[i][b] * v), 0)) AS std_error
FROM (SELECT *, unnest(range(1, 6)) AS i FROM solved) JOIN long_run USING (key) GROUP BY key, i""",
    # the two-sided 95 % point of Student's t by halving an interval
    degrees="SELECT DISTINCT dof FROM fits",
    halved=f"""SELECT dof, 0 AS n, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi FROM degrees UNION ALL SELECT dof, n + 1, CASE WHEN inside < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN inside < 0.95 THEN hi ELSE (lo + hi) / 2 END
FROM (SELECT *, {V.within_t("((lo + hi) / 2)", "dof")} AS inside FROM halved WHERE n < 60)""",
    points="SELECT dof, (lo + hi) / 2 AS point FROM halved WHERE n = 60",
    target="SELECT key, x FROM lagged WHERE period = DATE '2001-07-01' AND len(list_filter(x, lambda z: z IS NULL)) = 0",
    ahead="SELECT key, list_dot_product(x, beta) AS mean, list_transform(inverse, lambda r: list_dot_product(r, x)) AS z FROM target JOIN solved USING (key)",
    spread="SELECT key, any_value(mean) AS mean, sum(z[a] * z[b] * v) AS variance FROM ahead JOIN long_run USING (key) GROUP BY key",
    base="SELECT series_code AS key, arg_max(target_value, period) AS level FROM series WHERE target_value IS NOT NULL AND period < DATE '2001-07-01' GROUP BY 1",
)


@query(
    "a30_bridge_coefficients",
    V.with_recursive(with_views(
        f"""SELECT key AS series_code, {list(_BRIDGE_TERMS)}[i] AS term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 6) AS t_stat,
  round(1 - {V.within_t("(estimate / std_error)", "dof")}, 6) AS p_value FROM robust JOIN fits USING (key)""",
        "fx_quote", **BRIDGE_STEPS,
    )),
)
def bridge_coefficients(spark, d):
    coef, _ = bridge(spark, d)
    return rounded(coef, "estimate", "std_error", "t_stat", "p_value")


@query(
    "a30_bridge_nowcast",
    V.with_recursive(with_views(
        """SELECT key AS series_code, DATE '2001-07-01' AS target_period, n_obs, round(r_squared, 4) AS r_squared, round(adj_r_squared, 4) AS adj_r_squared, round(residual_std_error, 4) AS residual_std_error,
  round(durbin_watson, 4) AS durbin_watson, round(jarque_bera_pvalue, 4) AS jarque_bera_pvalue, round(level * exp(mean), 4) AS point_estimate,
  round(level * exp(mean - point * sqrt(variance + ssr / dof)), 4) AS ci_low, round(level * exp(mean + point * sqrt(variance + ssr / dof)), 4) AS ci_high,
  CASE WHEN mean IS NULL THEN 'the target period has no complete lag structure' WHEN level IS NULL THEN 'no target value before the target period' END AS skip_reason
FROM fits JOIN points USING (dof) LEFT JOIN spread USING (key) LEFT JOIN base USING (key)
UNION ALL SELECT key, DATE '2001-07-01', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'only ' || count(*) || ' usable rows; 24 required' FROM complete GROUP BY key HAVING count(*) < 24""",
        "fx_quote", **BRIDGE_STEPS,
    )),
)
def bridge_nowcast(spark, d):
    _, now = bridge(spark, d)
    return rounded(now, "r_squared", "adj_r_squared", "residual_std_error", "durbin_watson", "jarque_bera_pvalue", "point_estimate", "ci_low", "ci_high", places=4)


# with a single regressor the fit has a closed form that SQL knows
@query(
    "a30_single_regressor",
    with_views(
        """SELECT series_code, round(regr_intercept(y, dx), 6) AS intercept, round(regr_slope(y, dx), 6) AS slope, round(regr_r2(y, dx), 6) AS r_squared, CAST(regr_count(y, dx) AS BIGINT) AS n_obs
FROM (SELECT series_code, ln(index_value) - lag(ln(index_value)) OVER w AS dx, ln(target_value) - lag(ln(target_value)) OVER w AS y FROM series WINDOW w AS (PARTITION BY series_code ORDER BY period))
WHERE dx IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
        "fx_quote", series=SERIES,
    ),
)
def single_regressor(spark, d):
    r = {"index_value": range(1)}
    rows = nowcast.complete_rows(nowcast.lag_features(monthly(spark, d), ["series_code"], r, "target_value"), nowcast.feature_names(r))
    fit = nowcast.grouped_regression(rows.drop("known_at").withColumn("role", F.lit("train")), ["series_code"], nowcast.feature_names(r), 24)
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    out = fit.groupBy("series_code").agg(
        pick("const").alias("intercept"), pick("d_index_value_lag0").alias("slope"), F.max("r_squared").alias("r_squared"), F.max("n_obs").alias("n_obs")
    )
    return rounded(out, "intercept", "slope", "r_squared")


PASS_LAGS = """SELECT *, [1.0, """ + ", ".join(f"lag(dx, {k}) OVER w" for k in range(7)) + """] AS x FROM (
  SELECT series_code, period, ln(index_value) - lag(ln(index_value)) OVER w AS dx, ln(target_value) - lag(ln(target_value)) OVER w AS y FROM series WINDOW w AS (PARTITION BY series_code ORDER BY period))
WINDOW w AS (PARTITION BY series_code ORDER BY period)"""
PASS_STEPS = dict(
    series=SERIES,
    lagged=PASS_LAGS,
    complete="SELECT series_code AS key, period, x, y FROM lagged WHERE y IS NOT NULL AND len(list_filter(x, lambda z: z IS NULL)) = 0",
    xrows="SELECT * FROM complete WHERE key IN (SELECT key FROM complete GROUP BY 1 HAVING count(*) >= 24)",
    **V.ols_steps(),
)
_R6 = lambda *names: ", ".join(f"round({c}, 6) AS {c}" for c in names)


def passthrough(spark, d):
    m = monthly(spark, d).withColumnsRenamed({"index_value": "input_price", "target_value": "fare_value"})
    return nowcast.fit_passthrough(m, 6, 24)


@query(
    "a31_passthrough",
    V.with_recursive(with_views(
        f"""SELECT key AS series_code, CASE WHEN i = 1 THEN 'const' ELSE 'd_input_price_lag' || (i - 2) END AS term, {_R6("estimate", "std_error")}, round(estimate / std_error, 6) AS t_stat,
  round(1 - {V.within_t("(estimate / std_error)", "f.dof")}, 6) AS p_value, n_obs,
  {_R6("r_squared", "adj_r_squared", "residual_std_error", "durbin_watson", "jarque_bera_pvalue")}, NULL AS skip_reason FROM terms JOIN fits f USING (key)
UNION ALL SELECT key, NULL, NULL, NULL, NULL, NULL, count(*), NULL, NULL, NULL, NULL, NULL, 'only ' || count(*) || ' usable rows; 24 required' FROM complete GROUP BY 1 HAVING count(*) < 24""",
        "fx_quote", **PASS_STEPS,
    )),
)
def passthrough_fit(spark, d):
    return rounded(passthrough(spark, d), "estimate", "std_error", "t_stat", "p_value", "r_squared", "adj_r_squared", "residual_std_error", "durbin_watson", "jarque_bera_pvalue")


@query(
    "a31_cumulative_passthrough",
    V.with_recursive(with_views(
        f"""SELECT key AS series_code, CAST(i - 2 AS INTEGER) AS lag, round(estimate, 6) AS coefficient, round(std_error, 6) AS std_error,
  round(sum(estimate) OVER (PARTITION BY key ORDER BY i), 6) AS cumulative_coefficient FROM terms WHERE i > 1""",
        "fx_quote", **PASS_STEPS,
    )),
)
def cumulative_passthrough(spark, d):
    out = nowcast.cumulative_passthrough(staged(passthrough(spark, d), "fit"))
    return rounded(out, "coefficient", "std_error", "cumulative_coefficient")


# --- movement decomposition ------------------------------------------------------------------

# cells (route, window, carrier) priced in two years; index value = mean price / 1000
DEC = f"""SELECT route_code, advance_window, carrier_iata, n0, n1, x0, x1 FROM (
  SELECT route_code, {V.WINDOW_SQL} AS advance_window, carrier_iata, count(CASE WHEN query_year = DATE '1998-01-01' THEN 1 END) AS n0, count(CASE WHEN query_year = DATE '1999-01-01' THEN 1 END) AS n1,
    ln(sum(CASE WHEN query_year = DATE '1998-01-01' THEN {{c}} END) / 100.0 / n0 / 1000) AS x0, ln(sum(CASE WHEN query_year = DATE '1999-01-01' THEN {{c}} END) / 100.0 / n1 / 1000) AS x1
  FROM fx_quote WHERE query_year IN (DATE '1998-01-01', DATE '1999-01-01') GROUP BY ALL) WHERE n0 > 0 AND n1 > 0"""
_L1 = """SELECT route_code, advance_window, sum(s0 * x0) AS x0, sum(s1 * x1) AS x1, sum((s0 + s1) / 2 * (x1 - x0)) AS price, sum((x0 + x1) / 2 * (s1 - s0)) AS carrier FROM (
  SELECT *, CAST(n0 AS DOUBLE) / sum(n0) OVER w AS s0, CAST(n1 AS DOUBLE) / sum(n1) OVER w AS s1 FROM {t} WINDOW w AS (PARTITION BY route_code, advance_window)) GROUP BY ALL"""
_L2 = """SELECT route_code, sum(s0 * x0) AS x0, sum(s1 * x1) AS x1, sum((s0 + s1) / 2 * price) AS price, sum((s0 + s1) / 2 * carrier) AS carrier, sum((x0 + x1) / 2 * (s1 - s0)) AS win FROM (
  SELECT *, weight / sum(weight) OVER (PARTITION BY route_code) AS s0, (weight + lo / 1000.0) / sum(weight + lo / 1000.0) OVER (PARTITION BY route_code) AS s1
  FROM ({t}) JOIN fx_window USING (advance_window)) GROUP BY ALL"""
_L3 = """SELECT sum(s1 * x1) - sum(s0 * x0) AS total, sum((s0 + s1) / 2 * price) AS price, sum((s0 + s1) / 2 * carrier) AS carrier, sum((s0 + s1) / 2 * win) AS win, sum((x0 + x1) / 2 * (s1 - s0)) AS route FROM (
  SELECT *, weight / sum(weight) OVER () AS s0, (weight + length(route_code)) / sum(weight + length(route_code)) OVER () AS s1 FROM ({t}) JOIN fx_pax USING (route_code))"""


def _hier(t: str) -> str:
    return _L3.format(t=_L2.format(t=_L1.format(t=t)))


ENDS = (("prior", dt.date(1998, 1, 1)), ("current", dt.date(1999, 1, 1)))


def movement_cells(q):
    """Cells priced at both ends, on total and on net prices, from one aggregation."""
    at = lambda y: F.col("query_year") == F.lit(y)
    c = q.groupBy("route_code", "advance_window", "carrier_iata").agg(
        *[F.count_if(at(y)).alias(f"n_quotes_{n}") for n, y in ENDS],
        *[F.sum(F.when(at(y), F.col(p))).alias(f"{p}_{n}") for n, y in ENDS for p in ("total_c", "net_c")],
    )
    return c.where((F.col("n_quotes_prior") > 0) & (F.col("n_quotes_current") > 0))


def priced_cells(c, price: str):
    keys = ["route_code", "advance_window", "carrier_iata", "n_quotes_prior", "n_quotes_current"]
    value = lambda n: (F.col(f"{price}_{n}").cast("double") / 100 / F.col(f"n_quotes_{n}") / 1000).alias(f"index_value_{n}")
    return c.select(*keys, value("prior"), value("current"))


def movement(spark, d):
    q = V.clean(spark, d, "route_code", "advance_window", "carrier_iata", "query_year", "total_c", "discount")
    q = q.where(F.col("query_year").isin(*[y for _, y in ENDS])).withColumn("net_c", F.floor(F.col("total_c") * (1 - F.col("discount"))))
    cells = staged(movement_cells(q), "cells")
    total, base = priced_cells(cells, "total_c"), priced_cells(cells, "net_c")
    lo = {w[0]: w[1] for w in ADVANCE_WINDOWS}
    booking = spark.createDataFrame(
        [(c, w, w + lo[c] / 1000.0) for c, w in BOOKING_WEIGHTS.items()], "advance_window string, weight_prior double, weight_current double"
    )
    pax = V.pax_weights(spark, d).select("route_code", F.col("weight").alias("weight_prior"), (F.col("weight") + F.length("route_code")).alias("weight_current"))
    return total, base, booking, staged(pax, "pax")


@query(
    "a29_movement_decomposition",
    with_views(
        """SELECT round(t.total, 6) AS total_change, round(b.price, 6) AS pure_price_effect, round(b.carrier, 6) AS carrier_mix_effect, round(b.win, 6) AS advance_window_mix_effect,
  round(b.route, 6) AS route_mix_effect, round(t.total - b.total, 6) AS tax_fee_effect, abs(b.price + b.carrier + b.win + b.route - b.total) < 1e-9 AS exact
FROM total t, base b""",
        "fx_quote", "fx_window", "fx_pax",
        cells_total=DEC.format(c="total_c"), cells_base=DEC.format(c="CAST(floor(total_c * (1 - discount)) AS BIGINT)"), total=_hier("cells_total"), base=_hier("cells_base"),
    ),
)
def movement_decomposition(spark, d):
    out = decomposition.decompose_movement(*movement(spark, d))
    parts = ("total_change", "pure_price_effect", "carrier_mix_effect", "advance_window_mix_effect", "route_mix_effect", "tax_fee_effect")
    return rounded(out, *parts).withColumn("exact", F.abs("residual") < 1e-9).drop("residual")


@query(
    "a28_bennet_two_factor",
    with_views(
        """SELECT route_code, round(sum((s0 + s1) / 2 * (x1 - x0)), 6) AS price_effect, round(sum((x0 + x1) / 2 * (s1 - s0)), 6) AS mix_effect FROM (
  SELECT *, CAST(n0 AS DOUBLE) / sum(n0) OVER w AS s0, CAST(n1 AS DOUBLE) / sum(n1) OVER w AS s1 FROM cells_total WINDOW w AS (PARTITION BY route_code)) GROUP BY 1""",
        "fx_quote", cells_total=DEC.format(c="total_c"),
    ),
)
def bennet_two_factor(spark, d):
    total = movement(spark, d)[0]
    s = vintages.share_within(vintages.share_within(total, ["route_code"], "n_quotes_prior", "w0"), ["route_code"], "n_quotes_current", "w1")
    s = s.withColumn("x0", F.log("index_value_prior")).withColumn("x1", F.log("index_value_current"))
    return rounded(decomposition.bennet_two_factor(s, ["route_code"]), "price_effect", "mix_effect")


@query(
    "a29_unweighted_cells",
    with_views("SELECT DISTINCT 'route_code' AS kind, route_code AS code FROM cells_total WHERE route_code NOT IN (SELECT route_code FROM fx_pax)", "fx_pax", cells_total=DEC.format(c="total_c")),
)
def unweighted_cells(spark, d):
    total, _, booking, pax = movement(spark, d)
    return decomposition.unweighted(total, booking, pax)


# --- back-test -------------------------------------------------------------------------------

INDEX = """SELECT CASE WHEN series_code = 'PX.ALL.M' THEN 'national' ELSE split_part(series_code, '.', 3) END AS scope, period, value FROM fx_latest"""
REF = """SELECT route_code, query_month AS period, CAST(sum(total_c) AS DOUBLE) / 100 / count(*) / 100 AS fare FROM fx_quote WHERE source_code = 'O' GROUP BY ALL"""
REFS = """SELECT route_code AS scope, period, fare AS value FROM ref UNION ALL SELECT 'national', period, avg(fare) FROM ref GROUP BY period"""
ALIGNED = "SELECT scope, period, a.value AS a, r.value AS r FROM idx a JOIN refs r USING (scope, period)"
SCORES = """SELECT scope, count(*) AS n_periods, min(period) AS period_from, max(period) AS period_to, round(corr(a, r), 6) AS correlation, round(avg(abs((a - r) / r)) * 100, 6) AS mape,
  round(CAST(count(CASE WHEN dr <> 0 AND dr = da THEN 1 END) AS DOUBLE) / count(CASE WHEN dr <> 0 THEN 1 END) * 100, 6) AS directional_accuracy, count(*) || ' overlapping period(s) scored' AS coverage_note
FROM (SELECT *, sign(a - lag(a) OVER w) AS da, sign(r - lag(r) OVER w) AS dr FROM aligned WINDOW w AS (PARTITION BY scope ORDER BY period)) GROUP BY 1"""
BACK = dict(ref=REF, refs=REFS, idx=INDEX, aligned=ALIGNED)


def backtest_sides(spark, d):
    l = staged(vintages.latest_values(V.index_values(spark, d), V.index_runs(spark, d)).select("series_code", "period", "value"), "latest")
    q = V.quotes(spark, d, "route_code", "query_month", "source_code", "total_c").where(F.col("source_code") == "O")
    ref = q.groupBy("route_code", F.col("query_month").alias("period")).agg((F.sum("total_c").cast("double") / 100 / F.count(F.lit(1)) / 100).alias("fare"))
    index, reference = backtest.backtest_inputs(l, staged(ref, "reference"))
    return index, staged(reference, "reference")


@query("a26_backtest_scores", with_views(SCORES, "fx_latest", **BACK))
def backtest_scores(spark, d):
    return rounded(backtest.score(*backtest_sides(spark, d)), "correlation", "mape", "directional_accuracy")


@query("a27_national_and_routes", with_views(f"SELECT scope, n_periods, correlation FROM ({SCORES})", "fx_latest", **BACK))
def national_and_routes(spark, d):
    out = backtest.score_national_and_routes(*backtest_sides(spark, d))
    return rounded(out.select("scope", "n_periods", "correlation"), "correlation")


@query(
    "a26_rebased_error",
    with_views(
        "SELECT scope, round(avg(abs((ea - er) / er)) * 100, 6) AS mape FROM (SELECT scope, a / first_value(a) OVER w AS ea, r / first_value(r) OVER w AS er FROM aligned WINDOW w AS (PARTITION BY scope ORDER BY period)) GROUP BY 1",
        "fx_latest", **BACK,
    ),
)
def rebased_error(spark, d):
    return rounded(backtest.score(*backtest_sides(spark, d), rebase=True).select("scope", "mape"), "mape")


@query("a25_reference_national", with_views("SELECT period, round(avg(fare), 6) AS value, count(*) AS n_routes FROM ref GROUP BY 1", "fx_quote", ref=REF))
def reference_national(spark, d):
    q = V.quotes(spark, d, "route_code", "query_month", "source_code", "total_c").where(F.col("source_code") == "O")
    ref = q.groupBy("route_code", F.col("query_month").alias("period")).agg((F.sum("total_c").cast("double") / 100 / F.count(F.lit(1)) / 100).alias("fare"))
    return rounded(backtest.reference_national(ref), "value")


@query("j10_aligned_series", with_views("SELECT scope, period, a, floor(r * 1000000 + 0.37::DOUBLE) / 1000000 AS r FROM aligned", "fx_latest", **BACK))
def aligned_series(spark, d):
    # the cut is off the half-way points, where engines round differently
    return backtest.align(*backtest_sides(spark, d)).withColumn("r", F.floor(F.col("r") * 1000000 + 0.37) / 1000000)


@query("j23_backtest_inputs", with_views("SELECT 'index' AS side, scope, count(*) AS n FROM idx GROUP BY ALL UNION ALL SELECT 'reference', scope, count(*) FROM refs GROUP BY scope", "fx_latest", **BACK))
def backtest_inputs(spark, d):
    index, ref = backtest_sides(spark, d)
    count = lambda df, side: df.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "scope", "n")
    return count(index, "index").unionByName(count(ref, "reference"))
