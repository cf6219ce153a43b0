"""Lead-time curves, fare series, coverage, operational gauges, dimension joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import views as V
from quotemill.catalog.registry import query
from quotemill.catalog.views import with_views
from quotemill.functions.staging import staged
from quotemill.operators import analytics, backtest, cleaning

def snap(c: str):
    """Four decimals with the cut off the half-way points, where engines round differently."""
    return (F.floor(F.col(c) * 10000 + 0.37) / 10000).alias(c)


CURVE = f"""SELECT route_code, window_code, CAST(sum(c) AS DOUBLE) / 100 / sum(n) AS mean_fare, sum(med * n) / sum(n) AS median_fare, CAST(sum(n) AS BIGINT) AS n_quotes FROM (
  SELECT route_code, {V.WINDOW_SQL} AS window_code, advance_days, sum(total_c) AS c, median(total_c / 100.0) AS med, count(*) AS n
  FROM fx_clean WHERE NOT is_outlier GROUP BY ALL) GROUP BY ALL"""
QUART = f"""SELECT route_code, {V.WINDOW_SQL} AS window_code, quantile_cont(total_c / 100.0, 0.25) AS p25_fare, median(total_c / 100.0) AS true_median, quantile_cont(total_c / 100.0, 0.75) AS p75_fare
FROM fx_clean WHERE NOT is_outlier GROUP BY ALL"""


def curve(spark, d):
    c = V.clean(spark, d, "route_code", "advance_days", "total_fare", "is_outlier")
    return analytics.lead_time_curve(c, ["route_code"])


@query(
    "a23_lead_time_curve",
    with_views(
        """SELECT route_code, window_code, mean_fare, floor(median_fare * 10000 + 0.37::DOUBLE) / 10000 AS median_fare, n_quotes, round(p25_fare, 4) AS p25_fare,
  round(true_median, 4) AS true_median, round(p75_fare, 4) AS p75_fare, round(100.0 * mean_fare / min(mean_fare) OVER (PARTITION BY route_code), 1) AS index_vs_cheapest
FROM curve JOIN quart USING (route_code, window_code)""",
        "fx_clean", curve=CURVE, quart=QUART,
    ),
)
def lead_time_curve(spark, d):
    out = curve(spark, d)
    return out.withColumns({c: F.round(c, 4) for c in ("p25_fare", "true_median", "p75_fare")}).withColumn("median_fare", snap("median_fare"))


@query(
    "l03_lead_time_inflection",
    with_views("SELECT route_code, arg_min(window_code, mean_fare) AS window_code, min(mean_fare) AS mean_fare FROM curve GROUP BY 1", "fx_clean", curve=CURVE),
)
def lead_time_inflection(spark, d):
    return analytics.lead_time_inflection(curve(spark, d), ["route_code"])


@query(
    "a24_route_fare_series",
    with_views(
        """SELECT route_code, query_month, CAST(sum(total_c) AS DOUBLE) / 100 / count(*) AS mean_fare, count(*) AS n_quotes, bool_and(is_imputed) AS sold_out,
  round(quantile_cont(total_c / 100.0, 0.25), 4) AS p25, round(median(total_c / 100.0), 4) AS median, round(quantile_cont(total_c / 100.0, 0.75), 4) AS p75
FROM fx_clean WHERE advance_days = 14 GROUP BY ALL""",
        "fx_clean",
    ),
)
def route_fare_series(spark, d):
    c = V.clean(spark, d, "route_code", "query_month", "advance_days", "total_fare", "is_imputed")
    out = analytics.route_fare_series(c, ["route_code", "query_month"])
    return out.withColumns({c: F.round(c, 4) for c in ("p25", "median", "p75")})


@query(
    "a22_daily_median_fare",
    with_views("SELECT route_code, query_month AS travel_date, round(median(total_c / 100.0), 4) AS fare FROM fx_quote GROUP BY ALL", "fx_quote"),
)
def daily_median_fare(spark, d):
    from quotemill.operators.watchdog import daily_median_fare as medians

    q = V.quotes(spark, d, "route_code", "query_month", "total_fare").withColumnRenamed("query_month", "travel_date")
    return medians(q).withColumn("fare", F.round("fare", 4))


@query(
    "a41_median_by_route_lead",
    with_views("SELECT route_code, advance_days, count(*) AS n_values, round(median(total_c / 100.0), 4) AS median_fare FROM fx_quote GROUP BY ALL", "fx_quote"),
)
def median_by_route_lead(spark, d):
    out = analytics.grouped_median(V.quotes(spark, d, "route_code", "advance_days", "total_fare"), ["route_code", "advance_days"], "total_fare", "median_fare")
    return out.withColumn("median_fare", F.round("median_fare", 4))


@query(
    "a41_relative_to_lead",
    with_views(
        """SELECT origin_iata, advance_days, round(m, 4) AS median_fare, round(m / b, 6) AS relative FROM (SELECT origin_iata, advance_days, median(total_c / 100.0) AS m FROM fx_quote GROUP BY ALL)
JOIN (SELECT origin_iata, median(total_c / 100.0) AS b FROM fx_quote WHERE advance_days = 45 GROUP BY ALL) USING (origin_iata)""",
        "fx_quote",
    ),
)
def relative_to_lead(spark, d):
    out = analytics.relative_to_lead(V.quotes(spark, d, "origin_iata", "advance_days", "total_fare"), ["origin_iata"])
    return out.select("origin_iata", "advance_days", F.round("median_fare", 4).alias("median_fare"), F.round("relative", 6).alias("relative"))


@query(
    "a41_median_by_weekday",
    with_views("SELECT isodow(travel_date) - 1 AS weekday, count(*) AS n_values, round(median(total_c / 100.0), 4) AS median_fare FROM fx_quote GROUP BY 1", "fx_quote"),
)
def median_by_weekday(spark, d):
    q = V.quotes(spark, d, "travel_date", "total_fare").withColumn("weekday", F.weekday("travel_date"))
    return analytics.grouped_median(q, ["weekday"], "total_fare", "median_fare").withColumn("median_fare", F.round("median_fare", 4))


@query(
    "a41_calendar_contrast",
    with_views(
        """SELECT route_code, inside, count(*) AS n_values, round(median(total_c / 100.0), 4) AS median_fare FROM (
  SELECT route_code, total_c, travel_date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE month(o_orderdate) IN (10, 11)) AS inside FROM fx_quote) GROUP BY ALL""",
        "fx_quote",
    ),
)
def calendar_contrast(spark, d):
    days = V.table(spark, d, "orders").where(F.month("o_orderdate").isin(10, 11)).select(F.to_date("o_orderdate").alias("calendar_day"))
    q = V.quotes(spark, d, "route_code", "travel_date", "total_fare")
    return analytics.calendar_contrast(q, "travel_date", days, ["route_code"]).withColumn("median_fare", F.round("median_fare", 4))


# --- collection ------------------------------------------------------------------------------


@query(
    "a34_daily_coverage",
    with_views(
        """SELECT query_date, coalesce(n, 0) AS routes_covered, (SELECT count(*) FROM fx_route) AS routes_expected,
  round(100.0 * CAST(coalesce(n, 0) AS DOUBLE) / (SELECT count(*) FROM fx_route), 1) AS coverage_pct FROM (SELECT DISTINCT query_date FROM fx_attempt)
LEFT JOIN (SELECT query_date, count(DISTINCT route_code) AS n FROM fx_attempt WHERE status = 'SUCCEEDED' GROUP BY 1) USING (query_date)""",
        "fx_attempt", "fx_route",
    ),
)
def daily_coverage(spark, d):
    return analytics.daily_route_coverage(staged(V.attempts(spark, d), "runs"), V.routes(spark, d))


@query(
    "a34_routes_missing",
    with_views(
        """SELECT query_date, count(*) AS missing FROM (SELECT DISTINCT a.query_date, r.route_code FROM fx_attempt a, fx_route r) x
WHERE NOT EXISTS (SELECT 1 FROM fx_attempt g WHERE g.status = 'SUCCEEDED' AND g.query_date = x.query_date AND g.route_code = x.route_code) GROUP BY 1""",
        "fx_attempt", "fx_route",
    ),
)
def routes_missing(spark, d):
    out = analytics.routes_missing(staged(V.attempts(spark, d), "runs"), V.routes(spark, d))
    return out.groupBy("query_date").agg(F.count(F.lit(1)).alias("missing"))


@query(
    "j16_source_coverage",
    with_views(
        """SELECT s.source_code, CASE WHEN s.source_code = 'F' THEN 'DISABLED' WHEN coalesce(q, 0) > 0 THEN 'OK' ELSE 'PARTIAL' END AS status, coalesce(q, 0) AS quotes_collected,
  coalesce(b, 0) AS blocked_count, CASE WHEN s.source_code = 'F' THEN 'source is not enabled' END AS reason
FROM (SELECT DISTINCT source_code FROM fx_quote UNION ALL SELECT 'Z') s LEFT JOIN (SELECT source_code, sum(quotes_collected) AS q, sum(blocked_count) AS b FROM fx_attempt
  WHERE started_at >= '1998-03-04' AND started_at < '1998-03-05' GROUP BY 1) USING (source_code)""",
        "fx_attempt",
    ),
)
def source_coverage(spark, d):
    s = V.quotes(spark, d, "source_code").distinct().unionByName(spark.range(1).select(F.lit("Z").alias("source_code")))
    return analytics.source_coverage(s.withColumn("enabled", F.col("source_code") != "F"), V.attempts(spark, d), "1998-03-04")


@query(
    "a35_sweep_summary",
    with_views(
        """SELECT coalesce(source_code, 'ALL') AS source_code, count(*) AS cells, count(CASE WHEN status = 'SUCCEEDED' THEN 1 END) AS succeeded, count(CASE WHEN status = 'BLOCKED' THEN 1 END) AS blocked,
  count(CASE WHEN status = 'FAILED' THEN 1 END) AS failed, CAST(sum(quotes_collected) AS BIGINT) AS quotes FROM fx_attempt GROUP BY ROLLUP (source_code)""",
        "fx_attempt",
    ),
)
def sweep_summary(spark, d):
    return analytics.sweep_summary(V.attempts(spark, d).withColumnRenamed("quotes_collected", "quotes"))


@query("a36_index_staleness", with_views("SELECT date_diff('second', max(computed_at), TIMESTAMP '2002-03-01 00:00:00') AS staleness_seconds FROM fx_index_run WHERE released_at IS NOT NULL", "fx_index_run"))
def index_staleness(spark, d):
    return analytics.index_staleness(V.index_runs(spark, d), "2002-03-01 00:00:00")


@query(
    "a36_latest_coverage",
    with_views(
        "SELECT series_code, arg_max(coverage_pct, period) AS coverage_pct, max(computed_at) AS computed_at FROM fx_index_value JOIN fx_index_run USING (index_run_id) WHERE index_run_id = 'run-2001' GROUP BY 1",
        "fx_index_value",
    ),
)
def latest_coverage(spark, d):
    return analytics.latest_coverage(V.index_values(spark, d), V.index_runs(spark, d))


@query(
    "a36_source_success_share",
    with_views("SELECT source_code, CAST(count(CASE WHEN status = 'SUCCEEDED' THEN 1 END) AS DOUBLE) / count(*) AS success_share, count(*) AS runs FROM fx_attempt GROUP BY 1", "fx_attempt"),
)
def source_success_share(spark, d):
    return analytics.source_success_share(V.attempts(spark, d))


# --- joins -----------------------------------------------------------------------------------


@query(
    "j13_cleaned_quotes_view",
    with_views(
        """SELECT route_code, CASE WHEN is_imputed THEN 'imputed' ELSE 'src-' || source_id END AS source_code, count(*) AS n FROM fx_clean GROUP BY ALL""",
        "fx_clean",
    ),
)
def cleaned_quotes_view(spark, d):
    c = V.clean(spark, d, "quote_id", "route_code", "is_imputed").withColumn("quote_id", F.when(~F.col("is_imputed"), F.col("quote_id")))
    q = staged(V.quotes(spark, d, "quote_id", "source_id"), "sourced")
    # written, the few sources are seen to be few, and the quotes are not moved by them
    s = staged(q.select("source_id").distinct().withColumn("source_code", F.concat(F.lit("src-"), F.col("source_id"))), "sources")
    return analytics.cleaned_quotes_view(c, q, s).groupBy("route_code", "source_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j14_route_airports",
    with_views(
        "SELECT route_code, o.city AS origin_city, t.city AS dest_city, o.lat AS origin_lat, t.lat AS dest_lat FROM fx_route r JOIN fx_airport o ON origin_iata = o.iata JOIN fx_airport t ON dest_iata = t.iata",
        "fx_route", "fx_airport",
    ),
)
def route_airports(spark, d):
    r = analytics.route_with_airports(V.routes(spark, d), V.airports(spark, d))
    return r.select("route_code", "origin_city", "dest_city", "origin_lat", "dest_lat")


@query(
    "p20_great_circle",
    with_views(
        """SELECT route_code, round(2 * 6371.0088 * asin(sqrt(power(sin((radians(t.lat) - radians(o.lat)) / 2), 2)
  + cos(radians(o.lat)) * cos(radians(t.lat)) * power(sin((radians(t.lon) - radians(o.lon)) / 2), 2))), 4) AS km
FROM fx_route r JOIN fx_airport o ON origin_iata = o.iata JOIN fx_airport t ON dest_iata = t.iata""",
        "fx_route", "fx_airport",
    ),
)
def great_circle(spark, d):
    r = analytics.route_with_airports(V.routes(spark, d), V.airports(spark, d))
    km = cleaning.great_circle_km(*[F.col(c) for c in ("origin_lat", "origin_lon", "dest_lat", "dest_lon")])
    return r.select("route_code", F.round(km, 4).alias("km"))


@query(
    "p19_product_identity",
    with_views("SELECT carrier_iata || '|' || coalesce(flight_number, '-') || '|' || source_code || '|' || advance_days AS product_id, count(*) AS n FROM fx_quote GROUP BY 1", "fx_quote"),
)
def product_identity(spark, d):
    q = V.quotes(spark, d, "carrier_iata", "flight_number", "source_code", "advance_days")
    return q.groupBy(cleaning.product_id().alias("product_id")).agg(F.count(F.lit(1)).alias("n"))


# Illustrative values: knots of a lead-time curve compared with realised medians.
KNOTS = ((0, 2.0), (3, 1.6), (7, 1.35), (14, 1.15), (21, 1.05), (45, 1.0), (90, 0.95))
_SEG = " ".join(
    f"WHEN advance_days <= {b[0]} THEN exp(ln({a[1]}::DOUBLE) * (1 - (advance_days - {a[0]}) / {b[0] - a[0]}.0) + ln({b[1]}::DOUBLE) * ((advance_days - {a[0]}) / {b[0] - a[0]}.0))"
    for a, b in zip(KNOTS, KNOTS[1:])
)


@query(
    "f01_curve_interpolation",
    with_views(f"SELECT advance_days, round(CASE WHEN advance_days <= 0 THEN 2.0::DOUBLE {_SEG} ELSE 0.95::DOUBLE END, 6) AS multiplier, count(*) AS n FROM fx_quote GROUP BY ALL", "fx_quote"),
)
def curve_interpolation(spark, d):
    q = V.quotes(spark, d, "advance_days")
    m = F.round(cleaning.log_linear_knots(F.col("advance_days"), KNOTS), 6)
    return q.groupBy("advance_days", m.alias("multiplier")).agg(F.count(F.lit(1)).alias("n"))


@query("u05_common_routes", with_views("SELECT route_code FROM fx_quote WHERE source_code = 'F' INTERSECT SELECT route_code FROM fx_pax", "fx_pax"))
def common_routes(spark, d):
    a = V.quotes(spark, d, "route_code", "source_code").where(F.col("source_code") == "F").select(F.col("route_code").alias("scope"))
    b = V.pax_weights(spark, d).select(F.col("route_code").alias("scope"))
    return backtest.common_scopes(a, b).withColumnRenamed("scope", "route_code")
