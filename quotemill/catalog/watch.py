"""Dispersion, sell-out velocity, surges, probe frequency, rail comparison, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import views as V
from quotemill.catalog.cleaning import GAP_STEPS, gaps
from quotemill.catalog.registry import query
from quotemill.catalog.views import with_views
from quotemill.config import SurgeOptions
from quotemill.functions.quantiles import grouped_quantiles
from quotemill.functions.staging import staged
from quotemill.operators import cleaning, provenance, watchdog


@query(
    "a20_dispersion",
    with_views(
        """SELECT source_code, flight_key, probed_at, 'coefficient_of_variation' AS statistic_name, round(coalesce(stddev_samp(total_fare), 0) / avg(total_fare), 6) AS value,
  count(*) AS n_sessions, min(total_fare) AS min_fare, max(total_fare) AS max_fare FROM fx_probe GROUP BY ALL""",
        "fx_probe",
    ),
)
def dispersion(spark, d):
    return watchdog.dispersion(V.probes(spark, d)).withColumn("value", F.round("value", 6))


@query(
    "a21_sellout_velocity",
    with_views(
        """SELECT route_id, carrier_type, max(advance_days) AS first_sold_out_lead, count(*) AS sold_out_count FROM reasons LEFT JOIN fx_carrier USING (carrier_iata)
WHERE missing_reason = 'sold_out' GROUP BY ALL HAVING count(*) >= 5""",
        "fx_observed", "fx_month_run", "fx_carrier", **GAP_STEPS,
    ),
)
def sellout_velocity(spark, d):
    g = cleaning.with_lookup(gaps(spark, d), V.carriers(spark, d), "carrier_iata")
    return watchdog.sellout_velocity(g, ["route_id", "carrier_type"])


SURGE = SurgeOptions(14, 3.0, 5)


def daily(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("route_code"), F.to_date("ts").alias("travel_date"), "value")
    return grouped_quantiles(e, ["route_code", "travel_date"], "value", {"fare": 0.5}).drop("n_values")


SURGE_ROWS = """SELECT route_code, travel_date, fare, CASE WHEN len(h) >= 5 THEN list_median(h) END AS med,
  CASE WHEN len(h) >= 5 THEN list_median(list_transform(h, lambda x: abs(x - list_median(h)))) END AS mad
FROM (SELECT *, list(fare) OVER (PARTITION BY route_code ORDER BY travel_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS h FROM fx_daily)"""


@query(
    "w03_surges",
    with_views(
        """SELECT route_code, travel_date, round(fare, 6) AS fare, round(med, 6) AS baseline_median, round(mad, 6) AS baseline_mad, med IS NOT NULL AS baseline_available,
  coalesce(mad > 0 AND abs(fare - med) > 3.0 * mad, FALSE) AS is_surge FROM s""",
        "fx_daily", s=SURGE_ROWS,
    ),
)
def surges(spark, d):
    out = watchdog.detect_surges(daily(spark, d), SURGE)
    return out.withColumns({c: F.round(c, 6) for c in ("fare", "baseline_median", "baseline_mad")})


@query(
    "p23_probe_allowed",
    with_views(
        """SELECT s.source_code, last AS last_probed_at, date_diff('second', last, TIMESTAMP '2024-01-30 20:00:00') / 3600.0 AS hours_since,
  coalesce(date_diff('second', last, TIMESTAMP '2024-01-30 20:00:00') / 3600.0 >= 12, TRUE) AS allowed
FROM (SELECT DISTINCT event_type AS source_code FROM events UNION ALL SELECT DISTINCT l_linestatus FROM lineitem) s
LEFT JOIN (SELECT source_code, max(date_trunc('second', ts)) AS last FROM fx_probe GROUP BY 1) USING (source_code)""",
        "fx_probe",
    ),
)
def probe_allowed(spark, d):
    p = V.probes(spark, d).withColumn("probed_at", F.date_trunc("second", "ts").cast("timestamp"))
    s = V.table(spark, d, "events").select(F.col("event_type").alias("source_code")).distinct().unionByName(
        V.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("source_code")).distinct()
    )
    return watchdog.probe_allowed(p, s, F.lit("2024-01-30 20:00:00").cast("timestamp"))


@query(
    "j09_rail_comparison",
    with_views(
        """SELECT a.route_code, a.period, airfare, rail_fare, round(airfare / rail_fare, 6) AS ratio, round(airfare - rail_fare, 6) AS spread FROM
  (SELECT route_code, query_month AS period, CAST(sum(total_c) AS DOUBLE) / 100 / count(*) AS airfare FROM fx_quote WHERE source_code = 'O' GROUP BY ALL) a
  JOIN (SELECT route_code, query_month AS period, CAST(sum(total_c) AS DOUBLE) / 100 / count(*) AS rail_fare FROM fx_quote WHERE source_code = 'F' GROUP BY ALL) USING (route_code, period)""",
        "fx_quote",
    ),
)
def rail_comparison(spark, d):
    """One source stands for air, the other for rail."""
    q = V.quotes(spark, d, "route_code", "query_month", "source_code", "total_c").withColumnRenamed("query_month", "period")
    mean = lambda s, name: q.where(F.col("source_code") == s).groupBy("route_code", "period").agg(
        (F.sum("total_c").cast("double") / 100 / F.count(F.lit(1))).alias(name)
    )
    out = watchdog.compare_to_rail(mean("O", "fare"), mean("F", "rail_fare"))
    return out.withColumns({c: F.round(c, 6) for c in ("ratio", "spread")})


# --- provenance ------------------------------------------------------------------------------

# decisions: one per order, for a (segment, customer bucket) page; quotes look them up on shipping
DECISIONS = """SELECT c_mktsegment AS source_id, 'p' || (o_custkey % 20) AS url_hash, CASE WHEN min(o_orderkey) % 3 = 0 THEN 'DENY' ELSE 'ALLOW' END AS decision, CAST(o_orderdate AS TIMESTAMP) AS decided_at
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
ASKS = """SELECT quote_id, c_mktsegment AS source_id, 'p' || (partkey % 20) AS url_hash, CAST(ship_date AS TIMESTAMP) AS collected_at FROM fx_quote JOIN customer ON custkey = c_custkey"""


def asof_inputs(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("source_id"))
    o = V.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    dec = o.groupBy(
        "source_id", F.concat(F.lit("p"), F.col("o_custkey") % 20).alias("url_hash"), F.col("o_orderdate").cast("timestamp").alias("decided_at")
    ).agg(F.when(F.min("o_orderkey") % 3 == 0, "DENY").otherwise("ALLOW").alias("decision"))
    q = V.quotes(spark, d, "quote_id", "custkey", "partkey", "ship_date").join(c, F.col("custkey") == F.col("c_custkey"))
    asks = q.select("quote_id", "source_id", F.concat(F.lit("p"), F.col("partkey") % 20).alias("url_hash"), F.col("ship_date").cast("timestamp").alias("collected_at"))
    return asks, dec


@query(
    "j11_asof_decision",
    with_views(
        """SELECT quote_id, a.source_id, a.url_hash, a.collected_at, d.decided_at AS matched_decided_at, decision FROM asks a ASOF LEFT JOIN dec d
ON a.source_id = d.source_id AND a.url_hash = d.url_hash AND a.collected_at >= d.decided_at""",
        "fx_quote",
        dec=DECISIONS.replace("GROUP BY ALL", "GROUP BY c_mktsegment, o_custkey % 20, o_orderdate"), asks=ASKS,
    ),
)
def asof_decision(spark, d):
    asks, dec = asof_inputs(spark, d)
    return provenance.decisions_for_quotes(asks, dec, 30 * 86_400)


def chain_inputs(spark, d):
    q = V.quotes(spark, d, "quote_id", "source_id", "route_code", "query_date", "partkey", "discount", "quantity")
    q = q.withColumn("collection_run_id", F.concat_ws("/", "source_id", "query_date")).withColumn(
        "source_id", F.when(F.col("partkey") % 71 == 0, "gone").otherwise(F.col("source_id"))
    )
    # written, the runs and sources are seen to be small, and no join moves the quotes by their few values
    q = staged(q, "chain")
    runs = q.where(F.dayofmonth("query_date") != 13).select("collection_run_id").distinct()
    sources = q.select("source_id").where(F.col("source_id") != "gone").distinct()
    return q, staged(runs, "runs"), staged(sources, "sources")


@query(
    "j12_provenance_chain",
    with_views(
        """SELECT chain_broken, tos_verdict, is_outlier, contributions, count(*) AS n FROM (
  SELECT CASE WHEN day(query_date) = 13 THEN 'collection_run' WHEN partkey % 71 = 0 THEN 'source' END AS chain_broken,
    CASE WHEN partkey % 71 <> 0 AND source_id = 'O' THEN 'ALLOWED' END AS tos_verdict, discount > 0.095 AS is_outlier,
    CASE WHEN discount > 0.095 THEN 0 ELSE 2 END AS contributions FROM fx_quote) GROUP BY ALL""",
        "fx_quote",
    ),
)
def provenance_chain(spark, d):
    q, runs, sources = chain_inputs(spark, d)
    policies = sources.where(F.col("source_id") == "O").withColumn("tos_verdict", F.lit("ALLOWED"))
    routes = V.routes(spark, d).select("route_code", "origin_iata", "dest_iata")
    c = q.select(
        "quote_id", F.col("quote_id").alias("clean_id"), (F.col("discount") > 0.095).alias("is_outlier"),
        F.when(F.col("discount") > 0.095, "mad_log").alias("outlier_rule"), F.lit(False).alias("is_imputed"),
    )
    used = c.where(~F.col("is_outlier")).select("clean_id", F.explode(F.array(F.lit("route"), F.lit("all"))).alias("series_code"))
    out = provenance.provenance_chain(q, runs, sources, policies, routes, c, used)
    return out.groupBy("chain_broken", "tos_verdict", "is_outlier", "contributions").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j12_broken_chains",
    with_views(
        """SELECT quote_id, 'collection_run' AS missing_link FROM fx_quote WHERE day(query_date) = 13 UNION ALL SELECT quote_id, 'source' FROM fx_quote WHERE partkey % 71 = 0""",
        "fx_quote",
    ),
)
def broken_chains(spark, d):
    return provenance.broken_chains(*chain_inputs(spark, d))
