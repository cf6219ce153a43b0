"""Screening, matching, component split, outliers, missing cells, imputation, coverage, gates."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from quotemill.catalog import views as V
from quotemill.catalog.registry import query
from quotemill.catalog.views import with_views
from quotemill.config import ADVANCE_WINDOWS, CleaningOptions, GateOptions
from quotemill.functions.staging import scratch_path, staged
from quotemill.operators import analytics, cleaning, gates, missing
from quotemill.plans.cleaning_run import clean_quotes

# --- malformed -------------------------------------------------------------------------------

MALFORMED = """SELECT quote_id, route_id, CASE WHEN route_id IS NULL OR carrier_iata IS NULL OR travel_date IS NULL OR advance_days IS NULL
  THEN 'missing_identity_dimension' WHEN TRY_CAST(total_fare AS DOUBLE) IS NULL OR isnan(TRY_CAST(total_fare AS DOUBLE))
    OR TRY_CAST(total_fare AS DOUBLE) <= 0 THEN 'invalid_total_fare' END AS quarantine_reason FROM fx_raw"""


@query("p01_quarantined", with_views("SELECT quote_id, quarantine_reason FROM m WHERE quarantine_reason IS NOT NULL", "fx_raw", m=MALFORMED))
def quarantined(spark, d):
    _, bad = cleaning.quarantine_malformed(V.raw_feed(spark, d))
    return bad.select("quote_id", "quarantine_reason")


@query("p01_kept_by_route", with_views("SELECT route_id, count(*) AS kept FROM m WHERE quarantine_reason IS NULL GROUP BY 1", "fx_raw", m=MALFORMED))
def kept_by_route(spark, d):
    kept, _ = cleaning.quarantine_malformed(V.raw_feed(spark, d))
    return kept.groupBy("route_id").agg(F.count(F.lit(1)).alias("kept"))


# --- component split -------------------------------------------------------------------------

# half-even at the cent in whole numbers; 105 is odd, so the base never ties
_NET = "(total_c - 100 * udf_units - coalesce(fee_c, 0))"
_BASE = f"(CASE WHEN 2 * (({_NET} * 100) % 105) > 105 THEN ({_NET} * 100) // 105 + 1 ELSE ({_NET} * 100) // 105 END)"
SPLIT = f"""SELECT quote_id, CASE WHEN base_c IS NOT NULL AND taxes_c IS NOT NULL AND udf_c IS NOT NULL THEN 'reported'
    WHEN udf_units IS NOT NULL AND {_BASE} > 0 THEN 'derived' ELSE 'undetermined' END AS fare_split_source,
  total_c, base_c, taxes_c, udf_c, fee_c, udf_units, {_BASE} AS b FROM fx_quote JOIN fx_airport ON origin_iata = iata"""
_TAXED = "CASE WHEN b * 5 % 100 > 50 OR (b * 5 % 100 = 50 AND (b * 5 // 100) % 2 = 1) THEN b * 5 // 100 + 1 ELSE b * 5 // 100 END"
SPLIT_OUT = f"""SELECT quote_id, fare_split_source,
  CASE WHEN fare_split_source = 'derived' THEN b ELSE base_c END / 100.0 AS base_fare,
  CASE WHEN fare_split_source = 'derived' THEN {_TAXED} ELSE taxes_c END / 100.0 AS taxes,
  CASE WHEN fare_split_source = 'derived' THEN 100 * udf_units ELSE udf_c END / 100.0 AS udf,
  CASE WHEN fare_split_source = 'derived' THEN coalesce(fee_c, 0) ELSE fee_c END / 100.0 AS convenience_fee,
  CASE fare_split_source WHEN 'reported' THEN abs(base_c + taxes_c + udf_c + coalesce(fee_c, 0) - total_c) <= 1 WHEN 'derived' THEN TRUE END
    AS component_sum_consistent FROM split"""


def airport_fee(spark, d):
    return V.airports(spark, d).select(F.col("iata").alias("origin_iata"), F.col("udf_units").cast("decimal(12,2)").alias("airport_udf"))


def split_fares(spark, d, *extra):
    q = V.quotes(spark, d, "quote_id", "origin_iata", "base_fare", "taxes", "udf", "convenience_fee", "total_fare", *extra)
    return cleaning.decompose_fares(q, airport_fee(spark, d), 0.05)


@query("p02_decompose_fares", with_views(SPLIT_OUT, "fx_quote", "fx_airport", split=SPLIT))
def decompose_fares(spark, d):
    m = ("base_fare", "taxes", "udf", "convenience_fee")
    return split_fares(spark, d).select(
        "quote_id", "fare_split_source", *[F.col(c).cast("double").alias(c) for c in m], "component_sum_consistent"
    )


@query(
    "p03_quality_vector",
    with_views(
        """SELECT quote_id, '{"stops":' || stops || ',"dep_hour_bucket":' || (dep_minute // 60) || ',"refundable":' || refundable
  || ',"baggage_included":' || coalesce(CAST(baggage_included AS VARCHAR), 'null') || ',"carrier_type":'
  || coalesce('"' || carrier_type || '"', 'null') || ',"aircraft":null,"fare_split":null}' AS quality_vector
FROM fx_quote LEFT JOIN fx_carrier USING (carrier_iata)""",
        "fx_quote", "fx_carrier",
    ),
)
def quality_vector(spark, d):
    q = V.quotes_timed(spark, d, "quote_id", "stops", "refundable", "baggage_included", "carrier_iata", "dep_datetime_local")
    q = cleaning.with_lookup(q, V.carriers(spark, d), "carrier_iata").withColumn("dep_hour_bucket", F.hour("dep_datetime_local"))
    return q.select("quote_id", F.to_json(cleaning.quality_vector(q.columns), {"ignoreNullFields": "false"}).alias("quality_vector"))


@query("p04_window_counts", with_views(f"SELECT {V.WINDOW_SQL} AS advance_window, count(*) AS n_quotes FROM fx_quote GROUP BY 1", "fx_quote"))
def window_counts(spark, d):
    q = V.quotes(spark, d, "advance_days").select(cleaning.window_code().alias("advance_window"))
    return q.groupBy("advance_window").agg(F.count(F.lit(1)).alias("n_quotes"))


@query("p05_carrier_type", with_views("SELECT carrier_type, count(*) AS n_quotes FROM fx_quote LEFT JOIN fx_carrier USING (carrier_iata) GROUP BY 1", "fx_quote", "fx_carrier"))
def carrier_type(spark, d):
    q = cleaning.with_lookup(V.quotes(spark, d, "carrier_iata"), V.carriers(spark, d), "carrier_iata")
    return q.groupBy("carrier_type").agg(F.count(F.lit(1)).alias("n_quotes"))


@query(
    "p06_calendar_columns",
    with_views("SELECT quote_id, dep_minute // 60 AS dep_hour_bucket, travel_date - advance_days AS query_date FROM fx_quote", "fx_quote"),
)
def calendar_columns(spark, d):
    q = V.quotes_timed(spark, d, "quote_id", "travel_date", "advance_days", "dep_datetime_local")
    return cleaning.with_calendar(q).select("quote_id", "dep_hour_bucket", "query_date")


# --- cross-source matching -------------------------------------------------------------------

# greedy clusters by walking from each cluster's first departure to the next one out of reach
CLUSTERS = """SELECT p_brand AS carrier_iata, flight_number, travel_month, dep_minute FROM (
  SELECT carrier_iata AS p_brand, flight_number, CAST(date_trunc('month', travel_date) AS DATE) AS travel_month, dep_minute FROM fx_quote) GROUP BY ALL"""
WALK = """SELECT carrier_iata, flight_number, travel_month, min(dep_minute) AS start, 0 AS cluster FROM instants GROUP BY ALL
UNION ALL
SELECT i.carrier_iata, i.flight_number, i.travel_month, min(i.dep_minute) AS start, max(w.cluster) + 1 FROM walk w JOIN instants i
  ON i.carrier_iata = w.carrier_iata AND i.flight_number IS NOT DISTINCT FROM w.flight_number AND i.travel_month = w.travel_month
  AND i.dep_minute > w.start + 15 GROUP BY ALL"""


def clustered(spark, d):
    q = V.quotes(spark, d, "quote_id", "carrier_iata", "flight_number", "travel_date", "dep_minute")
    q = q.withColumn("travel_month", F.trunc("travel_date", "month"))
    return q, ["carrier_iata", "flight_number", "travel_month"]


@query(
    "w10_departure_clusters",
    with_views("", "fx_quote", instants=CLUSTERS).rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    + f",\nwalk AS ({WALK})\n"
    + """SELECT carrier_iata, flight_number, travel_month, cluster, CAST(start AS INT) AS first_minute FROM walk""",
)
def departure_clusters(spark, d):
    q, keys = clustered(spark, d)
    c = cleaning.departure_clusters(q, keys, "dep_minute", 15)
    return c.groupBy(*keys, "cluster").agg(F.min("dep_minute").alias("first_minute"))


# a quote belongs to the last cluster that starts at or before its departure
_WALKED = with_views("", "fx_quote", instants=CLUSTERS).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f",\nwalk AS ({WALK})\n"
FLIGHT_KEY = """SELECT quote_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS flight_key
FROM (SELECT quote_id, sha1(unhex('2b6c9a3d6e0a4a9e8a0e7e6c8f0a3b5e') || encode(q.carrier_iata || '|' || coalesce(q.flight_number, 'None') || '|'
    || CAST(date_trunc('month', travel_date) AS DATE) || '|' || max(cluster))) AS h
  FROM fx_quote q JOIN walk w ON q.carrier_iata = w.carrier_iata AND q.flight_number IS NOT DISTINCT FROM w.flight_number
    AND CAST(date_trunc('month', q.travel_date) AS DATE) = w.travel_month AND w.start <= q.dep_minute
  GROUP BY quote_id, q.carrier_iata, q.flight_number, travel_date)"""


@query("w10_flight_key", _WALKED + FLIGHT_KEY)
def flight_keys(spark, d):
    """Flight key per quote."""
    q, keys = clustered(spark, d)
    return cleaning.assign_flight_key(q, 15, keys, "dep_minute").select("quote_id", "flight_key")


@query(
    "p18_uuid5",
    with_views(
        """SELECT DISTINCT flight_number, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS flight_key
FROM (SELECT flight_number, sha1(unhex('2b6c9a3d6e0a4a9e8a0e7e6c8f0a3b5e') || encode(carrier_iata || '|' || coalesce(flight_number, 'None') || '|0')) AS h FROM fx_quote)""",
        "fx_quote",
    ),
)
def uuid5(spark, d):
    q = V.quotes(spark, d, "carrier_iata", "flight_number").distinct().withColumn("cluster", F.lit(0))
    return q.select("flight_number", cleaning.flight_key(["carrier_iata", "flight_number"]).alias("flight_key")).distinct()


# --- outliers --------------------------------------------------------------------------------

BOUNDS = """SELECT route_id, travel_month, count(*) AS cell_n, quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3 FROM priced GROUP BY ALL"""
PRICED = """SELECT quote_id, route_id, CAST(date_trunc('month', travel_date) AS DATE) AS travel_month, ln(total_c / 100.0) AS x, total_c FROM fx_quote"""
SPREAD = "SELECT route_id, travel_month, median(abs(x - med)) AS mad FROM priced JOIN bounds USING (route_id, travel_month) GROUP BY ALL"
FLAGS = """SELECT quote_id, cell_n >= 5 AND coalesce(0.6745 * abs(x - med) / nullif(mad, 0) > 3.5, FALSE) AS is_outlier_mad,
  cell_n >= 5 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS is_outlier_iqr, route_id, travel_month
FROM priced JOIN bounds USING (route_id, travel_month) JOIN spread USING (route_id, travel_month)"""
OUTLIER_STEPS = dict(priced=PRICED, bounds=BOUNDS, spread=SPREAD, flags=FLAGS)


def priced(spark, d, *extra):
    q = V.quotes(spark, d, "quote_id", "route_id", "travel_date", "total_fare", *extra)
    return q.withColumn("travel_month", F.trunc("travel_date", "month"))


@query(
    "w05_outlier_bounds",
    with_views(
        """SELECT route_id, travel_month, cell_n, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(mad, 6) AS mad
FROM bounds JOIN spread USING (route_id, travel_month)""",
        "fx_quote", **{k: OUTLIER_STEPS[k] for k in ("priced", "bounds", "spread")},
    ),
)
def outlier_bounds(spark, d):
    b = cleaning.outlier_bounds(priced(spark, d), ["route_id", "travel_month"])
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "med", "q3", "mad")})


@query(
    "w05_outlier_flags",
    with_views(
        """SELECT quote_id, is_outlier_mad, is_outlier_iqr, is_outlier_mad AS is_outlier, CASE WHEN is_outlier_mad THEN 'mad_log' END AS outlier_rule
FROM flags""",
        "fx_quote", **OUTLIER_STEPS,
    ),
)
def outlier_flags(spark, d):
    out = cleaning.detect_outliers(priced(spark, d), ["route_id", "travel_month"])
    return out.select("quote_id", "is_outlier_mad", "is_outlier_iqr", "is_outlier", "outlier_rule")


@query(
    "j19_screened_quotes",
    with_views("SELECT route_id, count(*) AS n_quotes, sum(total_c) / 100.0 AS total FROM priced WHERE quote_id NOT IN (SELECT quote_id FROM flags WHERE is_outlier_mad) GROUP BY 1",
               "fx_quote", **OUTLIER_STEPS),
)
def screened_quotes(spark, d):
    q = staged(priced(spark, d), "priced")
    flagged = cleaning.detect_outliers(q, ["route_id", "travel_month"]).where("is_outlier").select("quote_id")
    kept = q.join(flagged, "quote_id", "left_anti")
    return kept.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.sum("total_fare").cast("double").alias("total"))


# --- missing cells ---------------------------------------------------------------------------

# flights seen from a source, expected in every month with a successful run of that source
EXPECTED = f"""SELECT source_id, f.route_id, f.carrier_iata, f.flight_number, f.advance_days, r.query_date, r.query_date + f.advance_days AS travel_date
FROM (SELECT DISTINCT source_id, route_id, carrier_iata, flight_number, advance_days FROM fx_observed) f
JOIN (SELECT DISTINCT source_id, query_date FROM fx_month_run WHERE status IN ('SUCCEEDED', 'PARTIAL')) r USING (source_id)"""
MISSING = """SELECT e.* FROM expected e LEFT JOIN fx_observed o ON e.source_id = o.source_id AND e.route_id = o.route_id AND e.carrier_iata = o.carrier_iata
  AND e.flight_number IS NOT DISTINCT FROM o.flight_number AND e.advance_days = o.advance_days AND e.query_date = o.query_date
  AND e.travel_date = o.travel_date WHERE o.source_id IS NULL"""
LAST_RUN = "SELECT source_id, route_id, query_date, arg_max(status, started_at) AS status FROM fx_month_run GROUP BY ALL"
REASONS = """SELECT m.*, CASE WHEN status IN ('SUCCEEDED', 'PARTIAL') THEN 'sold_out' ELSE 'not_collected' END AS missing_reason
FROM missing m LEFT JOIN last_run USING (source_id, route_id, query_date)"""
GAP_STEPS = dict(expected=EXPECTED, missing=MISSING, last_run=LAST_RUN, reasons=REASONS)
FLIGHT = ("source_id", "route_id", "carrier_iata", "flight_number", "advance_days")


def grid(spark, d):
    """(expected, observed, runs). Observed cells and runs are month-grain aggregates read by
    several branches, so they are written once."""
    seen = staged(V.observed_cells(spark, d), "observed")
    runs = staged(V.month_runs(spark, d), "runs")
    return missing.expected_from_history(seen, runs, FLIGHT), seen, runs


def gaps(spark, d):
    expected, seen, runs = grid(spark, d)
    return missing.classify_missing(missing.missing_cells(expected, seen), runs)


@query("j05_expected_grid", with_views("SELECT source_id, route_id, count(*) AS cells FROM expected GROUP BY ALL", "fx_observed", "fx_month_run", expected=EXPECTED))
def expected_grid(spark, d):
    expected, _, _ = grid(spark, d)
    return expected.groupBy("source_id", "route_id").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "j01_missing_cells",
    with_views("SELECT route_id, carrier_iata, flight_number, count(*) AS missing_cells FROM missing GROUP BY ALL",
               "fx_observed", "fx_month_run", expected=EXPECTED, missing=MISSING),
)
def missing_cells(spark, d):
    expected, seen, _ = grid(spark, d)
    m = missing.missing_cells(expected, seen)
    return m.groupBy("route_id", "carrier_iata", "flight_number").agg(F.count(F.lit(1)).alias("missing_cells"))


@query(
    "j02_missing_reasons",
    with_views("SELECT source_id, route_id, query_date, missing_reason, count(*) AS cells FROM reasons GROUP BY ALL", "fx_observed", "fx_month_run", **GAP_STEPS),
)
def missing_reasons(spark, d):
    return gaps(spark, d).groupBy("source_id", "route_id", "query_date", "missing_reason").agg(F.count(F.lit(1)).alias("cells"))


@query("w09_latest_run_status", with_views(LAST_RUN.replace("ALL", "ALL"), "fx_month_run"))
def latest_run_status(spark, d):
    return missing.latest_runs(V.month_runs(spark, d))


STATS = """SELECT route_id, advance_days, carrier_type, CAST(sum(total_c) AS DOUBLE) / 100 / count(*) AS cell_mean, count(*) AS cell_n
FROM (SELECT route_id, total_c, CAST({lo} AS INT) AS advance_days, carrier_type FROM fx_clean WHERE NOT is_outlier) GROUP BY ALL""".format(lo=V._LO)
FILL = """SELECT r.*, fx_carrier.carrier_type, cell_mean, coalesce(cell_n, 0) >= 3 AS enough FROM reasons r LEFT JOIN fx_carrier USING (carrier_iata)
LEFT JOIN stats s ON s.route_id = r.route_id AND s.advance_days = r.advance_days AND s.carrier_type IS NOT DISTINCT FROM fx_carrier.carrier_type
WHERE missing_reason = 'sold_out'"""


def clean_priced(spark, d):
    q = V.clean(spark, d, "route_id", "advance_days", "carrier_type", "total_fare", "is_outlier")
    return q.where(~F.col("is_outlier")).withColumn("advance_days", F.expr(V.WINDOW_START))


@query("a17_group_stats", with_views("SELECT * FROM stats", "fx_clean", stats=STATS))
def group_stats(spark, d):
    return missing.group_stats(clean_priced(spark, d), ["route_id", "advance_days", "carrier_type"])


def imputation(spark, d):
    sold_out = gaps(spark, d).where(F.col("missing_reason") == "sold_out")
    sold_out = cleaning.with_lookup(sold_out, V.carriers(spark, d), "carrier_iata")
    return missing.impute_sold_out(sold_out, clean_priced(spark, d))


@query(
    "j03_imputed_cells",
    with_views(
        """SELECT route_id, carrier_type, advance_days, 'cell_mean' AS imputation_method, count(*) AS cells, max(cell_mean) AS total_fare
FROM fill WHERE enough GROUP BY ALL""",
        "fx_observed", "fx_month_run", "fx_clean", "fx_carrier", **GAP_STEPS, stats=STATS, fill=FILL,
    ),
)
def imputed_cells(spark, d):
    done, _ = imputation(spark, d)
    return done.groupBy("route_id", "carrier_type", "advance_days", "imputation_method").agg(
        F.count(F.lit(1)).alias("cells"), F.max("total_fare").alias("total_fare")
    )


@query(
    "j03_unresolved_cells",
    with_views(
        "SELECT count(*) AS cells FROM fill WHERE NOT enough",
        "fx_observed", "fx_month_run", "fx_clean", "fx_carrier", **GAP_STEPS, stats=STATS, fill=FILL,
    ),
)
def unresolved_cells(spark, d):
    _, left = imputation(spark, d)
    return left.agg(F.count(F.lit(1)).alias("cells"))


COVER = """SELECT route_id, advance_days, expected_count, coalesce(o, 0) AS observed_count, coalesce(nc, 0) AS not_collected_count,
  coalesce(so, 0) AS sold_out_count, 100.0 * CAST(coalesce(o, 0) AS DOUBLE) / expected_count AS coverage_pct
FROM (SELECT route_id, advance_days, count(*) AS expected_count FROM expected GROUP BY ALL)
LEFT JOIN (SELECT route_id, advance_days, count(*) AS o FROM fx_observed GROUP BY ALL) USING (route_id, advance_days)
LEFT JOIN (SELECT route_id, advance_days, count(CASE WHEN missing_reason = 'not_collected' THEN 1 END) AS nc,
  count(CASE WHEN missing_reason = 'sold_out' THEN 1 END) AS so FROM reasons GROUP BY ALL) USING (route_id, advance_days)"""


@query("a18_coverage", with_views("SELECT *, 0 AS imputed_count FROM (" + COVER + ")", "fx_observed", "fx_month_run", **GAP_STEPS))
def coverage(spark, d):
    expected, seen, runs = grid(spark, d)
    gap = missing.classify_missing(missing.missing_cells(expected, seen), runs)
    return missing.coverage(expected, seen, gap)


@query(
    "j04_coverage_with_imputed",
    with_views(
        f"""SELECT c.*, coalesce(n, 0) AS imputed_count FROM ({COVER}) c LEFT JOIN
  (SELECT route_id, advance_days, count(*) AS n FROM fill WHERE enough GROUP BY ALL) USING (route_id, advance_days)""",
        "fx_observed", "fx_month_run", "fx_clean", "fx_carrier", **GAP_STEPS, stats=STATS, fill=FILL,
    ),
)
def coverage_with_imputed(spark, d):
    expected, seen, runs = grid(spark, d)
    gap = staged(missing.classify_missing(missing.missing_cells(expected, seen), runs), "gaps")
    sold_out = cleaning.with_lookup(gap.where(F.col("missing_reason") == "sold_out"), V.carriers(spark, d), "carrier_iata")
    done, _ = missing.impute_sold_out(sold_out, clean_priced(spark, d))
    return missing.coverage(expected, seen, gap, done)


@query(
    "u02_expected_from_outcomes",
    with_views(
        """SELECT route_id, count(*) AS cells FROM (SELECT source_id, route_id, carrier_iata, flight_number, advance_days, query_date, travel_date FROM fx_observed
  UNION SELECT source_id, route_id, carrier_iata, flight_number, advance_days, query_date, travel_date FROM reasons WHERE missing_reason = 'sold_out') GROUP BY 1""",
        "fx_observed", "fx_month_run", **GAP_STEPS,
    ),
)
def expected_from_outcomes(spark, d):
    expected, seen, runs = grid(spark, d)
    gap = missing.classify_missing(missing.missing_cells(expected, seen), runs)
    cells = seen.select(*missing.CELL).union(gap.where(F.col("missing_reason") == "sold_out").select(*missing.CELL)).distinct()
    return cells.groupBy("route_id").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "a40_sold_out_share",
    with_views(
        """SELECT advance_days, missing_n, observed_n, CAST(missing_n AS DOUBLE) / (missing_n + observed_n) AS sold_out_share FROM (
  SELECT advance_days, CAST(sum(m) AS BIGINT) AS missing_n, count(*) - CAST(sum(m) AS BIGINT) AS observed_n FROM (
    SELECT DISTINCT advance_days, route_id, carrier_iata, travel_date, 1 AS m FROM reasons WHERE missing_reason = 'sold_out'
    UNION ALL SELECT DISTINCT advance_days, route_id, carrier_iata, travel_date, 0 FROM fx_observed) GROUP BY 1)""",
        "fx_observed", "fx_month_run", **GAP_STEPS,
    ),
)
def sold_out_share(spark, d):
    expected, seen, runs = grid(spark, d)
    gap = missing.classify_missing(missing.missing_cells(expected, seen), runs)
    return missing.sold_out_share(gap.where(F.col("missing_reason") == "sold_out"), seen, "advance_days", ["route_id", "carrier_iata", "travel_date"])


@query(
    "j06_sampling_grid",
    with_views(
        """SELECT r.route_code, s.source_code, w.advance_window, (w.lo + w.hi) // 2 AS advance_days, DATE '1998-06-01' AS query_date,
  DATE '1998-06-01' + CAST((w.lo + w.hi) // 2 AS INT) AS travel_date
FROM fx_route r, (VALUES ('F'), ('O')) s(source_code), fx_window w
WHERE active_from <= DATE '1998-06-01' AND (active_to IS NULL OR active_to > DATE '1998-06-01')""",
        "fx_route", "fx_window",
    ),
)
def sampling_grid(spark, d):
    day = F.lit("1998-06-01").cast("date")
    live = analytics.active_routes(V.routes(spark, d), day).select("route_code")
    return missing.sampling_grid(live, ["F", "O"], ADVANCE_WINDOWS, day)


@query("p11_active_routes", with_views("SELECT * FROM fx_route WHERE active_from <= DATE '1999-06-01' AND (active_to IS NULL OR active_to > DATE '1999-06-01')", "fx_route"))
def active_routes(spark, d):
    return analytics.active_routes(V.routes(spark, d), F.lit("1999-06-01").cast("date"))


# --- gates and rules -------------------------------------------------------------------------

# distances per route in km, spread over the three bands
DISTANCE = "SELECT route_code AS route_id, CAST(300 + 97 * row_number() OVER (ORDER BY route_code) AS DOUBLE) AS distance_km FROM fx_route"
GATE_ROWS = """SELECT c.*, distance_km, CASE WHEN distance_km < 600 THEN 'short' WHEN distance_km < 1500 THEN 'medium' ELSE 'long' END AS band,
  base_c / 100.0 AS base_fare, (taxes_c / 100.0) / (total_c / 100.0) AS tax_share FROM fx_clean c JOIN distance USING (route_id)"""
GATES = """SELECT gate, unexpected_count = 0 AS success, element_count, null_count, unexpected_count FROM (
  SELECT 'base_fare_within_band__' || band AS gate, count(*) AS element_count, count(*) - count(base_fare) AS null_count,
    count(CASE band WHEN 'short' THEN CASE WHEN base_fare NOT BETWEEN 500 AND 25000 THEN 1 END
      WHEN 'medium' THEN CASE WHEN base_fare NOT BETWEEN 800 AND 55000 THEN 1 END
      ELSE CASE WHEN base_fare NOT BETWEEN 1200 AND 70000 THEN 1 END END) AS unexpected_count FROM gate_rows WHERE NOT is_outlier GROUP BY band
  UNION ALL SELECT 'tax_share_within_band', count(tax_share), 0, count(CASE WHEN tax_share NOT BETWEEN 0.01 AND 0.2 THEN 1 END) FROM gate_rows WHERE NOT is_outlier
  UNION ALL SELECT 'route_distance_known', count(*), 0, 0 FROM gate_rows WHERE NOT is_outlier
  UNION ALL SELECT 'coverage_above_floor', count(*), 0, count(CASE WHEN coverage_pct NOT BETWEEN 40 AND 100 THEN 1 END) FROM (
    SELECT route_id, 100.0 * count(DISTINCT carrier_iata) / 25 AS coverage_pct FROM gate_rows GROUP BY 1)
  UNION ALL SELECT 'no_duplicate_quote_id', sum(n), 0, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) FROM (SELECT quote_id, count(*) AS n FROM gate_rows GROUP BY 1)
  UNION ALL SELECT 'no_imputed_row_without_method', count(*), 0, count(CASE WHEN is_imputed AND imputation_method IS NULL THEN 1 END) FROM gate_rows)"""


def gate_inputs(spark, d):
    c = V.clean(spark, d, "quote_id", "route_id", "carrier_iata", "base_fare", "taxes", "total_fare", "is_outlier", "is_imputed", "imputation_method")
    # alphabetical rank of each of the few routes, from the sorted list of all codes
    codes = V.routes(spark, d).groupBy().agg(F.sort_array(F.collect_list("route_code")).alias("codes"))
    dist = codes.select(F.posexplode("codes").alias("i", "route_id")).select("route_id", (F.lit(397.0) + 97 * F.col("i")).alias("distance_km"))
    cov = c.groupBy("route_id").agg((F.lit(100.0) * F.count_distinct("carrier_iata") / 25).alias("coverage_pct"))
    return c, cov, dist


@query("a19_quality_gates", with_views(GATES, "fx_clean", "fx_route", distance=DISTANCE, gate_rows=GATE_ROWS))
def quality_gates(spark, d):
    c, cov, dist = gate_inputs(spark, d)
    return gates.quality_report(c, cov, dist)


@query(
    "a19_gate_samples",
    with_views(
        """SELECT gate, value, quote_id FROM (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY value, quote_id) AS rn FROM (
  SELECT 'base_fare_within_band__' || band AS gate, base_fare AS value, quote_id FROM gate_rows WHERE NOT is_outlier AND
    CASE band WHEN 'short' THEN base_fare NOT BETWEEN 500 AND 25000 WHEN 'medium' THEN base_fare NOT BETWEEN 800 AND 55000 ELSE base_fare NOT BETWEEN 1200 AND 70000 END
  UNION ALL SELECT 'tax_share_within_band', tax_share, quote_id FROM gate_rows WHERE NOT is_outlier AND tax_share NOT BETWEEN 0.01 AND 0.2)) WHERE rn <= 20""",
        "fx_clean", "fx_route", distance=DISTANCE, gate_rows=GATE_ROWS,
    ),
)
def gate_samples(spark, d):
    c, _, dist = gate_inputs(spark, d)
    return gates.gate_samples(c, dist)


@query("p21_distance_band", with_views("SELECT route_id, band, count(*) AS n FROM gate_rows GROUP BY ALL", "fx_clean", "fx_route", distance=DISTANCE, gate_rows=GATE_ROWS))
def distance_band(spark, d):
    c, _, dist = gate_inputs(spark, d)
    j = c.join(dist, "route_id").withColumn("band", cleaning.distance_band(F.col("distance_km"), GateOptions().bands))
    return j.groupBy("route_id", "band").agg(F.count(F.lit(1)).alias("n"))


QUOTE_RULE_ROWS = """SELECT quote_id, total_c / 100.0 - 2000 AS total_fare, base_c AS base_fare, taxes_c AS taxes, udf_c AS udf, fee_c AS convenience_fee, stops * 3 AS stops,
  advance_days, travel_date, query_date + linenumber * 5 AS query_date, CASE WHEN linenumber = 3 THEN 'RUPEE' ELSE 'INR' END AS currency, linenumber - 2 AS seats_shown FROM fx_quote"""
RULES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) AS row_count, count(CASE WHEN NOT ({e}) THEN 1 END) AS violations FROM rows_" for n, e in gates.QUOTE_RULES.items()
)


def rule_rows(spark, d):
    q = V.quotes(spark, d, "quote_id", "total_c", "base_c", "taxes_c", "udf_c", "fee_c", "stops", "advance_days", "travel_date", "query_date", "linenumber")
    return q.selectExpr(
        "quote_id", "total_c / 100 - 2000 as total_fare", "base_c as base_fare", "taxes_c as taxes", "udf_c as udf", "fee_c as convenience_fee", "stops * 3 as stops",
        "advance_days", "travel_date", "date_add(query_date, linenumber * 5) as query_date",
        "case when linenumber = 3 then 'RUPEE' else 'INR' end as currency", "linenumber - 2 as seats_shown",
    )


@query("p10_rule_report", with_views(RULES_SQL, "fx_quote", rows_=QUOTE_RULE_ROWS))
def rule_report(spark, d):
    return gates.rule_report(rule_rows(spark, d), gates.QUOTE_RULES)


@query(
    "p10_rule_violations",
    with_views(
        f"""SELECT quote_id, array_to_string(broken, ',') AS broken_rules FROM (SELECT quote_id, list_filter([{', '.join(f"CASE WHEN NOT ({e}) THEN '{n}' END" for n, e in gates.QUOTE_RULES.items())}],
  lambda x: x IS NOT NULL) AS broken FROM rows_) WHERE len(broken) > 0""",
        "fx_quote", rows_=QUOTE_RULE_ROWS,
    ),
)
def rule_violations(spark, d):
    out = gates.rule_violations(rule_rows(spark, d), gates.QUOTE_RULES, ["quote_id"])
    return out.withColumn("broken_rules", F.array_join("broken_rules", ","))


@query("p10_clean_rules", with_views(
    "SELECT 'imputed_has_method' AS rule, count(*) AS row_count, count(CASE WHEN is_imputed AND imputation_method IS NULL THEN 1 END) AS violations FROM fx_clean "
    "UNION ALL SELECT 'outlier_has_rule', count(*), count(CASE WHEN is_outlier AND outlier_rule IS NULL THEN 1 END) FROM fx_clean", "fx_clean"))
def clean_rules(spark, d):
    c = V.clean(spark, d, "is_outlier", "outlier_rule", "is_imputed", "imputation_method")
    return gates.rule_report(c, {k: gates.CLEAN_RULES[k] for k in ("imputed_has_method", "outlier_has_rule")})


# one table per set of rules; faults come from the values themselves
_RULED = {
    "clean_quote": (
        gates.CLEAN_RULES,
        """SELECT CASE WHEN linenumber <> 5 THEN quote_id END AS quote_id, partkey % 7 = 0 AS is_imputed, CASE WHEN partkey % 3 = 0 THEN 'rule' END AS imputation_method, refundable AS is_outlier,
  CASE WHEN stops > 0 THEN 'rule' END AS outlier_rule, CAST(linenumber * 4 - 1 AS INT) AS dep_hour_bucket, CAST(linenumber - 2 AS INT) AS stops FROM fx_quote""",
    ),
    "route": (
        gates.ROUTE_RULES,
        "SELECT route_code, origin_iata, dest_iata, CAST(sum(total_c) AS DOUBLE) / 1000000000 / count(DISTINCT query_date) - 0.001 AS pax_share FROM fx_quote GROUP BY ALL",
    ),
    "index_value": (
        gates.VALUE_RULES,
        "SELECT route_code, query_month, sum(total_c) - 10000000 AS value, count(*) - 3 AS n_quotes, CASE WHEN count(*) > 2 THEN CAST(count(*) AS DOUBLE) END AS coverage_pct FROM fx_quote GROUP BY ALL",
    ),
    "collection_run": (
        gates.RUN_RULES,
        """SELECT min(collected_at) AS started_at, CASE WHEN count(*) % 5 > 0 THEN max(ship_date) END AS finished_at, CASE count(*) % 4 WHEN 0 THEN 'HALTED' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'SUCCEEDED' END AS status,
  count(*) - 2 AS quotes_collected, max(linenumber) - 2 AS blocked_count FROM fx_quote GROUP BY route_code, query_date""",
    ),
    "nowcast": (gates.NOWCAST_RULES, "SELECT query_month, min(total_c) + 100000 AS ci_low, CASE WHEN count(*) % 9 > 0 THEN max(total_c) END AS ci_high FROM fx_quote GROUP BY route_code, query_month"),
}
_RULED_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{n}' AS rule, count(*) AS row_count, count(CASE WHEN NOT ({e}) THEN 1 END) AS violations FROM {table}_rows"
    for table, (rules, _) in _RULED.items() for n, e in rules.items()
)


@query("p10_written_rules", with_views(_RULED_SQL, "fx_quote", **{f"{table}_rows": body for table, (_, body) in _RULED.items()}))
def written_rules(spark, d):
    """Clean quotes, routes, values, runs and nowcasts are each written once; the counts of their rules come from that write."""
    V.quotes(
        spark, d, "quote_id", "linenumber", "partkey", "refundable", "stops", "route_code", "origin_iata", "dest_iata", "total_c", "query_date", "query_month", "collected_at", "ship_date"
    ).createOrReplaceTempView("fx_quote")
    reports = []
    for name, (rules, body) in _RULED.items():
        path = scratch_path(spark, name)
        report = gates.write_checked(spark.sql(body), rules, lambda rows, path=path: rows.write.parquet(path))
        reports.append(report.select(F.lit(name).alias("table_name"), "rule", "row_count", "violations"))
    spark.catalog.dropTempView("fx_quote")
    return reduce(lambda a, b: a.unionByName(b), reports)


@query(
    "p09_unplaceable_rows",
    with_views("SELECT count(CASE WHEN is_imputed THEN 1 END) AS dropped_rows FROM fx_clean", "fx_clean"),
)
def unplaceable_rows(spark, d):
    c = V.clean(spark, d, "stops", "is_imputed", "carrier_iata")
    c = c.withColumn("stops", F.when(~F.col("is_imputed"), F.col("stops"))).withColumn("dep_hour_bucket", F.col("stops"))
    _, dropped = cleaning.drop_unplaceable(c)
    return dropped


@query(
    "j22_detection_recall",
    with_views(
        """SELECT kind, count(*) AS labelled, count(CASE WHEN is_outlier_iqr THEN 1 END) AS flagged, CAST(count(CASE WHEN is_outlier_iqr THEN 1 END) AS DOUBLE) / count(*) AS recall
FROM (SELECT quote_id, CASE WHEN total_c < 150000 THEN 'CHEAP' ELSE 'DEAR' END AS kind FROM fx_quote WHERE total_c < 150000 OR total_c > 9500000)
JOIN flags USING (quote_id) GROUP BY 1""",
        "fx_quote", **OUTLIER_STEPS,
    ),
)
def detection_recall(spark, d):
    """Extreme prices labelled by kind against the flags of the fence rule."""
    q = staged(priced(spark, d), "priced")
    t = F.col("total_fare")
    labels = q.where((t < 1500) | (t > 95000)).select("quote_id", F.when(t < 1500, "CHEAP").otherwise("DEAR").alias("kind"))
    flagged = cleaning.detect_outliers(q, ["route_id", "travel_month"], active_rule="iqr").where("is_outlier")
    return gates.detection_recall(labels, flagged)


# --- the whole cleaning run ------------------------------------------------------------------

RUN = CleaningOptions(
    outlier_group=("route_id", "travel_month"),
    dedup_group=("carrier_iata", "flight_number", "travel_month"),
    impute_group=("route_id", "carrier_type"),
    coverage_group=("route_id",),
)


def cleaning_run(spark, d):
    """Cells at month grain: lead and calendar are those of the sampling grid."""
    q = V.quotes_timed(
        spark, d, "quote_id", "collected_at", "source_id", "route_id", "origin_iata", "carrier_iata", "flight_number", "travel_date", "advance_days",
        "stops", "refundable", "baggage_included", "base_fare", "taxes", "udf", "convenience_fee", "total_fare", "dep_datetime_local", "query_month", "partkey",
    )
    q = q.withColumnsRenamed({"quote_id": "id"}).withColumn("travel_month", F.trunc("travel_date", "month"))
    q = q.withColumn("flight_number", F.when(F.col("partkey") % 50 != 0, "scheduled")).withColumn("advance_days", F.expr(V.WINDOW_START))
    q = q.withColumn("travel_date", F.date_add("query_month", F.col("advance_days")))
    expected, _, runs = grid(spark, d)
    return clean_quotes(q, expected, runs, V.carriers(spark, d), airport_fee(spark, d), "snapshot-1", RUN)


RUN_STATS = "SELECT fx_quote.route_id, carrier_type, sum(total_c) AS s, count(*) AS n FROM fx_quote JOIN flags USING (quote_id) LEFT JOIN fx_carrier USING (carrier_iata) WHERE NOT is_outlier_mad GROUP BY ALL"


@query(
    "p08_cleaning_run",
    with_views(
        """SELECT route_id, is_imputed, is_outlier, imputation_method, count(*) AS n_rows, sum(t) AS total_fare FROM (
  SELECT f.route_id, FALSE AS is_imputed, is_outlier_mad AS is_outlier, NULL AS imputation_method, CAST(total_c AS DECIMAL(20,2)) / 100 AS t
  FROM fx_quote JOIN flags f USING (quote_id)
  UNION ALL SELECT r.route_id, TRUE, FALSE, 'cell_mean', NULL FROM reasons r LEFT JOIN fx_carrier USING (carrier_iata)
    JOIN stats s ON s.route_id = r.route_id AND s.carrier_type IS NOT DISTINCT FROM fx_carrier.carrier_type
    WHERE missing_reason = 'sold_out' AND n >= 3) GROUP BY ALL""".replace("sum(t) AS total_fare", "round(sum(t), 2) AS total_fare"),
        "fx_quote", "fx_carrier", "fx_observed", "fx_month_run", **OUTLIER_STEPS, **GAP_STEPS, stats=RUN_STATS,
    ),
)
def whole_run(spark, d):
    c = cleaning_run(spark, d).clean
    total = F.sum(F.when(~F.col("is_imputed"), F.col("total_fare"))).cast("double")
    return c.groupBy("route_id", "is_imputed", "is_outlier", "imputation_method").agg(F.count(F.lit(1)).alias("n_rows"), total.alias("total_fare"))


@query("u01_clean_rows_by_kind", with_views(
    """SELECT is_imputed, count(*) AS n_rows FROM (SELECT FALSE AS is_imputed FROM fx_quote UNION ALL SELECT TRUE FROM reasons r LEFT JOIN fx_carrier USING (carrier_iata)
    JOIN stats s ON s.route_id = r.route_id AND s.carrier_type IS NOT DISTINCT FROM fx_carrier.carrier_type WHERE missing_reason = 'sold_out' AND n >= 3) GROUP BY 1""",
    "fx_quote", "fx_carrier", "fx_observed", "fx_month_run", **OUTLIER_STEPS, **GAP_STEPS, stats=RUN_STATS))
def clean_rows_by_kind(spark, d):
    return cleaning_run(spark, d).clean.groupBy("is_imputed").agg(F.count(F.lit(1)).alias("n_rows"))
