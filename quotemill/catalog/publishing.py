"""Vintages, splicing, publication rows, status, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quotemill.catalog import views as V
from quotemill.catalog.registry import query
from quotemill.catalog.views import with_views
from quotemill.functions.staging import scratch_path, staged
from quotemill.operators import analytics, splice, vintages
from quotemill.sources import exports

LATEST = "fx_latest"
COUNTS = "SELECT series_code, period, count(*) AS revision_count FROM fx_revision GROUP BY ALL"


def latest(spark, d, **kw):
    return vintages.latest_values(V.index_values(spark, d), V.index_runs(spark, d), **kw)


@query(
    "w01_latest_vintage",
    with_views("SELECT l.*, coalesce(revision_count, 0) AS revision_count FROM fx_latest l LEFT JOIN counts USING (series_code, period)", "fx_latest", "fx_revision", counts=COUNTS),
)
def latest_vintage(spark, d):
    return latest(spark, d, revisions=V.revisions(spark, d))


@query(
    "w01_latest_in_range",
    with_views("SELECT series_code, period, value, index_run_id FROM fx_latest WHERE period BETWEEN DATE '1997-03-01' AND DATE '1998-02-01'", "fx_latest"),
)
def latest_in_range(spark, d):
    out = latest(spark, d, period_from=dt.date(1997, 3, 1), period_to=dt.date(1998, 2, 1))
    return out.select("series_code", "period", "value", "index_run_id")


@query(
    "l01_value_as_of",
    with_views(
        """SELECT series_code, period, as_of, value, vintage_date, index_run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY series_code, period, as_of ORDER BY vintage_date DESC, computed_at DESC) AS rn
  FROM fx_index_value JOIN fx_index_run USING (index_run_id), (VALUES (DATE '1998-01-01'), (DATE '1999-12-31'), (DATE '2001-06-30')) t(as_of)
  WHERE released_at IS NOT NULL AND vintage_date <= as_of) WHERE rn = 1""",
        "fx_index_value",
    ),
)
def value_as_of(spark, d):
    dates = [dt.date(1998, 1, 1), dt.date(1999, 12, 31), dt.date(2001, 6, 30)]
    return vintages.value_as_of(V.index_values(spark, d), V.index_runs(spark, d), dates)


@query(
    "l01_matching_revision",
    with_views(
        """SELECT l.series_code, l.period, arg_max(r.reason, r.revised_at) AS reason, max(r.revised_at) AS revised_at
FROM fx_latest l JOIN fx_revision r ON l.series_code = r.series_code AND l.period = r.period AND l.value = r.new_value GROUP BY ALL""",
        "fx_latest", "fx_revision",
    ),
)
def matching_revision(spark, d):
    return vintages.latest_matching_revision(V.revisions(spark, d), latest(spark, d))


@query(
    "l02_latest_run",
    with_views("SELECT series_code, arg_max(index_run_id, computed_at) AS index_run_id, max(computed_at) AS computed_at FROM fx_index_value JOIN fx_index_run USING (index_run_id) WHERE released_at IS NOT NULL GROUP BY 1", "fx_index_value"),
)
def latest_run(spark, d):
    return vintages.latest_run(V.index_values(spark, d), V.index_runs(spark, d), ["series_code"])


@query("a37_revision_counts", with_views("SELECT * FROM counts", "fx_revision", counts=COUNTS))
def revision_counts(spark, d):
    return vintages.revision_counts(V.revisions(spark, d))


_RUNS_OF = """SELECT r.*, index_run_id, vintage_date, computed_at FROM fx_revision r LEFT JOIN (
  SELECT * FROM (SELECT series_code, period, value AS new_value, index_run_id, vintage_date, computed_at,
    row_number() OVER (PARTITION BY series_code, period, value ORDER BY computed_at DESC) AS rn FROM fx_index_value JOIN fx_index_run USING (index_run_id)) WHERE rn = 1) v
USING (series_code, period, new_value)"""


@query("j15_revision_runs", with_views("SELECT series_code, period, old_value, new_value, reason, revised_at, index_run_id, vintage_date, computed_at FROM (" + _RUNS_OF + ")", "fx_revision"))
def revision_runs(spark, d):
    values = staged(V.index_values(spark, d), "values")
    return vintages.revision_runs(V.revisions(spark, d, values), values, V.index_runs(spark, d))


@query(
    "w02_latest_run_per_revision",
    with_views("SELECT index_run_id, reason, count(*) AS n FROM (" + _RUNS_OF + ") GROUP BY ALL", "fx_revision"),
)
def latest_run_per_revision(spark, d):
    values = staged(V.index_values(spark, d), "values")
    out = vintages.revision_runs(V.revisions(spark, d, values), values, V.index_runs(spark, d))
    return out.groupBy("index_run_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l05_revisions_newest_first",
    with_views("SELECT series_code, period, new_value, revised_at FROM fx_revision ORDER BY revised_at DESC, series_code, period", "fx_revision"),
)
def revisions_newest_first(spark, d):
    """The whole revision list, newest first."""
    r = V.revisions(spark, d).select("series_code", "period", "new_value", "revised_at")
    return r.orderBy(F.col("revised_at").desc(), "series_code", "period")


@query("p14_visible_runs", with_views("SELECT index_run_id FROM fx_index_run WHERE released_at IS NOT NULL", "fx_index_run"))
def visible_runs(spark, d):
    return vintages.visible_runs(V.index_runs(spark, d)).select("index_run_id")


@query(
    "p15_series_dimensions",
    with_views(
        """SELECT series_code, CASE WHEN series_code = 'PX.ALL.M' THEN 'scope=national' ELSE 'route_code=' || split_part(series_code, '.', 3) END AS dimension
FROM (SELECT DISTINCT series_code FROM fx_index_value) WHERE series_code LIKE 'PX.%'""",
        "fx_index_value",
    ),
)
def series_dimensions(spark, d):
    s = vintages.series_like(V.index_values(spark, d).select("series_code").distinct(), "PX.")
    e = F.map_entries(vintages.series_dimensions())[0]
    return s.select("series_code", F.concat_ws("=", e["key"], e["value"]).alias("dimension"))


@query(
    "p15_series_for_key",
    with_views(
        """SELECT key, CASE WHEN r <> 'ALL' THEN 'PX.ROUTE.' || r || '.M' WHEN c <> 'ALL' THEN 'PX.CARRIERTYPE.' || c || '.M' WHEN w <> 'ALL' THEN 'PX.WINDOW.' || w || '.M' ELSE 'PX.ALL.M' END AS series_code
FROM (SELECT DISTINCT CASE WHEN stops = 0 THEN route_code ELSE 'ALL' END AS r, CASE WHEN linenumber % 2 = 0 THEN coalesce(carrier_type, 'ALL') ELSE 'ALL' END AS c,
  CASE WHEN returnflag = 'N' THEN advance_window ELSE 'ALL' END AS w, 'M.' || r || '.' || c || '.' || w AS key FROM fx_clean)""",
        "fx_clean",
    ),
)
def series_for_key(spark, d):
    c = V.clean(spark, d, "stops", "route_code", "linenumber", "carrier_type", "returnflag", "advance_window")
    keys = c.select(
        F.concat_ws(
            ".", F.lit("M"), F.when(F.col("stops") == 0, F.col("route_code")).otherwise("ALL"),
            F.when(F.col("linenumber") % 2 == 0, F.coalesce("carrier_type", F.lit("ALL"))).otherwise("ALL"),
            F.when(F.col("returnflag") == "N", F.col("advance_window")).otherwise("ALL"),
        ).alias("key")
    ).distinct()
    return keys.select("key", vintages.series_code_for_key().alias("series_code"))


@query(
    "p22_point_status",
    with_views(
        """SELECT series_code, period, CASE WHEN released_at IS NULL THEN 'PROVISIONAL' WHEN coalesce(revision_count, 0) > 0 THEN 'REVISED' ELSE 'PUBLISHED' END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY series_code, period ORDER BY vintage_date DESC) AS rn FROM fx_index_value JOIN fx_index_run USING (index_run_id)) l
LEFT JOIN (SELECT series_code, period, count(*) AS revision_count FROM fx_revision WHERE old_value IS NOT NULL GROUP BY ALL) USING (series_code, period) WHERE rn = 1""",
        "fx_revision",
    ),
)
def point_status(spark, d):
    later = V.revisions(spark, d).where(F.col("old_value").isNotNull())
    return vintages.point_status(latest(spark, d, revisions=later, role="internal")).select("series_code", "period", "status")


_IMPUTED = "quantity = 50 AND discount > 0.09 AND partkey % 5 = 0"


def stored(df):
    """Values at a stored precision, so that printing them needs no further rounding."""
    return df.withColumn("value", F.floor(F.col("value") * 1000) / 1000)


def lineage_view(spark, d):
    q = V.quotes(spark, d, "quote_id", "query_date", "query_month", "quantity", "discount", "partkey")
    edges = q.select(F.concat(F.lit("run-"), (F.year("query_date") + 1).cast("string")).alias("index_run_id"), F.col("query_month").alias("period"), F.col("quote_id").alias("clean_id"))
    return edges, q.select(F.col("quote_id").alias("clean_id"), F.expr(_IMPUTED).alias("is_imputed"))


@query("a33_imputed_points", with_views(f"SELECT DISTINCT 'run-' || (year(query_date) + 1) AS index_run_id, query_month AS period FROM fx_quote WHERE {_IMPUTED}", "fx_quote"))
def imputed_points(spark, d):
    edges, c = lineage_view(spark, d)
    return vintages.imputed_points(edges, c)


EXPORTED = with_views(
        f"""SELECT series_code AS series, strftime(period, '%Y-%m-%d') AS period, printf('%.6f', floor(value * 1000) / 1000) AS value, CAST(n_quotes AS VARCHAR) AS n_quotes,
  printf('%.2f', coverage_pct) AS coverage_pct, CASE WHEN i.period2 IS NULL THEN 'false' ELSE 'true' END AS is_imputed,
  CASE WHEN coalesce(revision_count, 0) > 0 THEN 'REVISED' ELSE 'PUBLISHED' END AS status, index_run_id, 'PUBLISHED' AS data_status
FROM fx_latest l LEFT JOIN counts USING (series_code, period)
LEFT JOIN (SELECT DISTINCT 'run-' || (year(query_date) + 1) AS run2, query_month AS period2 FROM fx_quote WHERE {_IMPUTED}) i ON run2 = index_run_id AND period2 = l.period""",
        "fx_latest", "fx_revision", counts="SELECT series_code, period, count(*) AS revision_count FROM fx_revision WHERE old_value IS NOT NULL GROUP BY ALL",
    )


@query("s18_export_rows", EXPORTED)
def export_rows(spark, d):
    edges, c = lineage_view(spark, d)
    later = V.revisions(spark, d).where(F.col("old_value").isNotNull())
    return exports.export_rows(stored(latest(spark, d, revisions=later)), vintages.imputed_points(edges, c))


@query("s18_csv_file", EXPORTED)
def csv_file(spark, d):
    """The export written as CSV files and read back; an empty field is an empty text."""
    path = scratch_path(spark, "export")
    exports.write_csv(export_rows(spark, d), path)
    read = spark.read.schema(", ".join(f"{c} string" for c in exports.CSV_COLUMNS)).option("header", True).csv(path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in exports.CSV_COLUMNS])


OBSERVATIONS = """SELECT series_code, count(*) AS n_points, '{' || string_agg('"' || i || '":[' || printf('%.6f', floor(value * 1000) / 1000) || ',0,' || i || ']', ',' ORDER BY period) || '}' AS observations,
  '[' || string_agg('{"id":"' || strftime(period, '%Y-%m') || '","name":"' || strftime(period, '%Y-%m') || '"}', ',' ORDER BY period) || ']' AS time_periods,
  '[' || string_agg('{"id":"' || n_quotes || '","name":"' || n_quotes || '"}', ',' ORDER BY period) || ']' AS n_quotes_values
FROM (SELECT *, row_number() OVER (PARTITION BY series_code ORDER BY period) - 1 AS i FROM fx_latest) GROUP BY 1"""


@query("s19_sdmx_observations", with_views(OBSERVATIONS, "fx_latest"))
def sdmx_observations(spark, d):
    return exports.sdmx_observations(stored(latest(spark, d)))


def _message_sql() -> str:
    """The message text, from the constant parts and SQL for what stands between them."""
    windows = "[" + ", ".join(f"'{i}'" for i, _ in exports.WINDOWS) + "]"
    carriers = "[" + ", ".join(f"'{i}'" for i, _ in exports.CARRIER_TYPES) + "]"
    at = lambda kind, codes: f"CASE WHEN kind = '{kind}' THEN greatest(coalesce(list_position({codes}, part), 0) - 1, 0) ELSE 0 END"
    key = " || ':' || ".join(["'0'", at("ROUTE", "codes"), at("CARRIERTYPE", carriers), at("WINDOW", windows)])
    named = """'[' || list_aggregate(list_transform(codes, lambda c: '{"id":"' || c || '","name":"' || CASE WHEN c = 'ALL' THEN 'All basket routes' ELSE c END || '"}'), 'string_agg', ',') || ']'"""
    variable = ["series_code", "'2002-01-01T00:00:00Z'", key, "observations", named, "time_periods", "n_quotes_values"]
    quoted = [part.replace("'", "''") for part in exports.message_segments("PX", "Price index")]
    return f"'{quoted[0]}'" + "".join(f" || {v} || '{part}'" for v, part in zip(variable, quoted[1:], strict=True))


@query(
    "s19_sdmx_messages",
    with_views(
        f"""SELECT series_code, {_message_sql()} AS message FROM (
  SELECT *, split_part(series_code, '.', 2) AS kind, split_part(series_code, '.', 3) AS part FROM obs), (SELECT list_concat(['ALL'], list(route_code ORDER BY route_code)) AS codes FROM fx_route)""",
        "fx_latest", "fx_route", obs=OBSERVATIONS,
    ),
)
def sdmx_messages(spark, d):
    """Whole messages of the national and all route series; the route dimension lists the table's routes."""
    return exports.sdmx_messages(stored(latest(spark, d)), V.routes(spark, d), "PX", "Price index", "2002-01-01 00:00:00")


# --- splicing --------------------------------------------------------------------------------

# a series that was never published stands beside the stored ones: the values of PX.ALL.M under a name of its own
def _new_series_sql(body: str) -> str:
    return f"SELECT * FROM ({body}) UNION ALL SELECT * REPLACE ('PX.NEW.M' AS series_code) FROM ({body}) WHERE series_code = 'PX.ALL.M'"


def with_new_series(values):
    return values.unionByName(values.where(F.col("series_code") == "PX.ALL.M").withColumn("series_code", F.lit("PX.NEW.M")))


# window: the newest run's thirteen months to December 2000; published: the run before
WINDOWS = _new_series_sql("SELECT series_code, period, value AS level FROM fx_index_value WHERE index_run_id = 'run-2002' AND period BETWEEN DATE '1999-12-01' AND DATE '2000-12-01'")
PUBLISHED = "SELECT series_code, period, value FROM fx_index_value WHERE index_run_id = 'run-2001'"
LINKS = """SELECT w.series_code, w.period, row_number() OVER (PARTITION BY w.series_code ORDER BY w.period DESC) - 1 AS k, count(*) OVER (PARTITION BY w.series_code) AS length,
  p.value * first_value(level) OVER (PARTITION BY w.series_code ORDER BY w.period DESC) / level AS estimate, p.value AS pub, level
FROM windows w LEFT JOIN published p USING (series_code, period)"""
SPLICE_STEPS = dict(windows=WINDOWS, published=PUBLISHED, links=LINKS)


def splice_inputs(spark, d):
    v = staged(V.index_values(spark, d), "values")
    span = F.col("period").between(F.lit("1999-12-01").cast("date"), F.lit("2000-12-01").cast("date"))
    w = v.where((F.col("index_run_id") == "run-2002") & span).select("series_code", "period", F.col("value").alias("level"))
    p = v.where(F.col("index_run_id") == "run-2001").select("series_code", "period", "value")
    return with_new_series(w), p


@query("w12_link_estimates", with_views("SELECT series_code, k, round(estimate, 6) AS estimate FROM links WHERE k > 0 AND estimate IS NOT NULL", "fx_index_value", **SPLICE_STEPS))
def link_estimates(spark, d):
    e = splice.link_estimates(*splice_inputs(spark, d))
    return e.where(F.col("estimate").isNotNull()).select("series_code", "k", F.round("estimate", 6).alias("estimate"))


@query(
    "w13_splice_methods",
    with_views(
        """SELECT series_code, max(newest) AS period, round(max(CASE WHEN k = 1 THEN estimate END), 6) AS movement, round(max(CASE WHEN k = length - 1 THEN estimate END), 6) AS window,
  round(max(CASE WHEN k = CAST(ceil((length - 1) / 2.0) AS INT) THEN estimate END), 6) AS half, round(max(CASE WHEN k = length - 1 THEN estimate END), 6) AS fbew,
  round(max(CASE WHEN k = length - 1 THEN estimate END), 6) AS fbmw, round(exp(avg(ln(estimate))), 6) AS mean
FROM (SELECT *, max(period) OVER (PARTITION BY series_code) AS newest FROM links) WHERE k > 0 GROUP BY 1""",
        "fx_index_value", **SPLICE_STEPS,
    ),
)
def splice_methods(spark, d):
    out = splice.splice_all(*splice_inputs(spark, d), ("movement", "window", "half", "fbew", "fbmw", "mean"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("series_code", "period")})


@query(
    "w14_rebase_due",
    with_views(
        """SELECT series_code, period, rn - coalesce(last, 1) AS periods_since_rebase, rn - coalesce(last, 1) >= 6 AS rebase_due FROM (
  SELECT *, max(CASE WHEN month(period) = 1 THEN rn END) OVER (PARTITION BY series_code ORDER BY period) AS last FROM (
    SELECT series_code, period, row_number() OVER (PARTITION BY series_code ORDER BY period) AS rn FROM fx_latest))""",
        "fx_latest",
    ),
)
def rebase_due(spark, d):
    s = latest(spark, d).select("series_code", "period", (F.month("period") == 1).alias("is_rebase"))
    return splice.rebase_due(s, 6).select("series_code", "period", "periods_since_rebase", "rebase_due")


COVER = _new_series_sql("SELECT series_code, n_quotes, coverage_pct FROM fx_index_value WHERE index_run_id = 'run-2002' AND period = DATE '2000-12-01'")
PUB = """SELECT w.series_code, max(w.period) AS period, CASE WHEN count(CASE WHEN k > 0 AND pub IS NULL THEN 1 END) = 0 THEN max(CASE WHEN k = 1 THEN estimate END)
    ELSE max(CASE WHEN k = 0 THEN level END) / max(CASE WHEN k = length - 1 THEN level END) END AS value, max(CASE WHEN k = 0 THEN pub END) AS old_value
FROM links w GROUP BY 1"""


def publish(spark, d):
    v = V.index_values(spark, d).where((F.col("index_run_id") == "run-2002") & (F.col("period") == F.lit("2000-12-01").cast("date")))
    return splice.publish(*splice_inputs(spark, d), with_new_series(v.select("series_code", "n_quotes", "coverage_pct")))


@query(
    "w15_published_values",
    with_views("SELECT series_code, period, round(value, 6) AS value, n_quotes, coverage_pct FROM pub JOIN cover USING (series_code)", "fx_index_value", **SPLICE_STEPS, pub=PUB, cover=COVER),
)
def published_values(spark, d):
    values, _, _ = publish(spark, d)
    return values.withColumn("value", F.round("value", 6))


@query(
    "w15_revisions",
    with_views(
        """SELECT series_code, period, round(old_value, 6) AS old_value, round(value, 6) AS new_value FROM pub
WHERE old_value IS NOT NULL AND abs(value - old_value) > 1e-9 * greatest(1.0, abs(old_value))""",
        "fx_index_value", **SPLICE_STEPS, pub=PUB,
    ),
)
def publish_revisions(spark, d):
    _, r, _ = publish(spark, d)
    return r.select("series_code", "period", F.round("old_value", 6).alias("old_value"), F.round("new_value", 6).alias("new_value"))


# a run over stored tables: every stored series has history, the new one starts at 100
RUN_CUR = _new_series_sql("SELECT series_code, value AS index_value, n_quotes, coverage_pct FROM fx_index_value WHERE index_run_id = 'run-2002' AND period = DATE '2000-12-01'")
RUN_PRI = _new_series_sql("SELECT series_code, value AS index_value FROM fx_index_value WHERE index_run_id = 'run-2002' AND period = DATE '2000-11-01'")
RUN_PUB = "SELECT series_code, period, value FROM fx_index_value WHERE index_run_id = 'run-2001' AND period < DATE '2000-12-01'"
RUN_ROWS = """SELECT series_code, index_value / coalesce(p.index_value_p, index_value) * coalesce(h.value, 100.0) AS value, n_quotes, coverage_pct, h.value IS NULL AS fresh
FROM cur LEFT JOIN (SELECT series_code, index_value AS index_value_p FROM pri) p USING (series_code)
LEFT JOIN (SELECT series_code, value FROM known WHERE period = DATE '2000-11-01') h USING (series_code)"""
RUN_STEPS = dict(cur=RUN_CUR, pri=RUN_PRI, known=RUN_PUB, run_rows=RUN_ROWS)


def publication(spark, d):
    v = staged(V.index_values(spark, d), "values")
    of = lambda run, day: v.where((F.col("index_run_id") == run) & (F.col("period") == F.lit(day).cast("date")))
    at = lambda run, day: with_new_series(of(run, day).select("series_code", F.col("value").alias("index_value"), "n_quotes", "coverage_pct"))
    published = v.where((F.col("index_run_id") == "run-2001") & (F.col("period") < F.lit("2000-12-01").cast("date"))).select("series_code", "period", "value")
    return splice.publication_rows(at("run-2002", "2000-12-01"), at("run-2002", "2000-11-01"), published, F.lit("2000-12-15").cast("date"))


@query(
    "w16_run_values",
    with_views(
        """SELECT series_code, DATE '2000-12-01' AS period, round(value, 6) AS value, n_quotes, coverage_pct FROM run_rows
UNION ALL SELECT series_code, DATE '2000-11-01', 100.0, 0, NULL FROM run_rows WHERE fresh""",
        "fx_index_value", **RUN_STEPS,
    ),
)
def run_values(spark, d):
    return publication(spark, d)["index_value"].withColumn("value", F.round("value", 6))


@query(
    "w16_run_revision_log",
    with_views(
        """SELECT series_code, DATE '2000-12-01' AS period, NULL AS old_value, round(value, 6) AS new_value FROM run_rows
UNION ALL SELECT series_code, DATE '2000-11-01', NULL, 100.0 FROM run_rows WHERE fresh""",
        "fx_index_value", **RUN_STEPS,
    ),
)
def run_revision_log(spark, d):
    r = publication(spark, d)["revision_log"]
    return r.select("series_code", "period", "old_value", F.round("new_value", 6).alias("new_value"))


@query(
    "u04_dropped_series",
    with_views("SELECT DISTINCT series_code FROM fx_index_value WHERE index_run_id = 'run-2001' AND series_code NOT IN (SELECT 'PX.ROUTE.' || route_code || '.M' FROM fx_pax)", "fx_index_value", "fx_pax"),
)
def dropped_series(spark, d):
    """Published series without a weight in the current basket."""
    prior = V.index_values(spark, d).where(F.col("index_run_id") == "run-2001").select("series_code").distinct()
    now = V.pax_weights(spark, d).select(F.concat(F.lit("PX.ROUTE."), F.col("route_code"), F.lit(".M")).alias("series_code"))
    return prior.join(now, "series_code", "left_anti")


@query(
    "s17_lineage",
    with_views(
        """SELECT series_code, period, count(*) AS edges FROM (SELECT unnest(['PX.ALL.M', 'PX.ROUTE.' || route_code || '.M']) AS series_code, DATE '1998-05-01' AS period
  FROM fx_clean WHERE query_date = DATE '1998-05-20' AND NOT is_outlier) WHERE series_code IN (SELECT series_code FROM fx_index_value) GROUP BY ALL""",
        "fx_clean", "fx_index_value",
    ),
)
def lineage(spark, d):
    c = V.clean(spark, d, "quote_id", "route_code", "query_date", "is_outlier").withColumnRenamed("quote_id", "clean_id")
    current = V.index_values(spark, d).select("series_code").distinct()
    out = splice.lineage(c, current, F.lit("1998-05-20").cast("date"))
    return out.groupBy("series_code", "period").agg(F.count(F.lit(1)).alias("edges"))


# --- series arithmetic -----------------------------------------------------------------------


@query(
    "w07_month_changes",
    with_views(
        """SELECT l.series_code, l.period, l.value, round((l.value - m.value) / m.value * 100, 6) AS mom_pct, round((l.value - y.value) / y.value * 100, 6) AS yoy_pct,
  CASE WHEN m.value IS NULL THEN 'fewer than two periods' END AS mom_reason, CASE WHEN y.value IS NULL THEN 'no value twelve months earlier' END AS yoy_reason
FROM (SELECT *, lag(period) OVER (PARTITION BY series_code ORDER BY period) AS before FROM fx_latest) l
LEFT JOIN fx_latest m ON m.series_code = l.series_code AND m.period = l.before
LEFT JOIN fx_latest y ON y.series_code = l.series_code AND y.period = l.period - INTERVAL 12 MONTH""",
        "fx_latest",
    ),
)
def month_changes(spark, d):
    """Every published month of every series."""
    s = staged(latest(spark, d).select("series_code", "period", "value"), "latest")
    out = vintages.month_changes(s)
    return out.withColumns({c: F.round(c, 6) for c in ("mom_pct", "yoy_pct")})


def route_cells(spark, d):
    l = latest(spark, d).where(F.col("series_code").startswith("PX.ROUTE."))
    return l.select(F.split("series_code", r"\.")[2].alias("route_code"), "period", "value", "n_quotes")


CELLS = "SELECT split_part(series_code, '.', 3) AS route_code, period, value, n_quotes FROM fx_latest WHERE series_code LIKE 'PX.ROUTE.%'"
MOMENTUM = """SELECT route_code, (value - prev) / prev * 100 AS momentum_pct, value AS latest_value, period AS latest_period FROM (
  SELECT *, lag(value) OVER (PARTITION BY route_code ORDER BY period) AS prev, max(period) OVER (PARTITION BY route_code) AS last FROM cells) WHERE period = last AND prev IS NOT NULL"""


@query(
    "w06_movers",
    with_views("SELECT route_code, round(momentum_pct, 6) AS momentum_pct, latest_value, latest_period FROM m ORDER BY abs(m.momentum_pct) DESC, route_code LIMIT 4", "fx_latest", cells=CELLS, m=MOMENTUM),
)
def movers(spark, d):
    return analytics.movers(route_cells(spark, d)).withColumn("momentum_pct", F.round("momentum_pct", 6))


@query(
    "j21_corridors",
    with_views(
        """SELECT route_code, o.lat AS origin_lat, o.lon AS origin_lon, t.lat AS dest_lat, t.lon AS dest_lon, round(coalesce(momentum_pct, 0), 6) AS momentum_pct
FROM fx_route r JOIN fx_airport o ON r.origin_iata = o.iata JOIN fx_airport t ON r.dest_iata = t.iata LEFT JOIN m USING (route_code)
WHERE o.lat IS NOT NULL AND o.lon IS NOT NULL AND t.lat IS NOT NULL AND t.lon IS NOT NULL""",
        "fx_latest", "fx_route", "fx_airport", cells=CELLS, m=MOMENTUM,
    ),
)
def corridors(spark, d):
    r = analytics.route_with_airports(V.routes(spark, d), V.airports(spark, d))
    out = analytics.corridors(r, route_cells(spark, d))
    return out.select("route_code", "origin_lat", "origin_lon", "dest_lat", "dest_lon", F.round("momentum_pct", 6).alias("momentum_pct"))


@query(
    "a42_heatmap",
    with_views(
        """SELECT route_code, period, value, n_quotes, round((value - m) / m * 100, 6) AS deviation_pct FROM (SELECT *, avg(value) OVER (PARTITION BY route_code) AS m FROM cells)""",
        "fx_latest", cells=CELLS,
    ),
)
def heatmap(spark, d):
    cells = staged(route_cells(spark, d), "cells")
    return analytics.heatmap(cells).withColumn("deviation_pct", F.round("deviation_pct", 6))


@query(
    "a42_heatmap_scale",
    with_views("SELECT round(greatest(1.0, max(abs((value - m) / m * 100))), 6) AS max_abs_deviation FROM (SELECT *, avg(value) OVER (PARTITION BY route_code) AS m FROM cells)", "fx_latest", cells=CELLS),
)
def heatmap_scale(spark, d):
    cells = staged(route_cells(spark, d), "cells")
    return analytics.heatmap_scale(analytics.heatmap(cells)).withColumn("max_abs_deviation", F.round("max_abs_deviation", 6))


@query(
    "a43_contributors",
    with_views(
        """SELECT route_code, period, value, n_quotes, weight, round(weight / sum(weight) OVER () * ln(value), 6) AS contribution
FROM cells LEFT JOIN fx_pax USING (route_code) WHERE period = DATE '1998-06-01'""",
        "fx_latest", "fx_pax", cells=CELLS,
    ),
)
def contributors(spark, d):
    rows = staged(route_cells(spark, d), "cells")
    out = analytics.contributors(rows, staged(V.pax_weights(spark, d), "weights"), F.lit("1998-06-01").cast("date"))
    return out.withColumn("contribution", F.round("contribution", 6))


@query(
    "w11_share_within",
    with_views("SELECT series_code, period, n_quotes, CAST(n_quotes AS DOUBLE) / sum(n_quotes) OVER (PARTITION BY period) AS share FROM fx_latest WHERE series_code LIKE 'PX.ROUTE.%'", "fx_latest"),
)
def share_within(spark, d):
    s = staged(latest(spark, d).where(F.col("series_code").startswith("PX.ROUTE.")).select("series_code", "period", "n_quotes"), "latest")
    return vintages.share_within(s, ["period"], "n_quotes")


@query(
    "w08_latest_known",
    with_views(
        """SELECT series_code, period, arg_max(value, computed_at) AS value, max(computed_at) AS collected_at FROM fx_index_value JOIN fx_index_run USING (index_run_id)
WHERE computed_at <= TIMESTAMP '1999-06-30 00:00:00' GROUP BY ALL""",
        "fx_index_value",
    ),
)
def latest_known(spark, d):
    v = V.index_values(spark, d).join(V.index_runs(spark, d), "index_run_id").withColumnRenamed("computed_at", "collected_at")
    return vintages.latest_known(v, dt.date(1999, 6, 30), ["series_code", "period"], "value")
