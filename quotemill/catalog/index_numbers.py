"""Elementary, bilateral and multilateral indices, and weighted roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.catalog import views as V
from quotemill.catalog.registry import query
from quotemill.catalog.views import with_views
from quotemill.functions.staging import staged
from quotemill.operators import aggregate, elementary, hedonic, multilateral


def r6(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# --- matched pairs: one product's mean price against its own price a month earlier -----------

PAIRS = """SELECT a.route_code, a.query_month AS period, a.carrier_iata, a.price AS p_t, b.price AS p_0
FROM fx_monthly a JOIN fx_monthly b ON a.route_code = b.route_code AND a.carrier_iata = b.carrier_iata
  AND b.query_month = a.query_month - INTERVAL 1 MONTH"""
MONTHLY = """SELECT route_code, carrier_iata, query_month, CAST(sum(total_c) AS DOUBLE) / 100 / count(*) AS price
FROM fx_quote GROUP BY ALL"""


def monthly_pairs(spark, d):
    q = V.quotes(spark, d, "route_code", "carrier_iata", "query_month", "total_c")
    m = q.groupBy("route_code", "carrier_iata", "query_month").agg(
        (F.sum("total_c").cast("double") / 100 / F.count(F.lit(1))).alias("price")
    )
    pairs = elementary.consecutive_pairs(
        m, ["route_code", "carrier_iata"], "query_month", F.add_months("query_month", 1), {"price": ("p_t", "p_0")}
    )
    return pairs.withColumnRenamed("query_month", "period")


def _elementary(name: str, formula: str, sql: str):
    oracle = with_views(
        f"SELECT route_code, period, count(*) AS n_pairs, round({sql}, 6) AS index_value FROM pairs GROUP BY ALL",
        "fx_quote", fx_monthly=MONTHLY, pairs=PAIRS,
    )

    @query(name, oracle)
    def run(spark, d):
        return r6(elementary.elementary_index(monthly_pairs(spark, d), ["route_code", "period"], formula), "index_value")

    return run


_elementary("a01_jevons", "jevons", "exp(avg(ln(p_t / p_0)))")
_elementary("a02_dutot", "dutot", "avg(p_t) / avg(p_0)")
_elementary("a03_carli", "carli", "avg(p_t / p_0)")


@query(
    "a04_formula_comparison",
    with_views(
        """SELECT route_code, period, n_pairs, round(j, 6) AS jevons, round(u, 6) AS dutot, round(c, 6) AS carli,
  round((u / j - 1) * 100, 6) AS dutot_vs_jevons_pct, round((c / j - 1) * 100, 6) AS carli_vs_jevons_pct
FROM (SELECT route_code, period, count(*) AS n_pairs, exp(avg(ln(p_t / p_0))) AS j, avg(p_t) / avg(p_0) AS u, avg(p_t / p_0) AS c
  FROM pairs GROUP BY ALL)""",
        "fx_quote", fx_monthly=MONTHLY, pairs=PAIRS,
    ),
)
def formula_comparison(spark, d):
    out = elementary.formula_comparison(monthly_pairs(spark, d), ["route_code", "period"])
    return r6(out, "jevons", "dutot", "carli", "dutot_vs_jevons_pct", "carli_vs_jevons_pct")


# --- boundary preview ------------------------------------------------------------------------

BOUNDARY = """SELECT route_code, carrier_iata, flight_number,
  sum(CASE WHEN query_month = m0 THEN total_c END) / 100.0 / count(CASE WHEN query_month = m0 THEN 1 END) AS p_0,
  sum(CASE WHEN query_month = m1 THEN total_c END) / 100.0 / count(CASE WHEN query_month = m1 THEN 1 END) AS p_t
FROM fx_quote, (SELECT CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS m1,
  CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 11 MONTH AS DATE) AS m0 FROM orders)
WHERE query_month IN (m0, m1) GROUP BY ALL HAVING p_0 IS NOT NULL AND p_t IS NOT NULL"""


def boundary(spark, d):
    """First and last month of the latest twelve-month window; both months are one row beside the quotes."""
    last = F.trunc(F.max("o_orderdate"), "month")
    ends = V.table(spark, d, "orders").agg(last.alias("__last"), F.add_months(last, -11).alias("__first"))  # one row
    q = V.quotes(spark, d, "route_code", "carrier_iata", "flight_number", "query_month", "total_fare").crossJoin(F.broadcast(ends))
    return elementary.boundary_pairs(q, ["route_code", "carrier_iata", "flight_number"], "query_month", F.col("__first"), F.col("__last"))


@query(
    "j08_boundary_pairs",
    with_views("SELECT route_code, carrier_iata, flight_number, round(p_0, 6) AS p_0, round(p_t, 6) AS p_t FROM pairs", "fx_quote", pairs=BOUNDARY),
)
def boundary_pairs(spark, d):
    return r6(boundary(spark, d), "p_0", "p_t")


@query(
    "p24_method_preview",
    with_views(
        """SELECT route_code, count(*) AS n_pairs, round(exp(avg(ln(p_t / p_0))), 6) AS jevons, round(avg(p_t) / avg(p_0), 6) AS dutot,
  round((avg(p_t) / avg(p_0) / exp(avg(ln(p_t / p_0))) - 1) * 100, 6) AS dutot_vs_jevons_pct FROM pairs GROUP BY ALL""",
        "fx_quote", pairs=BOUNDARY,
    ),
)
def method_preview(spark, d):
    out = elementary.formula_comparison(boundary(spark, d), ["route_code"], ("jevons", "dutot"))
    return r6(out, "jevons", "dutot", "dutot_vs_jevons_pct")


# --- bilateral and multilateral --------------------------------------------------------------

LINKS = """SELECT a.cell, a.period AS l, b.period AS t, count(*) AS n_products,
  sum((a.share + b.share) / 2 * ln(b.price / a.price)) / sum((a.share + b.share) / 2) AS ln_index
FROM fx_panel a JOIN fx_panel b ON a.cell = b.cell AND a.product_id = b.product_id AND a.period < b.period GROUP BY ALL"""


@query(
    "a05_tornqvist_monthly",
    with_views(
        """SELECT b.cell, b.period, count(*) AS n_products,
  round(exp(sum((a.share + b.share) / 2 * ln(b.price / a.price)) / sum((a.share + b.share) / 2)), 6) AS index_value
FROM fx_panel a JOIN fx_panel b ON a.cell = b.cell AND a.product_id = b.product_id AND a.period = b.period - INTERVAL 1 MONTH GROUP BY ALL""",
        "fx_panel",
    ),
)
def tornqvist_monthly(spark, d):
    pairs = elementary.consecutive_pairs(
        V.panel(spark, d), ["cell", "product_id"], "period", F.add_months("period", 1), {"price": ("p1", "p0"), "share": ("s1", "s0")}
    )
    return r6(elementary.tornqvist_bilateral(pairs, ["cell", "period"]), "index_value")


@query("j07_period_pairs", with_views("SELECT cell, l, t, n_products, round(ln_index, 6) AS ln_index FROM links", "fx_panel", links=LINKS))
def period_pairs(spark, d):
    return r6(multilateral.bilateral_links(staged(V.panel(spark, d), "panel"), ["cell"]), "ln_index")


GEKS = """SELECT cell, period, round(exp(c - first_value(c) OVER (PARTITION BY cell ORDER BY period)), 6) AS index_value FROM (
  SELECT cell, period, sum(x) / m AS c, m, count(*) AS links FROM (
    SELECT cell, t AS period, ln_index AS x FROM links UNION ALL SELECT cell, l, -ln_index FROM links)
  JOIN (SELECT cell, count(DISTINCT period) AS m FROM fx_panel GROUP BY cell) USING (cell) GROUP BY cell, period, m)
QUALIFY count(*) OVER (PARTITION BY cell) = m AND min(links) OVER (PARTITION BY cell) = m - 1"""


@query("a06_geks_tornqvist", with_views(GEKS, "fx_panel", links=LINKS))
def geks(spark, d):
    levels, _ = multilateral.geks_tornqvist(staged(V.panel(spark, d), "panel"), ["cell"])
    return r6(levels, "index_value")


# weighted least squares with the products taken out, the first period as reference: normal equations of the other periods, swept
TPD_STEPS = dict(
    own="""SELECT cell, product_id, share AS w, ln(price) AS y, sum(share) OVER o AS wi, sum(share * ln(price)) OVER o / sum(share) OVER o AS mean, period,
  dense_rank() OVER (PARTITION BY cell ORDER BY period) - 1 AS t FROM fx_panel WINDOW o AS (PARTITION BY cell, product_id)""",
    grid="SELECT a.cell, a.t, b.t AS s FROM (SELECT DISTINCT cell, t FROM own WHERE t > 0) a JOIN (SELECT DISTINCT cell, t FROM own WHERE t > 0) b USING (cell)",
    normal="SELECT cell, l.t, r.t AS s, sum(CASE WHEN l.t = r.t THEN l.w ELSE 0 END - l.w * r.w / l.wi) AS v FROM own l JOIN own r USING (cell, product_id) GROUP BY ALL",
    sides="SELECT cell, t, sum(w * (y - mean)) AS b FROM own GROUP BY ALL",
    lines="SELECT cell, t, list_append(list(coalesce(v, 0) ORDER BY s), any_value(b)) AS l FROM grid LEFT JOIN normal USING (cell, t, s) JOIN sides USING (cell, t) GROUP BY cell, t",
    gram="SELECT cell AS key, list(l ORDER BY t) AS m FROM lines GROUP BY 1",
    swept=V.sweep("gram"),
    solved="SELECT key, unnest(m) AS r, unnest(range(1, len(m) + 1)) AS t FROM swept WHERE k = len(m) + 1",
)


@query(
    "a07_time_product_dummy",
    V.with_recursive(with_views(
        """SELECT o.cell, o.period, round(CASE WHEN o.t = 0 THEN 1.0 ELSE exp(r[len(r)]) END, 6) AS index_value
FROM (SELECT DISTINCT cell, period, t FROM own) o LEFT JOIN solved s ON s.key = o.cell AND s.t = o.t""",
        "fx_panel", **TPD_STEPS,
    )),
)
def tpd(spark, d):
    levels, _ = multilateral.time_product_dummy(staged(V.panel(spark, d), "panel"), ["cell"])
    return r6(levels, "index_value")


@query(
    "a07_tpd_two_periods",
    with_views(
        """SELECT b.cell, b.period, round(exp(sum(a.share * b.share / (a.share + b.share) * ln(b.price / a.price))
  / sum(a.share * b.share / (a.share + b.share))), 6) AS index_value
FROM fx_panel a JOIN fx_panel b ON a.cell = b.cell AND a.product_id = b.product_id AND a.period = b.period - INTERVAL 1 MONTH GROUP BY ALL""",
        "fx_panel",
    ),
)
def tpd_two(spark, d):
    return r6(multilateral.tpd_two_periods(V.panel(spark, d), ["cell"], F.add_months("period", 1)), "index_value")


# cells of (route, window, flight): sparse, so several reasons occur
SPARSE = f"""SELECT route_code, advance_window, carrier_iata, query_year AS period, source_code AS product_id,
  sum(total_c) / 100.0 / count(*) AS price, 1.0 AS share
FROM (SELECT *, {V.WINDOW_SQL} AS advance_window FROM fx_quote) GROUP BY ALL"""


def sparse_panel(spark, d):
    q = V.clean(spark, d, "route_code", "advance_window", "carrier_iata", "query_year", "source_code", "total_fare")
    q = q.withColumnsRenamed({"query_year": "period", "source_code": "product_id"})
    return elementary.mean_price_panel(q, ["route_code", "advance_window", "carrier_iata", "period", "product_id"])


@query(
    "a08_panel_problems",
    with_views(
        """SELECT route_code, advance_window, carrier_iata, count(*) AS n_rows, count(DISTINCT period) AS n_periods,
  CASE WHEN count(DISTINCT period) < 2 THEN 'needs at least two periods' WHEN date_diff('day', min(period), max(period)) > 1900
    THEN 'window longer than declared' END AS skip_reason FROM sparse GROUP BY ALL""",
        "fx_quote", sparse=SPARSE,
    ),
)
def panel_problems(spark, d):
    out = multilateral.panel_problems(sparse_panel(spark, d), ["route_code", "advance_window", "carrier_iata"], 1900)
    return out.drop("weightless")


# --- elementary cells and roll-ups -----------------------------------------------------------

# (route, window, carrier type) cells, carriers as products, years as periods
CELL_PANEL = """SELECT route_code, advance_window, carrier_type, query_year AS period, carrier_iata AS product_id,
  CAST(sum(total_c) AS DOUBLE) / 100 / count(*) AS price, count(*) AS n_quotes FROM fx_clean WHERE NOT is_outlier GROUP BY ALL"""
CELL_LINKS = """SELECT a.route_code, a.advance_window, a.carrier_type, a.period AS l, b.period AS t, avg(ln(b.price / a.price)) AS x
FROM cell_panel a JOIN cell_panel b ON a.route_code = b.route_code AND a.advance_window = b.advance_window
  AND a.carrier_type IS NOT DISTINCT FROM b.carrier_type AND a.product_id = b.product_id AND a.period < b.period GROUP BY ALL"""
CELL_LEVELS = """SELECT *, exp(c - first_value(c) OVER (PARTITION BY route_code, advance_window, carrier_type ORDER BY period)) AS level FROM (
  SELECT route_code, advance_window, carrier_type, period, sum(x) / m AS c, m, count(*) AS links FROM (
    SELECT route_code, advance_window, carrier_type, t AS period, x FROM cell_links
    UNION ALL SELECT route_code, advance_window, carrier_type, l, -x FROM cell_links) u
  JOIN (SELECT route_code AS r, advance_window AS w, carrier_type AS k, count(DISTINCT period) AS m FROM cell_panel GROUP BY ALL)
    ON route_code = r AND advance_window = w AND carrier_type IS NOT DISTINCT FROM k GROUP BY route_code, advance_window, carrier_type, period, m)
QUALIFY count(*) OVER (PARTITION BY route_code, advance_window, carrier_type) = m
  AND min(links) OVER (PARTITION BY route_code, advance_window, carrier_type) = m - 1"""
CELL_OVERLAP = """SELECT route_code AS r, advance_window AS w, carrier_type AS k, CAST(coalesce(sum(q), 0) AS BIGINT) AS n_quotes,
  100.0 * CAST(count(CASE WHEN f AND e THEN 1 END) AS DOUBLE) / count(CASE WHEN f THEN 1 END) AS coverage_pct FROM (
  SELECT route_code, advance_window, carrier_type, product_id, bool_or(period = first) AS f, bool_or(period = DATE '2000-01-01') AS e,
    sum(CASE WHEN period = DATE '2000-01-01' THEN n_quotes END) AS q FROM (
    SELECT *, min(period) OVER (PARTITION BY route_code, advance_window, carrier_type) AS first FROM cell_panel)
  WHERE period = first OR period = DATE '2000-01-01' GROUP BY ALL) GROUP BY ALL"""
CELLS = """SELECT route_code, advance_window, carrier_type, level AS index_value, n_quotes, coverage_pct
FROM cell_levels JOIN cell_overlap ON route_code = r AND advance_window = w AND carrier_type IS NOT DISTINCT FROM k
WHERE period = DATE '2000-01-01'"""
CELL_STEPS = dict(cell_panel=CELL_PANEL, cell_links=CELL_LINKS, cell_levels=CELL_LEVELS, cell_overlap=CELL_OVERLAP, cells=CELLS)
CELL_KEYS = ("route_code", "advance_window", "carrier_type")


def staged_cells(spark, d):
    """Cells feeding several roll-ups: a few hundred rows, written once."""
    good, _ = elementary_cells(spark, d)
    return staged(good, "cells")


def elementary_cells(spark, d):
    q = V.clean(spark, d, *CELL_KEYS, "carrier_iata", "query_year", "total_fare", "is_outlier")
    return multilateral.elementary_cells(
        q.where(~F.col("is_outlier")), CELL_KEYS, ["carrier_iata"], "query_year", F.lit("2000-01-01").cast("date")
    )


@query(
    "a15_elementary_cells",
    with_views(
        "SELECT route_code, advance_window, carrier_type, round(index_value, 6) AS index_value, n_quotes, round(coverage_pct, 6) AS coverage_pct FROM cells",
        "fx_clean", **CELL_STEPS,
    ),
)
def cells(spark, d):
    good, _ = elementary_cells(spark, d)
    return r6(good, "index_value", "coverage_pct").drop("index_value_prior")


@query(
    "a15_skipped_cells",
    with_views(
        """SELECT route_code, advance_window, carrier_type, CASE WHEN count(DISTINCT period) < 2 THEN 'needs at least two periods'
  WHEN max(done) IS NULL THEN 'a pair of periods shares no product'
  WHEN max(CASE WHEN period = DATE '2000-01-01' THEN 1 ELSE 0 END) = 0 THEN 'no observation at the as-of period' END AS skip_reason
FROM cell_panel p LEFT JOIN (SELECT DISTINCT route_code AS r, advance_window AS w, carrier_type AS k, 1 AS done FROM cell_levels)
  ON route_code = r AND advance_window = w AND carrier_type IS NOT DISTINCT FROM k GROUP BY route_code, advance_window, carrier_type HAVING skip_reason IS NOT NULL""",
        "fx_clean", **CELL_STEPS,
    ),
)
def skipped_cells(spark, d):
    _, skips = elementary_cells(spark, d)
    return skips


ROLL = """exp(sum({w} * ln(index_value)) / sum({w})) AS index_value, CAST(sum(n_quotes) AS BIGINT) AS n_quotes,
  coalesce(sum(n_quotes * coverage_pct) / nullif(CAST(sum(n_quotes) AS DOUBLE), 0), 0) AS coverage_pct"""
BY_WINDOW = f"SELECT route_code, advance_window, {ROLL.format(w='n_quotes')} FROM cells GROUP BY ALL"
ROUTES = f"SELECT route_code, {ROLL.format(w='weight')} FROM by_window JOIN fx_window USING (advance_window) GROUP BY ALL"
NATIONAL = f"SELECT {ROLL.format(w='weight')} FROM routes JOIN fx_pax USING (route_code)"
ROLL_STEPS = {**CELL_STEPS, "by_window": BY_WINDOW, "routes": ROUTES, "national": NATIONAL}
SHOW = "round(index_value, 6) AS index_value, n_quotes, round(coverage_pct, 6) AS coverage_pct"


def by_route_window(spark, d):
    good, _ = elementary_cells(spark, d)
    return aggregate.weighted_rollup(good, ["route_code", "advance_window"], "n_quotes")


@query("a11_weighted_rollup", with_views(f"SELECT route_code, advance_window, {SHOW} FROM by_window", "fx_clean", **{**CELL_STEPS, "by_window": BY_WINDOW}))
def weighted_rollup(spark, d):
    return r6(by_route_window(spark, d), "index_value", "coverage_pct")


@query("a12_route_index", with_views(f"SELECT route_code, {SHOW} FROM routes", "fx_clean", "fx_window", **{**CELL_STEPS, "by_window": BY_WINDOW, "routes": ROUTES}))
def route_index(spark, d):
    return r6(aggregate.route_index(by_route_window(spark, d), V.booking_weights(spark)), "index_value", "coverage_pct")


@query("a13_national_index", with_views(f"SELECT {SHOW} FROM national", "fx_clean", "fx_window", "fx_pax", **ROLL_STEPS))
def national_index(spark, d):
    routes = aggregate.route_index(by_route_window(spark, d), V.booking_weights(spark))
    row, _ = aggregate.national_index(routes, V.pax_weights(spark, d))
    return r6(row, "index_value", "coverage_pct")


@query(
    "a13_excluded_routes",
    with_views(
        "SELECT DISTINCT route_code FROM routes WHERE route_code NOT IN (SELECT route_code FROM fx_pax)",
        "fx_clean", "fx_window", "fx_pax", **{**CELL_STEPS, "by_window": BY_WINDOW, "routes": ROUTES},
    ),
)
def excluded_routes(spark, d):
    routes = aggregate.route_index(by_route_window(spark, d), V.booking_weights(spark))
    _, excluded = aggregate.national_index(routes, V.pax_weights(spark, d))
    return excluded


@query("a14_sub_index", with_views(f"SELECT carrier_type, {ROLL.format(w='n_quotes')} FROM cells GROUP BY ALL".join(["SELECT carrier_type, " + SHOW + " FROM (", ")"]), "fx_clean", **CELL_STEPS))
def sub_index(spark, d):
    good, _ = elementary_cells(spark, d)
    return r6(aggregate.sub_index_by(good, "carrier_type"), "index_value", "coverage_pct")


@query(
    "a16_series_hierarchy",
    with_views(
        f"""SELECT series_code, {SHOW} FROM (
  SELECT 'PX.ROUTE.' || route_code || '.M' AS series_code, index_value, n_quotes, coverage_pct FROM routes
  UNION ALL SELECT 'PX.ALL.M', * FROM national
  UNION ALL SELECT 'PX.CARRIERTYPE.' || coalesce(carrier_type, 'UNKNOWN') || '.M', {ROLL.format(w='n_quotes')} FROM cells GROUP BY carrier_type
  UNION ALL SELECT 'PX.WINDOW.' || advance_window || '.M', {ROLL.format(w='n_quotes')} FROM cells GROUP BY advance_window)""",
        "fx_clean", "fx_window", "fx_pax", **ROLL_STEPS,
    ),
)
def series_hierarchy(spark, d):
    out = aggregate.series_hierarchy(staged_cells(spark, d), V.booking_weights(spark), V.pax_weights(spark, d))
    return r6(out, "index_value", "coverage_pct")


@query(
    "a10_combine_windows",
    with_views(
        """SELECT route_code, round(exp(sum(weight * ln(index_value)) / sum(weight)), 6) AS index_value,
  round(100.0 * sum(weight) / 1.0, 6) AS coverage_pct FROM by_window JOIN fx_window USING (advance_window) GROUP BY ALL""",
        "fx_clean", "fx_window", **{**CELL_STEPS, "by_window": BY_WINDOW},
    ),
)
def combine_windows(spark, d):
    out = aggregate.combine_windows(by_route_window(spark, d), V.booking_weights(spark), ["route_code"], 1.0)
    return r6(out, "index_value", "coverage_pct")


@query(
    "j20_weight_lookup",
    with_views(
        """SELECT route_code, weight, CASE WHEN weight IS NULL THEN 'no weight' ELSE 'weighted' END AS outcome
FROM (SELECT DISTINCT route_code FROM fx_quote) LEFT JOIN fx_pax USING (route_code)""",
        "fx_pax",
    ),
)
def weight_lookup(spark, d):
    routes = V.quotes(spark, d, "route_code").distinct()
    have, lack = aggregate.with_weight(routes, V.pax_weights(spark, d), "route_code")
    return have.withColumn("outcome", F.lit("weighted")).unionByName(
        lack.withColumn("outcome", F.lit("no weight")), allowMissingColumns=True
    )


# --- hedonic ---------------------------------------------------------------------------------


HEDONIC_STEPS = dict(
    levels="""SELECT source_code AS key, list_sort(list(DISTINCT query_year)) AS years, list_sort(list(DISTINCT carrier_iata)) AS brands FROM fx_quote GROUP BY 1""",
    xrows="""SELECT key, quote_id AS period, ln(total_c / 100.0) AS y, list_concat(list_concat([1.0::DOUBLE], list_transform(years[2:], lambda p: CASE WHEN p = query_year THEN 1.0::DOUBLE ELSE 0.0 END)),
  list_concat([advance_days::DOUBLE, stops::DOUBLE], list_transform(brands[2:], lambda b: CASE WHEN b = carrier_iata THEN 1.0::DOUBLE ELSE 0.0 END))) AS x FROM fx_quote JOIN levels ON key = source_code""",
    **V.ols_steps(),
    named="""SELECT key, list_concat(list_concat(['const'], list_transform(years[2:], lambda p: 'period_' || p)), list_concat(['advance_days', 'stops'], list_transform(brands[2:], lambda b: 'carrier_iata__' || b))) AS names,
  'period_' || years[1] AS reference FROM levels""",
)


@query(
    "a09_hedonic_time_dummy",
    V.with_recursive(with_views(
        f"""SELECT key AS source_code, names[i] AS term, CASE WHEN names[i] LIKE 'period\\_%' ESCAPE '\\' THEN 'period' ELSE 'regressor' END AS kind, round(estimate, 6) AS coefficient, round(std_error, 6) AS std_err,
  round(1 - {V.within_t("(estimate / std_error)", "t.dof")}, 6) AS p_value, CASE WHEN names[i] LIKE 'period\\_%' ESCAPE '\\' THEN round(exp(estimate), 6) END AS index_value, n_obs, NULL AS skip_reason
FROM terms t JOIN named USING (key) JOIN fits USING (key)
UNION ALL SELECT key, reference, 'reference', 0.0, NULL, NULL, 1.0, n_obs, NULL FROM named JOIN fits USING (key)""",
        "fx_quote", **HEDONIC_STEPS,
    )),
)
def hedonic_time_dummy(spark, d):
    """Per source: yearly quality-adjusted index over lead, stops and carrier."""
    q = V.quotes(spark, d, "source_code", "query_year", "total_fare", "advance_days", "stops", "carrier_iata")
    out = hedonic.hedonic_time_dummy(
        q.withColumnRenamed("query_year", "period"), ["source_code"], ["advance_days", "stops", "carrier_iata"], 0.0
    )
    return out.select("source_code", "term", "kind", *[F.round(c, 6).alias(c) for c in ("coefficient", "std_err", "p_value", "index_value")], "n_obs", "skip_reason")


# a hedonic model with dummies only and one quality level a period has a closed form: the
# difference of mean log prices
@query(
    "a09_time_dummy_only",
    with_views(
        """SELECT source_code, CAST(query_year AS VARCHAR) AS period,
  round(exp(y - first_value(y) OVER (PARTITION BY source_code ORDER BY query_year)), 6) AS index_value, n_obs FROM (
  SELECT source_code, query_year, avg(ln(total_c / 100.0)) AS y, sum(count(*)) OVER (PARTITION BY source_code) AS n_obs
  FROM fx_quote GROUP BY source_code, query_year)""",
        "fx_quote",
    ),
)
def time_dummy_only(spark, d):
    q = V.quotes(spark, d, "source_code", "query_year", "total_fare").withColumnRenamed("query_year", "period")
    out = hedonic.hedonic_time_dummy(q, ["source_code"], [], 0.0)
    return out.where(F.col("kind").isin("period", "reference")).select("source_code", "period", F.round("index_value", 6).alias("index_value"), "n_obs")
