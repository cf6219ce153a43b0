"""The star-schema tables seen as quotes, runs, vintages and probes, in Spark and in SQL.

Every view covers its whole tables. Each has a Spark builder and a SQL body of the same name, so a
query and its check read the same rows. Attributes the tables lack (source, route, lead, component
split, run status) are derived from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.config import ADVANCE_WINDOWS, BOOKING_WEIGHTS
from quotemill.operators.cleaning import window_code

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, body: str, *needs: str) -> None:
    SQL[name] = (needs, body)


def with_views(final: str, *names: str, **extra: str) -> str:
    """``WITH`` clause holding the named views (and what they need) and ``extra`` steps, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in SQL[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({SQL[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


# --- least squares in SQL ---------------------------------------------------------------------


def sweep(start: str) -> str:
    """Body of a recursive step: matrices (key, m) with right-hand columns, swept row by row until unit columns are left."""
    return f"""SELECT key, 1 AS k, m FROM {start} UNION ALL
SELECT key, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda z: z / r[k]) ELSE list_transform(r, lambda z, j: z - r[k] * m[k][j] / m[k][k]) END) FROM swept WHERE k <= len(m)"""


def within_t(t: str, dof: str) -> str:
    """Share of Student's t within +-t for whole degrees of freedom: a finite sum of powers of a cosine."""
    angle = f"atan(abs({t}) / sqrt({dof}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {dof} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * cos({angle}) ** (2 * j)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * cos({angle}) ** (2 * j + 1))))"
    return f"CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END"


def ols_steps(source: str = "xrows") -> dict[str, str]:
    """Steps from ``source`` (key, period, x, y; x is a list of one length per key) to ``solved`` (beta, inverse), ``residuals``, ``fits`` and ``terms``: the cross
    products beside the unit matrix are swept."""
    return {
        "cross_products": f"""SELECT key, i, j, sum(x[i] * CASE WHEN j <= len(x) THEN x[j] ELSE y END) AS v
FROM (SELECT *, unnest(range(1, len(x) + 2)) AS j FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM {source})) GROUP BY key, i, j""",
        "lines": "SELECT key, i, list(v ORDER BY j) AS l FROM cross_products GROUP BY key, i",
        "gram": "SELECT key, list(list_concat(l, list_transform(range(1, len(l)), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0 END)) ORDER BY i) AS m FROM lines GROUP BY key",
        "swept": sweep("gram"),
        "solved": "SELECT key, list_transform(m, lambda r: r[len(m) + 1]) AS beta, list_transform(m, lambda r: r[len(m) + 2:]) AS inverse FROM swept WHERE k = len(m) + 1",
        "residuals": f"""SELECT key, period, y, x, e, e - lag(e) OVER (PARTITION BY key ORDER BY period) AS step
FROM (SELECT s.*, y - list_dot_product(x, beta) AS e FROM {source} s JOIN solved USING (key))""",
        "fits": """SELECT *, 1 - ssr / sst AS r_squared, 1 - ssr / sst * (n_obs - 1) / dof AS adj_r_squared, sqrt(ssr / dof) AS residual_std_error, steps / ssr AS durbin_watson,
  exp(-n_obs / 12.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4)) AS jarque_bera_pvalue FROM (
  SELECT key, count(*) AS n_obs, count(*) - max(len(x)) AS dof, sum(e * e) AS ssr, sum(step * step) AS steps, var_pop(y) * count(*) AS sst, avg(e * e) AS m2, avg(e ** 3) AS m3, avg(e ** 4) AS m4
  FROM residuals GROUP BY key)""",
        "terms": "SELECT key, i, beta[i] AS estimate, sqrt(inverse[i][i] * ssr / dof) AS std_error, dof FROM (SELECT *, unnest(range(1, len(beta) + 1)) AS i FROM solved) JOIN fits USING (key)",
    }


def with_recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# declared schemas: no footer is read to plan a query
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{d}/{name}.parquet")


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("long")


def as_money(c: Column) -> Column:
    return (c.cast("decimal(14,2)") / F.lit(100)).cast("decimal(12,2)")


# --- dimensions -----------------------------------------------------------------------------

define("fx_place", "SELECT n_nationkey, upper(substr(r_name, 1, 3)) AS iata FROM nation JOIN region ON n_regionkey = r_regionkey")


def places(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.upper(F.substring("r_name", 1, 3)).alias("iata"))


define(
    "fx_airport",
    """SELECT upper(substr(r_name, 1, 3)) AS iata, r_name AS city, r_regionkey,
  CASE WHEN r_regionkey < 4 THEN 100 + 50 * r_regionkey END AS udf_units,
  CAST(-30 + 15 * r_regionkey AS DOUBLE) AS lat,
  CASE WHEN r_regionkey < 4 THEN CAST(-80 + 40 * r_regionkey AS DOUBLE) END AS lon FROM region""",
)


def airports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(
        F.upper(F.substring("r_name", 1, 3)).alias("iata"),
        F.col("r_name").alias("city"),
        "r_regionkey",
        F.when(k < 4, F.lit(100) + 50 * k).alias("udf_units"),
        (F.lit(-30) + 15 * k).cast("double").alias("lat"),
        F.when(k < 4, (F.lit(-80) + 40 * k).cast("double")).alias("lon"),
    )


define(
    "fx_carrier",
    """SELECT DISTINCT p_brand AS carrier_iata, CASE WHEN CAST(substr(p_brand, 7) AS INT) = 25 THEN NULL
  ELSE list_extract(['FSC', 'LCC', 'REGIONAL'], CAST(substr(p_brand, 7) AS INT) % 3 + 1) END AS carrier_type FROM part""",
)


def carriers(spark: SparkSession, d: str) -> DataFrame:
    n = F.expr("cast(substr(p_brand, 7) as int)")
    kind = F.when(n != 25, F.element_at(F.array(F.lit("FSC"), F.lit("LCC"), F.lit("REGIONAL")), n % 3 + 1))
    return table(spark, d, "part").select(F.col("p_brand").alias("carrier_iata"), kind.alias("carrier_type")).distinct()


define(
    "fx_route",
    """SELECT o.iata || '-' || t.iata AS route_code, o.iata AS origin_iata, t.iata AS dest_iata,
  make_date(1995 + o.r_regionkey, 1, 1) AS active_from,
  CASE WHEN t.r_regionkey = 4 THEN make_date(1999, 1, 1) END AS active_to
FROM fx_airport o, fx_airport t""",
    "fx_airport",
)


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Every ordered pair of the five regions: the second end is read from an array of the region
    codes, which the table itself bounds."""
    a = airports(spark, d).select("iata", "r_regionkey").withColumn("g", F.lit(1))
    ends = a.groupBy("g").agg(F.collect_list(F.struct("iata", "r_regionkey")).alias("ends"))
    j = a.join(F.broadcast(ends), "g").withColumn("t", F.explode("ends"))
    return j.select(
        F.concat_ws("-", "iata", "t.iata").alias("route_code"),
        F.col("iata").alias("origin_iata"),
        F.col("t.iata").alias("dest_iata"),
        F.make_date(F.lit(1995) + F.col("r_regionkey"), F.lit(1), F.lit(1)).alias("active_from"),
        F.when(F.col("t.r_regionkey") == 4, F.make_date(F.lit(1999), F.lit(1), F.lit(1))).alias("active_to"),
    )


_W = ", ".join(f"('{c}', {a}, {b}, {BOOKING_WEIGHTS[c]}::DOUBLE)" for c, a, b, _ in ADVANCE_WINDOWS)
define("fx_window", f"SELECT * FROM (VALUES {_W}) AS t(advance_window, lo, hi, weight)")


def booking_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BOOKING_WEIGHTS.items()), "advance_window string, weight double")


# route weights: total order value by customer region over supplier region pairs, left out for one
define(
    "fx_pax",
    """SELECT route_code, CAST(t AS DOUBLE) / 100 AS weight FROM (SELECT route_code, sum(total_c) AS t FROM fx_quote GROUP BY 1)
QUALIFY row_number() OVER (ORDER BY t, route_code) > 1""",
    "fx_quote",
)


def pax_weights(spark: SparkSession, d: str) -> DataFrame:
    g = quotes(spark, d, "route_code", "total_c").groupBy("route_code").agg(F.sum("total_c").alias("t"))
    # the smallest route has no weight yet
    least = g.agg(F.min(F.struct("t", "route_code")).alias("__least"))  # one row
    return g.crossJoin(F.broadcast(least)).where(F.struct("t", "route_code") > F.col("__least")).select("route_code", (F.col("t").cast("double") / 100).alias("weight"))


# --- quotes ---------------------------------------------------------------------------------

define(
    "fx_quote",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS quote_id,
  l_linestatus AS source_code, l_linestatus AS source_id,
  so.iata || '-' || cu.iata AS route_code, so.iata || '-' || cu.iata AS route_id, so.iata AS origin_iata, cu.iata AS dest_iata,
  p_brand AS carrier_iata,
  CASE WHEN l_partkey % 50 <> 0 THEN p_brand || '/' || (l_partkey % 4) END AS flight_number,
  CAST(o_orderdate AS DATE) AS query_date,
  CAST(((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 91) + 91) % 91 AS INT) AS advance_days,
  CAST(o_orderdate AS DATE) + CAST(((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 91) + 91) % 91 AS INT) AS travel_date,
  CAST(360 + l_linenumber * 10 + l_suppkey % 3 AS INT) AS dep_minute,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(l_linenumber AS INT)) AS collected_at,
  CAST(l_linenumber % 3 AS INT) AS stops, l_returnflag = 'R' AS refundable,
  CASE WHEN l_linestatus = 'O' THEN l_returnflag <> 'N' END AS baggage_included,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS total_c,
  CASE WHEN l_linestatus = 'O' THEN CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) // 100
    + CASE WHEN l_linenumber = 7 THEN 150 ELSE 0 END END AS taxes_c,
  CASE WHEN l_linestatus = 'O' THEN CAST(10000 AS BIGINT) END AS udf_c,
  CASE WHEN l_linenumber % 2 = 1 THEN CAST(4900 AS BIGINT) END AS fee_c,
  CASE WHEN l_linestatus = 'O' THEN CAST(round(l_extendedprice * 100) AS BIGINT)
    - CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) // 100 - 10000
    - CASE WHEN l_linenumber % 2 = 1 THEN 4900 ELSE 0 END END AS base_c,
  l_quantity AS quantity, l_extendedprice AS amount, l_returnflag AS returnflag, l_discount AS discount,
  CAST(l_shipdate AS DATE) AS ship_date, l_partkey AS partkey, l_linenumber AS linenumber, o_custkey AS custkey,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS query_month, CAST(date_trunc('year', o_orderdate) AS DATE) AS query_year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
JOIN fx_place so ON s_nationkey = so.n_nationkey JOIN fx_place cu ON c_nationkey = cu.n_nationkey""",
    "fx_place",
)

_LEAD = "cast(pmod(datediff(l_shipdate, o_orderdate), 91) as int)"
_TOTAL = "cast(round(l_extendedprice * 100) as bigint)"
_TAX = f"{_TOTAL} * cast(round(l_tax * 100) as bigint) div 100"
_QUOTE = {
    "quote_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "source_code": "l_linestatus",
    "source_id": "l_linestatus",
    "route_code": "concat(origin_iata, '-', dest_iata)",
    "route_id": "concat(origin_iata, '-', dest_iata)",
    "origin_iata": "origin_iata",
    "dest_iata": "dest_iata",
    "carrier_iata": "p_brand",
    "flight_number": "case when l_partkey % 50 <> 0 then concat(p_brand, '/', l_partkey % 4) end",
    "query_date": "cast(o_orderdate as date)",
    "advance_days": _LEAD,
    "travel_date": f"date_add(cast(o_orderdate as date), {_LEAD})",
    "dep_minute": "cast(360 + l_linenumber * 10 + l_suppkey % 3 as int)",
    "collected_at": "cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 0, l_linenumber)",
    "stops": "cast(l_linenumber % 3 as int)",
    "refundable": "l_returnflag = 'R'",
    "baggage_included": "case when l_linestatus = 'O' then l_returnflag <> 'N' end",
    "total_c": _TOTAL,
    "taxes_c": f"case when l_linestatus = 'O' then {_TAX} + case when l_linenumber = 7 then 150 else 0 end end",
    "udf_c": "case when l_linestatus = 'O' then cast(10000 as bigint) end",
    "fee_c": "case when l_linenumber % 2 = 1 then cast(4900 as bigint) end",
    "base_c": f"case when l_linestatus = 'O' then {_TOTAL} - {_TAX} - 10000 - case when l_linenumber % 2 = 1 then 4900 else 0 end end",
    "quantity": "l_quantity",
    "amount": "l_extendedprice",
    "returnflag": "l_returnflag",
    "discount": "l_discount",
    "ship_date": "cast(l_shipdate as date)",
    "partkey": "l_partkey",
    "linenumber": "l_linenumber",
    "custkey": "o_custkey",
    "query_month": "cast(trunc(o_orderdate, 'month') as date)",
    "query_year": "cast(trunc(o_orderdate, 'year') as date)",
}
_MONEY = {"total_fare": "total_c", "base_fare": "base_c", "taxes": "taxes_c", "udf": "udf_c", "convenience_fee": "fee_c"}


def quotes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Quote view with the named columns (all when none is named). Only the tables those columns
    need are joined; money columns also exist as decimals."""
    want = columns or (*_QUOTE, *_MONEY)
    exprs = [_QUOTE[_MONEY.get(c, c)] for c in want]
    routed = any("_iata" in e for e in exprs)
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    # each side takes its dimensions first, so that the customers move orders and not lines; regions are looked up by number at the end
    if any("p_brand" in e for e in exprs):
        lines = lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    if routed:
        lines = lines.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        orders = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    # both sides grow with the data: a merge join spreads the rows, also when the input is one split
    q = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    if routed:
        p = places(spark, d)
        q = q.join(p.select(F.col("n_nationkey").alias("__s"), F.col("iata").alias("origin_iata")), F.col("s_nationkey") == F.col("__s"))
        q = q.join(p.select(F.col("n_nationkey").alias("__c"), F.col("iata").alias("dest_iata")), F.col("c_nationkey") == F.col("__c"))
    out = []
    for c in want:
        e = F.expr(_QUOTE[_MONEY.get(c, c)])
        out.append((as_money(e) if c in _MONEY else e).alias(c))
    return q.select(*out)


def quotes_timed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Quote view plus the local departure timestamp."""
    need = [c for c in columns if c != "dep_datetime_local"]
    need += [c for c in ("travel_date", "dep_minute") if c not in need]
    q = quotes(spark, d, *need)
    return q.withColumn(
        "dep_datetime_local", F.expr("cast(travel_date as timestamp_ntz) + make_dt_interval(0, 0, dep_minute, 0)")
    )


WINDOW_SQL = "CASE " + " ".join(f"WHEN advance_days BETWEEN {a} AND {b} THEN '{c}'" for c, a, b, _ in ADVANCE_WINDOWS) + " END"

# cleaned rows: outlier and imputation marks from row attributes
define(
    "fx_clean",
    f"""SELECT q.*, {WINDOW_SQL} AS advance_window, discount > 0.095 AS is_outlier,
  CASE WHEN discount > 0.095 THEN 'mad_log' END AS outlier_rule, quantity = 50 AS is_imputed,
  CASE WHEN quantity = 50 AND linenumber <> 7 THEN 'cell_mean' END AS imputation_method, carrier_type
FROM fx_quote q LEFT JOIN fx_carrier USING (carrier_iata)""",
    "fx_quote",
    "fx_carrier",
)


def clean(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    marks = ("advance_window", "is_outlier", "outlier_rule", "is_imputed", "imputation_method", "carrier_type")
    need = [c for c in columns if c not in marks]
    deps = {"advance_window": ["advance_days"], "is_outlier": ["discount"], "outlier_rule": ["discount"], "is_imputed": ["quantity"],
            "imputation_method": ["quantity", "linenumber"], "carrier_type": ["carrier_iata"]}
    for m in marks:
        if m in columns:
            need += [c for c in deps[m] if c not in need]
    q = quotes(spark, d, *need)
    if "carrier_type" in columns:
        q = q.join(carriers(spark, d), "carrier_iata", "left")
    if "advance_window" in columns:
        q = q.withColumn("advance_window", window_code())
    if "is_outlier" in columns:
        q = q.withColumn("is_outlier", F.col("discount") > 0.095)
    if "outlier_rule" in columns:
        q = q.withColumn("outlier_rule", F.when(F.col("discount") > 0.095, "mad_log"))
    if "is_imputed" in columns:
        q = q.withColumn("is_imputed", F.col("quantity") == 50)
    if "imputation_method" in columns:
        q = q.withColumn("imputation_method", F.when((F.col("quantity") == 50) & (F.col("linenumber") != 7), "cell_mean"))
    return q.select(*columns)


# raw feed: holes in the dimensions and prices as text, some unusable
define(
    "fx_raw",
    """SELECT quote_id, CASE WHEN custkey % 97 <> 0 THEN route_id END AS route_id, carrier_iata,
  CASE WHEN partkey % 89 <> 0 THEN travel_date END AS travel_date, advance_days,
  CASE WHEN partkey % 31 = 0 THEN 'n/a' WHEN partkey % 37 = 0 THEN '-12.50' WHEN partkey % 41 = 0 THEN 'NaN'
    WHEN partkey % 43 = 0 THEN NULL WHEN partkey % 47 = 0 THEN '0' ELSE CAST(total_c AS VARCHAR) END AS total_fare
FROM fx_quote""",
    "fx_quote",
)


def raw_feed(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d, "quote_id", "route_id", "carrier_iata", "travel_date", "advance_days", "total_c", "custkey", "partkey")
    return q.selectExpr(
        "quote_id",
        "case when custkey % 97 <> 0 then route_id end as route_id",
        "carrier_iata",
        "case when partkey % 89 <> 0 then travel_date end as travel_date",
        "advance_days",
        """case when partkey % 31 = 0 then 'n/a' when partkey % 37 = 0 then '-12.50' when partkey % 41 = 0 then 'NaN'
           when partkey % 43 = 0 then null when partkey % 47 = 0 then '0' else cast(total_c as string) end as total_fare""",
    )


# --- collection runs ------------------------------------------------------------------------

# two attempts per (source, route, day); status from the calendar
define(
    "fx_attempt",
    """SELECT source_code, source_code AS source_id, route_code, route_code AS route_id, query_date, attempt,
  CASE (day(query_date) + 3 * attempt + month(query_date)) % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status,
  CAST(query_date AS TIMESTAMP) + to_hours(CAST(4 + 6 * attempt AS INT)) AS started_at,
  n_quotes * attempt AS quotes_collected, CASE (day(query_date) + 3 * attempt + month(query_date)) % 6 WHEN 1 THEN 1 ELSE 0 END AS blocked_count
FROM (SELECT source_code, route_code, query_date, count(*) AS n_quotes FROM fx_quote GROUP BY ALL), (VALUES (1), (2)) AS t(attempt)""",
    "fx_quote",
)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d, "source_code", "route_code", "query_date")
    g = q.groupBy("source_code", "route_code", "query_date").agg(F.count(F.lit(1)).alias("n_quotes"))
    g = g.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    k = (F.dayofmonth("query_date") + 3 * F.col("attempt") + F.month("query_date")) % 6
    status = F.when(k == 0, "FAILED").when(k == 1, "BLOCKED").when(k == 2, "PARTIAL").otherwise("SUCCEEDED")
    return g.select(
        "source_code",
        F.col("source_code").alias("source_id"),
        "route_code",
        F.col("route_code").alias("route_id"),
        "query_date",
        "attempt",
        status.alias("status"),
        (F.col("query_date").cast("timestamp") + F.make_interval(hours=F.lit(4) + 6 * F.col("attempt"))).alias("started_at"),
        (F.col("n_quotes") * F.col("attempt")).alias("quotes_collected"),
        F.when(k == 1, 1).otherwise(0).cast("long").alias("blocked_count"),
    )


# --- sampling cells at month and window grain -----------------------------------------------

_LO = "CASE " + " ".join(f"WHEN advance_days BETWEEN {a} AND {b} THEN {a}" for c, a, b, _ in ADVANCE_WINDOWS) + " END"
# the same from a list by lead: as a case the lead's expression is written out twice for each window wherever a filter is moved below it
_STARTS = ", ".join(next((str(a) for _, a, b, _ in ADVANCE_WINDOWS if a <= k <= b), "null") for k in range(1 + max(w[2] for w in ADVANCE_WINDOWS)))
WINDOW_START = f"get(array({_STARTS}), advance_days)"
define(
    "fx_observed",
    f"""SELECT DISTINCT source_id, route_id, carrier_iata,
  CASE WHEN partkey % 50 <> 0 THEN 'scheduled' END AS flight_number, CAST({_LO} AS INT) AS advance_days, query_month AS query_date,
  query_month + CAST({_LO} AS INT) AS travel_date FROM fx_quote""",
    "fx_quote",
)


def observed_cells(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d, "source_id", "route_id", "carrier_iata", "partkey", "advance_days", "query_month")
    return q.select(
        "source_id",
        "route_id",
        "carrier_iata",
        F.when(F.col("partkey") % 50 != 0, "scheduled").alias("flight_number"),
        F.expr(WINDOW_START).alias("advance_days"),
        F.col("query_month").alias("query_date"),
    ).distinct().withColumn("travel_date", F.date_add("query_date", F.col("advance_days")))


# one run per (source, route, month), newest attempt of the month's first collection day
define(
    "fx_month_run",
    """SELECT source_id, route_id, CAST(date_trunc('month', query_date) AS DATE) AS query_date, status, started_at FROM fx_attempt""",
    "fx_attempt",
)


def month_runs(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).select(
        "source_id", "route_id", F.trunc("query_date", "month").alias("query_date"), "status", "started_at"
    )


# --- published vintages ---------------------------------------------------------------------

# one run per calendar year after an order year; a vintage knows the quotes shipped before it
define(
    "fx_index_run",
    """SELECT 'run-' || y AS index_run_id, make_date(CAST(y AS INT), 1, 1) AS vintage_date,
  CAST(make_date(CAST(y AS INT), 1, 1) AS TIMESTAMP) + to_hours(6) AS computed_at,
  CASE WHEN y < 2002 THEN CAST(make_date(CAST(y AS INT), 1, 1) AS TIMESTAMP) + to_hours(30) END AS released_at
FROM (SELECT DISTINCT year(o_orderdate) + 1 AS y FROM orders)""",
)


def index_runs(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    day = F.make_date(y, F.lit(1), F.lit(1))
    return table(spark, d, "orders").select((F.year("o_orderdate") + 1).alias("y")).distinct().select(
        F.concat(F.lit("run-"), y.cast("string")).alias("index_run_id"),
        day.alias("vintage_date"),
        (day.cast("timestamp") + F.make_interval(hours=F.lit(6))).alias("computed_at"),
        F.when(y < 2002, day.cast("timestamp") + F.make_interval(hours=F.lit(30))).alias("released_at"),
    )


define(
    "fx_index_value",
    """SELECT index_run_id, series_code, period, CAST(sum(c) AS DOUBLE) / sum(n) / 10000 AS value, CAST(sum(n) AS BIGINT) AS n_quotes,
  least(100.0, CAST(sum(n) AS DOUBLE)) AS coverage_pct
FROM fx_index_run r JOIN (
  SELECT unnest(['PX.ROUTE.' || route_code || '.M', 'PX.ALL.M']) AS series_code, period, known, c, n FROM (
    SELECT route_code, query_month AS period, year(ship_date) + 1 AS known, sum(total_c) AS c, count(*) AS n FROM fx_quote GROUP BY ALL)) s
ON s.known <= year(r.vintage_date) AND s.period < r.vintage_date GROUP BY ALL""",
    "fx_index_run",
    "fx_quote",
)


def index_values(spark: SparkSession, d: str) -> DataFrame:
    """Sums per (series, month, year known) first; the few vintages are then summed over those."""
    q = quotes(spark, d, "route_code", "query_month", "ship_date", "total_c")
    code = F.array(F.concat(F.lit("PX.ROUTE."), "route_code", F.lit(".M")), F.lit("PX.ALL.M"))
    s = (
        q.groupBy("route_code", F.col("query_month").alias("period"), (F.year("ship_date") + 1).alias("known"))
        .agg(F.sum("total_c").alias("c"), F.count(F.lit(1)).alias("n"))
        .withColumn("series_code", F.explode(code))
    )
    # a vintage year list per row: known year up to the last run, kept where such a run exists
    runs = index_runs(spark, d).select("index_run_id", "vintage_date")
    last = runs.agg(F.max(F.year("vintage_date")).alias("__last"))  # one row
    first = F.greatest(F.col("known"), F.year("period") + 1)
    s = s.crossJoin(F.broadcast(last)).where(first <= F.col("__last"))
    years = F.sequence(first, F.col("__last"))
    s = s.withColumn("__y", F.explode(years)).withColumn("index_run_id", F.concat(F.lit("run-"), F.col("__y").cast("string")))
    j = s.join(runs, "index_run_id").where(F.col("period") < F.col("vintage_date"))
    return j.groupBy("index_run_id", "series_code", "period").agg(
        (F.sum("c").cast("double") / F.sum("n") / 10000).alias("value"),
        F.sum("n").alias("n_quotes"),
        F.least(F.lit(100.0), F.sum("n").cast("double")).alias("coverage_pct"),
    )


define(
    "fx_revision",
    """SELECT series_code, period, old_value, value AS new_value,
  CASE WHEN old_value IS NULL THEN 'first publication' ELSE 'later quotes' END AS reason, computed_at AS revised_at
FROM (SELECT *, lag(value) OVER (PARTITION BY series_code, period ORDER BY vintage_date) AS old_value
  FROM fx_index_value JOIN fx_index_run USING (index_run_id))
WHERE old_value IS NULL OR abs(value - old_value) > 1e-9 * greatest(1.0, abs(old_value))""",
    "fx_index_value",
)


def revisions(spark: SparkSession, d: str, values: DataFrame | None = None) -> DataFrame:
    """Revision log of ``values``, the index values of the folder where none are given."""
    from pyspark.sql import Window

    values = index_values(spark, d) if values is None else values

    w = Window.partitionBy("series_code", "period").orderBy("vintage_date")
    v = values.join(index_runs(spark, d), "index_run_id").withColumn("old_value", F.lag("value").over(w))
    moved = F.abs(F.col("value") - F.col("old_value")) > F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs("old_value"))
    return v.where(F.col("old_value").isNull() | moved).select(
        "series_code", "period", "old_value", F.col("value").alias("new_value"),
        F.when(F.col("old_value").isNull(), "first publication").otherwise("later quotes").alias("reason"),
        F.col("computed_at").alias("revised_at"),
    )


define(
    "fx_latest",
    """SELECT series_code, period, value, n_quotes, coverage_pct, index_run_id, vintage_date, computed_at, released_at FROM (
  SELECT *, row_number() OVER (PARTITION BY series_code, period ORDER BY vintage_date DESC, computed_at DESC) AS rn
  FROM fx_index_value JOIN fx_index_run USING (index_run_id) WHERE released_at IS NOT NULL) WHERE rn = 1""",
    "fx_index_value",
)

# --- panels, probes, daily fares ------------------------------------------------------------

define(
    "fx_panel",
    """SELECT returnflag AS cell, query_month AS period, carrier_iata AS product_id,
  CAST(sum(total_c) AS DOUBLE) / 100 / sum(quantity) AS price, CAST(sum(total_c) AS DOUBLE) / 100 AS share
FROM fx_quote GROUP BY ALL""",
    "fx_quote",
)


def panel(spark: SparkSession, d: str, *cells: str, period: str = "query_month") -> DataFrame:
    """Unit values per (cell, period, carrier). Sums are over exact cents and whole quantities."""
    cells = cells or ("returnflag",)
    q = quotes(spark, d, *cells, period, "carrier_iata", "total_c", "quantity")
    p = q.groupBy(*cells, F.col(period).alias("period"), F.col("carrier_iata").alias("product_id")).agg(
        (F.sum("total_c").cast("double") / 100 / F.sum("quantity")).alias("price"), (F.sum("total_c").cast("double") / 100).alias("share")
    )
    return p.withColumnRenamed("returnflag", "cell") if cells == ("returnflag",) else p


define(
    "fx_probe",
    """SELECT event_type AS source_code, 'F' || (user_id % 4) AS flight_key, CAST(date_trunc('day', ts) AS TIMESTAMP) AS probed_at,
  CAST(user_id AS VARCHAR) AS session_id, value AS total_fare, CAST(round(value * 100) AS BIGINT) AS fare_c, ts FROM events""",
)


def probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("source_code"),
        F.concat(F.lit("F"), (F.col("user_id") % 4).cast("string")).alias("flight_key"),
        F.date_trunc("day", "ts").cast("timestamp").alias("probed_at"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("value").alias("total_fare"),
        cents("value").alias("fare_c"),
        "ts",
    )


define(
    "fx_daily",
    "SELECT event_type AS route_code, CAST(ts AS DATE) AS travel_date, median(value) AS fare FROM events GROUP BY ALL",
)
