"""Extracts, payload mappers, drift, challenges, hashes and the ledger, on bodies built from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import functions as F

from quotemill import schemas
from quotemill.catalog import views as V
from quotemill.catalog.registry import query
from quotemill.catalog.views import with_views
from quotemill.functions import hashing
from quotemill.functions.staging import scratch_path, staged
from quotemill.sources import drift, extracts, ledger, payloads


# --- dimension rows as text ------------------------------------------------------------------


@query(
    "s02_airport_rows",
    with_views("SELECT iata, city, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, NULL AS icao FROM fx_airport", "fx_airport"),
)
def airport_rows(spark, d):
    text = V.airports(spark, d).select(
        "iata", "city", F.col("lat").cast("string").alias("lat"), F.coalesce(F.col("lon").cast("string"), F.lit(" ")).alias("lon"), F.lit("").alias("icao")
    )
    t = extracts.typed(text, schemas.AIRPORT)
    return t.select("iata", "city", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "icao")


@query(
    "s20_source_rows",
    with_views("SELECT l_linestatus AS source_id, l_linestatus AS source_code, l_linestatus = 'O' AS enabled FROM lineitem GROUP BY ALL"),
)
def source_rows(spark, d):
    s = V.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("s")).distinct()
    text = s.select(F.col("s").alias("source_id"), F.col("s").alias("source_code"), (F.col("s") == "O").cast("string").alias("enabled"))
    return extracts.typed(text, schemas.SOURCE)


def _commented_csv(rows, header, faulty):
    """Write rows as a CSV a publisher might send: two provenance lines, a header, texts with commas and quotes in quotes; lines chosen by ``faulty``
    have a field too many. A dimension table: one file."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "extract")
    # a field that is null is nothing between commas, any other stands in quotes
    field = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    line = F.concat(F.concat_ws(",", *[field(c) for c in header]), F.when(faulty, F.lit(",extra")).otherwise(""))
    top = spark.createDataFrame([(0, "# source: tables"), (1, "# licence: none"), (2, ",".join(header))], "n int, value string")
    text = top.unionByName(rows.select(F.lit(3).alias("n"), line.alias("value"))).repartition(1).sortWithinPartitions("n", "value")
    text.select("value").write.text(path)
    return path


_DIMENSIONS = {
    "airport": ("iata", "city", "lat", "lon"),
    "carrier": ("iata", "carrier_type", "name"),
    "route": ("route_code", "origin_iata", "dest_iata", "active_from", "active_to"),
}


def dimension_extracts(spark, d):
    """(rows, violations) of the airport, carrier and route files."""
    airports_ = V.airports(spark, d).withColumn("faulty", F.lit(False))
    carriers_ = V.carriers(spark, d).withColumns({"iata": F.col("carrier_iata"), "name": F.concat(F.col("carrier_iata"), F.lit(', "air" # 1'))})
    routes_ = V.routes(spark, d)
    given = {
        "airport": airports_,
        "carrier": carriers_.withColumn("faulty", F.col("carrier_type").isNull()),
        "route": routes_.withColumn("faulty", F.col("origin_iata") == F.col("dest_iata")),
    }
    return {name: extracts.read_checked_csv(spark, _commented_csv(df, _DIMENSIONS[name], F.col("faulty")), _DIMENSIONS[name]) for name, df in given.items()}


@query(
    "s01_dimension_rows",
    with_views(
        """SELECT 'airport' AS kind, iata AS code, city AS name, CAST(lat AS DOUBLE) AS first, CAST(lon AS DOUBLE) AS second, NULL::DATE AS since, NULL::DATE AS until FROM fx_airport
UNION ALL SELECT 'carrier', carrier_iata, carrier_iata || ', "air" # 1 ' || carrier_type, NULL, NULL, NULL, NULL FROM fx_carrier WHERE carrier_type IS NOT NULL
UNION ALL SELECT 'route', route_code, origin_iata || dest_iata, NULL, NULL, active_from, active_to FROM fx_route WHERE origin_iata <> dest_iata""",
        "fx_airport", "fx_carrier", "fx_route",
    ),
)
def dimension_rows(spark, d):
    """Airports, carriers and routes through commented CSV files into typed rows."""
    files = dimension_extracts(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    a = extracts.typed(files["airport"][0], schemas.AIRPORT).select(
        F.lit("airport").alias("kind"), F.col("iata").alias("code"), F.col("city").alias("name"), F.col("lat").cast("double").alias("first"), F.col("lon").cast("double").alias("second"),
        none("date").alias("since"), none("date").alias("until"),
    )
    c = extracts.typed(files["carrier"][0], schemas.CARRIER).select(
        F.lit("carrier"), "iata", F.concat_ws(" ", "name", "carrier_type"), none("double"), none("double"), none("date"), none("date")
    )
    r = extracts.typed(files["route"][0], schemas.ROUTE).select(
        F.lit("route"), "route_code", F.concat("origin_iata", "dest_iata"), none("double"), none("double"), "active_from", "active_to"
    )
    return a.union(c).union(r)


@query(
    "s01_refused_lines",
    with_views(
        """SELECT 'carrier' AS kind, '"' || carrier_iata || '",,"' || carrier_iata || ', ""air"" # 1",extra' AS line FROM fx_carrier WHERE carrier_type IS NULL
UNION ALL SELECT 'route', '"' || route_code || '","' || origin_iata || '","' || dest_iata || '","' || active_from || '",' || coalesce('"' || active_to || '"', '') || ',extra' FROM fx_route WHERE origin_iata = dest_iata""",
        "fx_carrier", "fx_route",
    ),
)
def refused_lines(spark, d):
    files = dimension_extracts(spark, d)
    return reduce(lambda a, b: a.unionByName(b), [bad.select(F.lit(kind).alias("kind"), "line") for kind, (_, bad) in files.items()])


# --- traffic ---------------------------------------------------------------------------------

_CITY = {0: "Delhi", 1: " bombay", 2: "Goa (Dabolim,  South Goa)", 3: "New  Delhi", 4: "madras "}
_CITY_SQL = "CASE {k} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CITY.items()) + " ELSE n_{k} END"
_CANON = {0: "NEW DELHI", 1: "MUMBAI", 2: "VASCO DA GAMA", 3: "NEW DELHI", 4: "CHENNAI"}
_CANON_SQL = "CASE {k} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CANON.items()) + " ELSE 'NATION_' || {k} END"
TRAFFIC = """SELECT s_nationkey AS o, c_nationkey AS t, count(*) * 1000 AS pax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
TRAFFIC_READ = f"""SELECT {_CANON_SQL.format(k='o')} AS origin_city, {_CANON_SQL.format(k='t')} AS dest_city,
  CASE WHEN o = t THEN NULL WHEN t = 24 THEN -5 ELSE pax END AS passengers FROM traffic"""


def traffic_text(spark, d):
    """City-pair rows as a publisher would spell them."""
    q = (
        V.table(spark, d, "lineitem").join(V.table(spark, d, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(V.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    g = q.groupBy(F.col("s_nationkey").alias("o"), F.col("c_nationkey").alias("t")).agg((F.count(F.lit(1)) * 1000).alias("pax"))
    city = lambda k: "case {k} {w} else concat('nation_', {k}) end".format(k=k, w=" ".join(f"when {i} then '{v}'" for i, v in _CITY.items()))
    number = "case when o = t then 'n/a' when t = 24 then '-5' else format_number(pax, 0) end"
    return g.selectExpr(f"{city('o')} as origin_city", f"{city('t')} as dest_city", f"{number} as passengers")


@query("s03_traffic_pairs", with_views("SELECT * FROM r WHERE passengers >= 0", traffic=TRAFFIC, r=TRAFFIC_READ))
def traffic_pairs(spark, d):
    good, _ = extracts.parse_traffic(traffic_text(spark, d))
    return good


@query(
    "s03_traffic_violations",
    with_views(
        """SELECT *, 'passengers is not a whole number' AS violation FROM (SELECT origin_city, dest_city FROM r WHERE passengers IS NULL)
UNION ALL SELECT origin_city, dest_city, 'passengers is negative' FROM r WHERE passengers < 0
UNION ALL SELECT origin_city, dest_city, 'duplicate key' FROM r GROUP BY ALL HAVING count(*) > 1""",
        traffic=TRAFFIC, r=TRAFFIC_READ,
    ),
)
def traffic_violations(spark, d):
    _, bad = extracts.parse_traffic(traffic_text(spark, d))
    return bad


# --- average fares, target index, fuel -------------------------------------------------------

FARES = """SELECT route_code, query_month, sum(total_c) * 10 // count(*) AS m FROM fx_quote GROUP BY ALL"""
_EVEN = "(m // 10 + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END)"


def fares_text(spark, d):
    g = V.quotes(spark, d, "route_code", "query_month", "total_c").groupBy("route_code", "query_month").agg(
        F.expr("sum(total_c) * 10 div count(1)").alias("m")
    )
    return g.selectExpr(
        "route_code",
        "case when route_code = 'AFR-AFR' then date_format(query_month, 'yyyy/MM') else date_format(query_month, 'yyyy-MM') end as period",
        "case when route_code = 'ASI-ASI' then '-1' else concat(m div 1000, '.', lpad(m % 1000, 3, '0')) end as avg_fare",
    )


def known_routes(spark, d):
    return V.routes(spark, d).where(F.col("route_code") != "MID-MID").select("route_code")


@query(
    "s04_average_fares",
    with_views(f"SELECT route_code, query_month AS period, {_EVEN} / 100.0 AS avg_fare FROM fares WHERE route_code NOT IN ('AFR-AFR', 'ASI-ASI')", "fx_quote", fares=FARES),
)
def average_fares(spark, d):
    good, _ = extracts.parse_average_fares(fares_text(spark, d), known_routes(spark, d))
    return good.withColumn("avg_fare", F.col("avg_fare").cast("double"))


@query(
    "s04_fare_violations",
    with_views(
        """SELECT route_code, violation, count(*) AS n FROM (
  SELECT route_code, 'period is not YYYY-MM' AS violation FROM fares WHERE route_code = 'AFR-AFR'
  UNION ALL SELECT DISTINCT route_code, 'duplicate key' FROM fares WHERE route_code = 'AFR-AFR'
  UNION ALL SELECT route_code, 'avg_fare must be positive' FROM fares WHERE route_code = 'ASI-ASI'
  UNION ALL SELECT route_code, 'unknown route' FROM fares WHERE route_code = 'MID-MID') GROUP BY ALL""",
        "fx_quote", fares=FARES,
    ),
)
def fare_violations(spark, d):
    _, bad = extracts.parse_average_fares(fares_text(spark, d), known_routes(spark, d))
    return bad.groupBy("route_code", "violation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s05_target_index",
    with_views(
        """SELECT period, (m // 10 + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END) / 1000000.0 AS value, '2012' AS base_year,
  period + 45 AS release_date FROM (SELECT query_month AS period, sum(total_c) * 1000 // count(*) AS m FROM fx_quote GROUP BY 1)""",
        "fx_quote",
    ),
)
def target_index(spark, d):
    g = V.quotes(spark, d, "query_month", "total_c").groupBy("query_month").agg(F.expr("sum(total_c) * 1000 div count(1)").alias("m"))
    text = g.selectExpr(
        "date_format(query_month, 'yyyy-MM') as period", "concat(m div 10000000, '.', lpad(m % 10000000, 7, '0')) as value", "' 2012 ' as base_year",
        "cast(date_add(query_month, 45) as string) as release_date",
    )
    good, _ = extracts.parse_target_index(text)
    return good.withColumn("value", F.col("value").cast("double"))


@query(
    "s06_fuel_prices",
    with_views(
        """SELECT price_date, city, (m // 10 + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS price_per_kl FROM (
  SELECT CAST(ts AS DATE) AS price_date, event_type AS city, sum(CAST(round(value * 100) AS BIGINT)) * 10 // count(*) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL) WHERE m > 0""",
    ),
)
def fuel_prices(spark, d):
    e = V.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.expr("sum(cast(round(value * 100) as bigint)) * 10 div count(1)").alias("m")
    )
    text = e.selectExpr(
        "cast(day as string) as price_date", "case when event_type = 'error' then ' ' else event_type end as city",
        "concat(m div 1000, '.', lpad(m % 1000, 3, '0')) as price_per_kl",
    )
    good, _ = extracts.parse_fuel_prices(text)
    return good.withColumn("price_per_kl", F.col("price_per_kl").cast("double"))


@query(
    "a38_passenger_shares",
    with_views(
        """SELECT route_code, CAST(q + CASE WHEN r * 2 > tot OR (r * 2 = tot AND q % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100000000 AS pax_share FROM (
  SELECT route_code, (n * 100000000) // tot AS q, (n * 100000000) % tot AS r, tot FROM (
    SELECT route_code, CAST(count(*) AS HUGEINT) AS n, CAST(sum(count(*)) OVER () AS HUGEINT) AS tot FROM fx_quote GROUP BY 1))""",
        "fx_quote",
    ),
)
def passenger_shares(spark, d):
    """Shares of all routes; the total is one number read from the table."""
    from quotemill.operators.aggregate import passenger_shares as shares

    total = V.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("total_pax"))
    pairs = V.quotes(spark, d, "origin_iata", "dest_iata").groupBy("origin_iata", "dest_iata").agg(F.count(F.lit(1)).alias("passengers"))
    pairs = pairs.withColumnsRenamed({"origin_iata": "origin_city", "dest_iata": "dest_city"})
    routes = V.routes(spark, d).select("route_code", F.col("origin_iata").alias("origin_city"), F.col("dest_iata").alias("dest_city"))
    out, _ = shares(routes, pairs, total)
    return out.withColumn("pax_share", F.col("pax_share").cast("double"))


# --- payload shapes: one body per quote, two fares each ---------------------------------------

BODY_FIELDS = ("quote_id", "source_code", "route_code", "query_date", "carrier_iata", "partkey", "stops", "travel_date", "dep_minute", "total_c", "refundable")
PARSED = """SELECT carrier_iata, fare_brand, count(*) AS n, sum(t) / 100.0 AS total_fare, sum(b) / 100.0 AS base_fare, count(CASE WHEN refundable THEN 1 END) AS refundable_n,
  min(dep) AS first_dep, max(dep) AS last_dep, sum(stops) AS stops, count(DISTINCT flight) AS flights
FROM (SELECT carrier_iata, unnest(['SAVER', 'FLEXI']) AS fare_brand, unnest([total_c, total_c + 5000]) AS t, unnest([total_c - 10000, total_c - 5000]) AS b, refundable,
  CAST(travel_date AS TIMESTAMP) + to_minutes(dep_minute) AS dep, stops, 'X' || partkey AS flight FROM fx_quote WHERE partkey % 29 <> 0) GROUP BY ALL"""


def summary(quotes):
    return quotes.groupBy("carrier_iata", "fare_brand").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_fare").cast("double").alias("total_fare"),
        F.sum("base_fare").cast("double").alias("base_fare"),
        F.count_if("refundable").alias("refundable_n"),
        F.min("dep_datetime_local").alias("first_dep"),
        F.max("dep_datetime_local").alias("last_dep"),
        F.sum("stops").alias("stops"),
        F.count_distinct("flight_number").alias("flights"),
    )


_DEP = "date_format(cast(travel_date as timestamp_ntz) + make_dt_interval(0, 0, dep_minute, 0), \"yyyy-MM-dd'T'HH:mm:ss\")"
_ARR = "date_format(cast(travel_date as timestamp_ntz) + make_dt_interval(0, 2, dep_minute, 0), \"yyyy-MM-dd'T'HH:mm:ss\")"
_OPTION = """named_struct('brand', '{b}', 'cabin', 'ECONOMY', 'baseFare', cast((total_c + {x} - 10000) / 100 as decimal(12,2)), 'taxes', 0.00, 'udf', 100.00,
  'totalFare', cast((total_c + {x}) / 100 as decimal(12,2)), 'currency', 'INR', 'seatsRemaining', stops + 1, 'refundable', refundable, 'baggageIncluded', true)"""
NESTED_BODY = f"""to_json(named_struct('searchId', quote_id, 'itineraries', array(named_struct('flightNumber', concat('X', partkey), 'carrier', carrier_iata,
  'departure', named_struct('airport', 'AAA', 'dateTime', {_DEP}), 'arrival', named_struct('airport', 'BBB', 'dateTime', {_ARR}), 'stops', stops,
  'fareOptions', array({_OPTION.format(b='SAVER', x=0)}, {_OPTION.format(b='FLEXI', x=5000)})))))"""
_FARE = """named_struct('fare_type', '{b}', 'class_of_service', 'ECONOMY', 'fare_breakup', named_struct('base', cast((total_c + {x} - 10000) / 100 as decimal(12,2)), 'tax', 0.00,
  'udf', 100.00), 'total', cast((total_c + {x}) / 100 as decimal(12,2)), 'currency_code', 'INR', 'seats_left', 4, 'is_refundable', refundable, 'free_baggage', true)"""
_EMBEDDED = f"""to_json(named_struct('flights', array(named_struct('flight_no', concat('X', partkey), 'airline_code', carrier_iata,
  'dep', named_struct('iata', 'AAA', 'local_time', {_DEP}), 'arr', named_struct('iata', 'BBB', 'local_time', {_ARR}), 'num_stops', stops,
  'fares', array({_FARE.format(b='SAVER', x=0)}, {_FARE.format(b='FLEXI', x=5000)})))))"""
# one statement each, over the body as the one before left it: an expression written out once per case makes a method too long to be compiled
EMBEDDED_BODY = (_EMBEDDED, """case when partkey % 2 = 0 then body else concat('<html><body>\\n<script>\\nwindow.__FARE_DATA__ = ', body, ';\\n</script></body></html>') end""")
_CARD = """concat('<div class="fareCard"\\n data-flight-number="X', partkey, '" data-carrier="', carrier_iata, '" data-stops="', stops, '"\\n data-dep-time="', {dep},
  '" data-arr-time="', {arr}, '">\\n <span class="fareCard__brand">{b}</span><span class="fareCard__cabin">ECONOMY</span><span class="fareCard__baseFare">',
  cast((total_c + {x} - 10000) / 100 as decimal(12,2)), '</span><span class="fareCard__taxes">0.00</span><span class="fareCard__convenienceFee"> 49.00 </span><span class="fareCard__totalFare">',
  cast((total_c + {x}) / 100 as decimal(12,2)), '</span><span class="fareCard__seats">6</span>\\n<span class="fareCard__refundable">', refundable, '</span></div>')"""
CARDS_BODY = "concat('<html><body><div class=\"searchResults\">', {a}, '\\n', {b}, '</div></body></html>')".format(
    a=_CARD.format(dep=_DEP, arr=_ARR, b="SAVER", x=0), b=_CARD.format(dep=_DEP, arr=_ARR, b="FLEXI", x=5000)
)


def body_fields(spark, d):
    """What bodies are built from, written once for the queries that read bodies twice: the tables are not joined again."""
    return staged(V.quotes(spark, d, *BODY_FIELDS), "fields", compression="zstd")


def bodies(spark, d, body: str, *changes: str, fields=None):
    """One body per quote, or per row of ``fields``; ``changes`` are made to it in order."""
    q = (V.quotes(spark, d, *BODY_FIELDS) if fields is None else fields).selectExpr("quote_id as payload_id", "source_code", "route_code", "query_date", "partkey", f"{body} as body")
    return reduce(lambda p, change: p.withColumn("body", F.expr(change)), changes, q)


def _shape(name: str, mapper: str, *body: str):
    @query(name, with_views(PARSED, "fx_quote"))
    def run(spark, d):
        return summary(payloads.mapper(mapper)(bodies(spark, d, *body)))

    return run


def _faulty(field: str) -> str:
    """The second fare of some bodies lacks its price; such a payload is refused whole."""
    return f"case when partkey % 29 = 0 then regexp_replace(body, '(?s){field}(?!.*{field})', '\"gone') else body end"


# some cards carry a further class and other attributes first, and wrap an element around another
_CARDS_VARIED = """case when partkey % 3 = 0 then replace(replace(body, '<div class="fareCard"', "<div id='a' class='wide fareCard'"),
  '<span class="fareCard__brand">', '<div><b>fare</b></div><span title="x" class="fareCard__brand big">') else body end"""

_shape("s07_nested_json", "nested_json", NESTED_BODY, _faulty('"totalFare'))
_shape("s08_embedded_json", "embedded_json", *EMBEDDED_BODY, _faulty('"total'))
_shape("s09_html_cards", "html_cards", CARDS_BODY, _CARDS_VARIED, _faulty('"fareCard__totalFare'))

# some bodies gain a key, some lose one, some are cut off
DRIFT_BODY = (
    NESTED_BODY,
    """case when partkey % 13 = 0 then substring(body, 1, 60) when partkey % 7 = 0 then replace(body, '"brand":', '"promo":1,"brand":')
  when partkey % 11 = 0 then replace(body, '"taxes":', '"tax":') else body end""",
)
KNOWN_PATHS = (
    "searchId", "itineraries", "itineraries[].flightNumber", "itineraries[].carrier", "itineraries[].departure", "itineraries[].departure.airport",
    "itineraries[].departure.dateTime", "itineraries[].arrival", "itineraries[].arrival.airport", "itineraries[].arrival.dateTime", "itineraries[].stops",
    "itineraries[].fareOptions", *[f"itineraries[].fareOptions[].{k}" for k in (
        "brand", "cabin", "baseFare", "taxes", "udf", "totalFare", "currency", "seatsRemaining", "refundable", "baggageIncluded")],
)
_KIND = "CASE WHEN partkey % 13 = 0 THEN 'cut' WHEN partkey % 7 = 0 THEN 'promo' WHEN partkey % 11 = 0 THEN 'tax' ELSE 'same' END"


def expected_paths(spark, d):
    """Known paths for every source present in the tables."""
    paths = F.explode(F.array(*[F.lit(p) for p in KNOWN_PATHS])).alias("key_path")
    return V.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("source_code")).distinct().select("source_code", paths)


@query(
    "s10_drifted_payloads",
    with_views(
        f"""SELECT quote_id AS payload_id, source_code, CASE k WHEN 'cut' THEN 0 ELSE 1 END AS added_paths,
  CASE k WHEN 'cut' THEN {len(KNOWN_PATHS)} WHEN 'promo' THEN 0 ELSE 1 END AS removed_paths, k = 'cut' AS not_json
FROM (SELECT quote_id, source_code, {_KIND} AS k FROM fx_quote) WHERE k <> 'same'""",
        "fx_quote",
    ),
)
def drifted_payloads(spark, d):
    p = bodies(spark, d, *DRIFT_BODY)
    return drift.drifted_payloads(p, expected_paths(spark, d))


@query(
    "s10_quarantine_then_parse",
    with_views(
        f"""SELECT source_code, count(*) FILTER (k <> 'same') AS set_aside, count(*) FILTER (k = 'same') AS parsed, 2 * count(*) FILTER (k = 'same') AS quotes
FROM (SELECT source_code, {_KIND} AS k FROM fx_quote) GROUP BY 1""",
        "fx_quote",
    ),
)
def quarantine_then_parse(spark, d):
    """Drifted payloads are set aside, the others parsed."""
    expected = expected_paths(spark, d)
    p = drift.judged_payloads(bodies(spark, d, *DRIFT_BODY).drop("partkey"), expected)
    good, aside = drift.quarantine_split(p, drift.drifted_payloads(p, expected))
    quotes = payloads.map_nested(good).groupBy("source_code").agg(F.count_distinct("payload_id").alias("parsed"), F.count(F.lit(1)).alias("quotes"))
    return aside.groupBy("source_code").agg(F.count(F.lit(1)).alias("set_aside")).join(quotes, "source_code")


@query(
    "s10_shape_difference",
    with_views(
        f"""SELECT DISTINCT source_code, unnest(CASE k WHEN 'promo' THEN ['itineraries[].fareOptions[].promo'] ELSE ['itineraries[].fareOptions[].tax'] END) AS key_path, 'added' AS change
FROM (SELECT source_code, {_KIND} AS k FROM fx_quote) WHERE k IN ('promo', 'tax')""",
        "fx_quote",
    ),
)
def shape_difference(spark, d):
    p = bodies(spark, d, *DRIFT_BODY)
    return drift.shape_difference(p, expected_paths(spark, d))


@query(
    "s11_quote_validation",
    with_views(
        """SELECT carrier_iata, count(CASE WHEN total_c >= 200000 AND stops * 3 BETWEEN 0 AND 4 AND linenumber <> 3 THEN 1 END) AS valid_n, count(*) AS n FROM fx_quote GROUP BY 1""",
        "fx_quote",
    ),
)
def quote_validation(spark, d):
    from quotemill.operators.gates import quote_shape_ok

    q = V.quotes(spark, d, "carrier_iata", "total_c", "stops", "linenumber").select(
        "carrier_iata", (F.col("total_c") - 200000).alias("total_fare"), (F.col("stops") * 3).alias("stops"),
        F.when(F.col("linenumber") == 3, "RUPEE").otherwise("INR").alias("currency"),
    )
    return q.groupBy("carrier_iata").agg(F.count_if(quote_shape_ok()).alias("valid_n"), F.count(F.lit(1)).alias("n"))


# --- scans -----------------------------------------------------------------------------------


@query(
    "s12_window_scan",
    with_views("SELECT quote_id, route_code, query_date, total_c / 100.0 AS total_fare FROM fx_quote WHERE query_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-21'", "fx_quote"),
)
def window_scan(spark, d):
    q = V.quotes(spark, d, "quote_id", "route_code", "query_date", "total_fare")
    out = ledger.scan_window(q, F.lit("1998-01-01").cast("date"), F.lit("1998-01-21").cast("date"))
    return out.withColumn("total_fare", F.col("total_fare").cast("double"))


@query(
    "s13_run_scan",
    with_views("SELECT source_code, route_code, attempt, status, CAST(started_at AS DATE) AS query_date FROM fx_attempt WHERE started_at >= '1998-03-01' AND started_at < '1998-04-01'", "fx_attempt"),
)
def run_scan(spark, d):
    out = ledger.scan_runs(V.attempts(spark, d).drop("query_date"), "1998-03-01", "1998-04-01")
    return out.select("source_code", "route_code", "attempt", "status", "query_date")


# --- challenges ------------------------------------------------------------------------------

_MARKS = {
    1: '<script src="https://www.google.com/recaptcha/api.js"></script>', 2: '<div class="h-captcha"></div>', 3: "<p>Checking your browser before accessing</p>",
    4: "<img src=/akam/13/pixel>", 5: "<i>PX-CAPTCHA</i>", 6: "<a href=//geo.captcha-delivery.com>x</a>", 7: "<title>One captcha page</title>",
}
_BODY_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {k} THEN html || '{v}'" for k, v in _MARKS.items()) + " ELSE html END"


def _re(p: str) -> str:
    return p.replace("'", "''")


CHALLENGE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(body, '(?i){_re(p)}') THEN '{n}'" for n, p in payloads.CHALLENGES) + " END"


@query("s14_challenge_pages", f"SELECT page_id, {CHALLENGE_SQL} AS challenge FROM (SELECT page_id, {_BODY_SQL} AS body FROM pages)")
def challenge_pages(spark, d):
    marks = "case page_id % 9 " + " ".join(f"when {k} then concat(html, '{v}')" for k, v in _MARKS.items()) + " else html end"
    p = V.table(spark, d, "pages").selectExpr("page_id", f"{marks} as body")
    return payloads.classify_pages(p, "body", ["page_id"])


# --- outcomes and ledger ---------------------------------------------------------------------

OUTCOME_BODY = (
    CARDS_BODY,
    """case when partkey % 17 = 0 then '<html><div class="box noFlights">none</div></html>' when partkey % 19 = 0 then '<html><div class="g-recaptcha"></div></html>'
  when partkey % 23 = 0 then '<html>moved</html>' else body end""",
)


@query(
    "s16_collection_outcomes",
    with_views(
        """SELECT source_code, status, count(*) AS runs, sum(n) AS quotes_collected, sum(CASE WHEN status = 'BLOCKED' THEN 1 ELSE 0 END) AS blocked_count FROM (
  SELECT source_code, CASE WHEN partkey % 17 = 0 THEN 'SUCCEEDED' WHEN partkey % 19 = 0 THEN 'BLOCKED' WHEN partkey % 23 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
    CASE WHEN partkey % 17 = 0 OR partkey % 19 = 0 OR partkey % 23 = 0 THEN 0 ELSE 2 END AS n FROM fx_quote) GROUP BY ALL""",
        "fx_quote",
    ),
)
def collection_outcomes(spark, d):
    p = bodies(spark, d, *OUTCOME_BODY, fields=body_fields(spark, d)).drop("partkey")
    out = payloads.collection_outcomes(p, payloads.map_cards(p))
    return out.groupBy("source_code", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("quotes_collected").alias("quotes_collected"), F.sum("blocked_count").alias("blocked_count")
    )


@query(
    "s15_ledger_append",
    with_views("SELECT year(query_date) AS y, count(*) AS new_quotes FROM (SELECT DISTINCT quote_id, query_date FROM fx_quote) WHERE query_date >= DATE '1999-01-01' GROUP BY 1", "fx_quote"),
)
def ledger_append(spark, d):
    """Everything is sent again, twice; only days not in the ledger yet come through, once."""
    q = V.quotes(spark, d, "quote_id", "collected_at", "query_date").withColumn("content_hash", hashing.sha256_text(F.col("quote_id")))
    held = q.where(F.col("query_date") < F.lit("1999-01-01").cast("date"))
    sent = q.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return ledger.new_quotes(sent, held).groupBy(F.year("query_date").alias("y")).agg(F.count(F.lit(1)).alias("new_quotes"))


@query(
    "s15_ledger_writers",
    with_views(
        "SELECT query_month AS month, count(*) AS quotes, count(*) AS keys, 2 AS batches FROM (SELECT DISTINCT quote_id, query_month FROM fx_quote) GROUP BY 1",
        "fx_quote",
    ),
)
def ledger_writers(spark, d):
    """A batch is appended, and sent once more under its name. Then two writers at once append what is in no or one batch so far; both send every row twice, and
    months overlap. Each key is in the ledger once."""
    # three batches are cut from it; ids take less room than their hashes, and a task that reads few files holds few keys
    ids = staged(V.quotes(spark, d, "quote_id", "query_month"), "quotes", compression="zstd", maxRecordsPerFile=250_000)
    q = ids.select("query_month", F.col("query_month").cast("timestamp").alias("collected_at"), hashing.sha256_text(F.col("quote_id")).alias("content_hash"))
    odd = F.month("query_month") % 2 == 1
    path = scratch_path(spark, "ledger")
    again = [ledger.append_quotes(q.where(odd), path, "first") for _ in range(2)]
    twice = q.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    at_once = [InheritableThread(target=ledger.append_quotes, args=(twice, path, name)) for name in ("second", "third")]
    for t in at_once:
        t.start()
    for t in at_once:
        t.join()
    out = hashing.rows_and_distinct(ledger.read_ledger(spark, path).withColumnRenamed("query_month", "month"), "month", "content_hash", "quotes", "keys")
    return out.withColumn("batches", F.lit(1 + again.count(True)))


@query(
    "s17_run_round_trip",
    with_views(
        """SELECT 'index_value' AS table_name, series_code AS name, index_run_id AS run, count(*) AS n, sum(n_quotes) AS total FROM fx_index_value GROUP BY ALL
UNION ALL SELECT 'revision_log', series_code, reason, count(*), count(old_value) FROM fx_revision GROUP BY ALL
UNION ALL SELECT 'skipped_cells', route_code, status, count(*), count(DISTINCT query_date) FROM fx_attempt WHERE status <> 'SUCCEEDED' GROUP BY ALL""",
        "fx_index_value", "fx_revision", "fx_attempt",
    ),
)
def run_round_trip(spark, d):
    """A run's tables are written, written again with other rows, and fail twice between two tables, once under a name of their own. Values, log and skips
    read back are those of the second time."""
    # aggregates that all four runs read
    made = staged(V.index_values(spark, d), "values")
    skipped = staged(V.attempts(spark, d).where(F.col("status") != "SUCCEEDED"), "skipped")
    values = made.withColumnRenamed("index_run_id", "run")
    frames = {"index_value": values, "revision_log": V.revisions(spark, d, made), "skipped_cells": skipped}
    out = scratch_path(spark, "runs")
    ledger.write_run({name: df.limit(7) for name, df in frames.items()}, out, "run", {"turn": 1})
    ledger.write_run(frames, out, "run", {"turn": 2})
    lost = {"index_value": values.limit(3), "revision_log": frames["revision_log"].withColumn("reason", F.raise_error(F.lit("lost job")).cast("string"))}
    for name in ("run", "other"):
        try:
            ledger.write_run(lost, out, name, {"turn": 3})
        except Exception as exc:
            if "lost job" not in str(exc):
                raise
    read = lambda name: ledger.read_run_table(spark, out, name).where(F.col("index_run_id") == "run")
    count = F.count(F.lit(1)).alias("n")
    return (
        read("index_value").groupBy(F.lit("index_value").alias("table_name"), F.col("series_code").alias("name"), "run").agg(count, F.sum("n_quotes").alias("total"))
        .unionByName(read("revision_log").groupBy(F.lit("revision_log").alias("table_name"), F.col("series_code").alias("name"), F.col("reason").alias("run")).agg(count, F.count("old_value").alias("total")))
        .unionByName(read("skipped_cells").groupBy(F.lit("skipped_cells").alias("table_name"), F.col("route_code").alias("name"), F.col("status").alias("run")).agg(count, F.count_distinct("query_date").alias("total")))
    )


# --- hashes and URLs -------------------------------------------------------------------------

_M = lambda c: f"coalesce('\"' || ({c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0') || '\"', 'null')"
CANONICAL = (
    "'{\"base_fare\":' || " + _M("base_c") + " || ',\"carrier_iata\":\"' || carrier_iata || '\",\"convenience_fee\":' || " + _M("fee_c")
    + " || ',\"fare_brand\":\"' || returnflag || '\",\"fare_class\":\"ECONOMY\",\"flight_number\":' || coalesce('\"' || flight_number || '\"', 'null')"
    + " || ',\"query_date\":\"' || query_date || '\",\"route_code\":\"' || route_code || '\",\"source_code\":\"' || source_code || '\",\"taxes\":' || " + _M("taxes_c")
    + " || ',\"total_fare\":' || " + _M("total_c") + " || ',\"travel_date\":\"' || travel_date || '\",\"udf\":' || " + _M("udf_c") + " || '}'"
)


@query("p16_content_hash", with_views(f"SELECT quote_id, sha256({CANONICAL}) AS content_hash FROM fx_quote", "fx_quote"))
def content_hash(spark, d):
    q = V.quotes(
        spark, d, "quote_id", "base_fare", "carrier_iata", "convenience_fee", "returnflag", "flight_number", "query_date", "route_code", "source_code", "taxes",
        "total_fare", "travel_date", "udf",
    ).withColumnRenamed("returnflag", "fare_brand").withColumn("fare_class", F.lit("ECONOMY"))
    # the checking SQL writes the slash of a flight number unescaped, as the JSON writer here does
    return q.select("quote_id", hashing.quote_content_hash().alias("content_hash"))


CANON_URL = r"""lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]+)', 1)) ||
  CASE WHEN regexp_extract(url, '://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]+([^?#]*)', 1) END ||
  '?' || array_to_string(list_sort(list_append(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> ''), 'z=~%2A+%7C%25zz')), '&')"""


@query("p17_url_hash", f"SELECT page_id, {CANON_URL} AS url, sha256({CANON_URL}) AS url_hash FROM pages")
def url_hash(spark, d):
    """Every page URL in a rougher spelling: upper-case scheme and host, explicit default port,
    a fragment, a parameter with escapes. All spellings of a page share one hash."""
    p = V.table(spark, d, "pages").selectExpr(
        "page_id",
        """concat(upper(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)), case when url like 'https%' then ':443' else ':80' end,
           regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1), case when url like '%?%' then '&' else '?' end, 'z=%7e*%20|%zz#frag') as url""",
    )
    u = F.col("url")
    return p.select("page_id", hashing.normalise_url(u).alias("url"), hashing.url_hash(u).alias("url_hash"))


@query(
    "p16_content_keys",
    with_views("SELECT quote_id, 'sha256/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS key FROM (SELECT quote_id, sha256(quote_id || ':' || total_c) AS h FROM fx_quote)", "fx_quote"),
)
def content_keys(spark, d):
    """Where the body of each quote is stored."""
    digest = hashing.sha256_text(F.concat_ws(":", "quote_id", "total_c"))
    return V.quotes(spark, d, "quote_id", "total_c").select("quote_id", hashing.content_key(digest).alias("key"))


@query(
    "a32_snapshot_hash",
    with_views(
        """SELECT route_code, row_count, sha256(row_count || '|' || l0 || '|' || l1 || '|' || l2 || '|' || l3 || '|' || l4 || '|' || l5 || '|' || l6 || '|' || l7) AS content_hash
FROM (SELECT route_code, count(*) AS row_count, """
        + ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS l{i}" for i in range(8))
        + """ FROM (SELECT route_code, sha256(quote_id || ':' || total_c) AS h FROM fx_quote) GROUP BY 1)""",
        "fx_quote",
    ),
)
def snapshot_hash(spark, d):
    q = V.quotes(spark, d, "quote_id", "route_code", "total_c")
    return hashing.rows_hash(q, F.concat_ws(":", "quote_id", "total_c"), ["route_code"])


@query("a39_runs_per_day", with_views("SELECT source_code, query_date, count(*) AS quotes_collected FROM fx_quote GROUP BY ALL", "fx_quote"))
def runs_per_day(spark, d):
    from quotemill.operators.analytics import runs_per_day as per_day

    return per_day(V.quotes(spark, d, "source_code", "query_date"))
