"""JSON payloads: prices in every spelling, and plans whose steps are compiled and worked out once."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotemill.catalog import cleaning, ingest
from quotemill.catalog import views as V
from quotemill.functions.staging import staged
from quotemill.plans import cleaning_run
from quotemill.sources import cards, drift, payloads

CONTEXT = "payload_id string, source_code string, route_code string, query_date date, body string"
FLIGHT = '{"flightNumber":"1","carrier":"6E","departure":{"dateTime":"2026-01-01T06:00:00"},"arrival":{"dateTime":"2026-01-01T08:00:00"},"stops":0,"fareOptions":[%s]}'
FARE = '{"brand":"S","cabin":"ECONOMY","baseFare":1,"taxes":1,"udf":1,"totalFare":%s,"currency":"INR","seatsRemaining":1,"refundable":false,"baggageIncluded":true}'
#: The JVM compiles no longer method than this.
COMPILED = 8000


def _tables(spark, folder):
    """One order line per row of a small star; every kind of body occurs."""
    day = dt.datetime(1998, 3, 1)
    rows = {
        "region": [(0, "AFRICA")], "nation": [(0, "A", 0)], "customer": [(1, "c", 0, 1.0, "X")], "supplier": [(1, "s", 0, 1.0)],
        "part": [(k, "p", "Brand#%d" % (k % 5), "t", 1, 1.0) for k in range(1, 101)], "orders": [(1, 1, "O", 1.0, day, "1")],
        "lineitem": [(1, k, 1, 1 + k % 7, 1.0, 1000.25 + k, 0.01, 0.02, "R", "O", day) for k in range(1, 101)],
    }
    for name, given in rows.items():
        spark.createDataFrame(given, V.TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _plan(df, mode="formatted"):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("body", [ingest.DRIFT_BODY, ingest.EMBEDDED_BODY], ids=["drift", "embedded"])
def test_bodies_are_built_by_compiled_methods(spark, tmp_path, body):
    shapes = drift.payload_shapes(ingest.bodies(spark, _tables(spark, tmp_path), *body), ["payload_id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", _plan(shapes, "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= COMPILED


def test_changed_bodies(spark, tmp_path):
    d = _tables(spark, tmp_path)
    plain = {r["partkey"]: r["body"] for r in ingest.bodies(spark, d, ingest.NESTED_BODY).collect()}
    changed = {r["partkey"]: r["body"] for r in ingest.bodies(spark, d, *ingest.DRIFT_BODY).collect()}
    assert len(plain) == len(changed) == 100
    for k, text in plain.items():
        want = text[:60] if k % 13 == 0 else text.replace('"brand":', '"promo":1,"brand":') if k % 7 == 0 else text.replace('"taxes":', '"tax":') if k % 11 == 0 else text
        assert changed[k] == want


def test_quotes_are_cast_and_not_folded(spark):
    """Fields of a quote come from one cast of the parsed list; the body is parsed as a column, not as an expression worked out anew."""
    df = spark.createDataFrame([("1", "n", "r", None, "{}")], CONTEXT)
    plan = payloads.map_nested(df.withColumn("body", F.concat("body", F.lit(" "))))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "from_json" in plan
    assert not re.search(r"from_json\([^\n]*?concat\(", plan)


PRICES = {
    "3.10": "3.10", '"3.10"': "3.10", '" 3.10 "': "3.10", "1e2": "100.00", "0.125": "0.13", "-1.015": "-1.02", "2.675": "2.68", "9999999999.99": "9999999999.99",
    "9999999999.995": None, "99999999999": None, '"1,234.5"': None, "NaN": None, '"Infinity"': None, "null": None, "true": None, "{}": None, '""': None,
    '1,"totalFare":"x"': None, '"x","totalFare":4': "4.00",
}


def test_prices_as_numbers_and_as_text(spark):
    body = lambda *prices: '{"itineraries":[%s]}' % (FLIGHT % ",".join(FARE % p for p in prices))
    rows = [(p, "n", "r", None, body(p)) for p in PRICES] + [("both", "n", "r", None, body("3.10", '"4.2"'))]
    got = sorted((r["payload_id"], str(r["total_fare"])) for r in payloads.map_nested(spark.createDataFrame(rows, CONTEXT)).collect())
    assert got == sorted([(p, v) for p, v in PRICES.items() if v] + [("both", "3.10"), ("both", "4.20")])


def test_flights_without_fares_and_lists_with_gaps(spark):
    one = FLIGHT % (FARE % "3.10")
    lists = {"empty": '{"carrier":null,"fareOptions":[]},' + one, "none": '{"carrier":"x"},' + one, "null": "null," + one, "gap": FLIGHT % ("null," + FARE % "3.10")}
    df = spark.createDataFrame([(k, "n", "r", None, '{"itineraries":[%s]}' % v) for k, v in lists.items()], CONTEXT)
    assert [r["payload_id"] for r in payloads.map_nested(df).collect()] == ["empty"]


def test_embedded_object_ends_before_a_semicolon(spark):
    texts = {
        '<s>window.__FARE_DATA__ = {"a":{}};</s>': '{"a":{}}', '<s>window.__FARE_DATA__={"a":{"b":1}, "c":{}\n} \n ; x };': '{"a":{"b":1}, "c":{}\n}',
        'window.__FARE_DATA__ x; window.__FARE_DATA__ = {};': "{}", "window.__FARE_DATA__ = {}": "", "window.__FARE_DATA__ = " + "{}" * 50_000: "", "window.__FARE_DATA__ = " + "{}" * 50_000 + ";": "{}" * 50_000,
    }
    df = spark.createDataFrame([(k,) for k in texts], "body string")
    assert {r["body"]: r["got"] for r in df.select("body", payloads.embedded_json().alias("got")).collect()} == texts


def test_window_start_is_the_case_by_lead(spark):
    leads = spark.range(-3, 120).selectExpr("cast(id as int) as advance_days").union(spark.sql("select cast(null as int)"))
    both = leads.select(F.expr(V.WINDOW_START).alias("a"), F.expr(f"cast({V._LO} as int)").alias("b"))
    assert both.where("not (a <=> b)").count() == 0 and dict(both.dtypes)["a"] == "int"


def test_cells_of_the_cleaning_run_are_read_by_compiled_methods(spark, tmp_path, monkeypatch):
    d, sizes = _tables(spark, tmp_path), []

    def watched(df, label="stage"):
        sizes.extend(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", _plan(df, "codegen")))
        return staged(df, label)

    monkeypatch.setattr(cleaning_run, "staged", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cleaning.cleaning_run(spark, d)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= COMPILED


CARD = (
    '<div class="fareCard" data-carrier="6E" data-flight-number="7" data-dep-time="2026-01-01T06:00:00" data-arr-time="2026-01-01T08:00:00" data-stops="0">'
    '<i class="fareCard__cabin">ECONOMY</i><i class="fareCard__brand">%s</i><i class="fareCard__baseFare">1</i><i class="fareCard__taxes">1</i>'
    '<i class="fareCard__convenienceFee">1</i><i class="fareCard__totalFare"> %s </i><i class="fareCard__seats">2</i><i class="fareCard__refundable">TRUE</i></div>'
)


def test_cards_are_read_in_arrow_tasks(spark):
    """No element is read by the planner's lambdas, and context columns that nobody asks for are not carried along."""
    df = spark.createDataFrame([("1", "h", "r", None, CARD % ("S", 3))], CONTEXT)
    plan = payloads.map_cards(df).select("total_fare")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "transform(" not in plan and "split(" not in plan and re.search(r"ArrowEvalPython[^\n]*\n\W*Project \[body#\d+\]", plan)


def test_odd_cards(spark):
    bodies = {
        "plain": CARD % ("S", 3) + "<hr>" + CARD % ("F", 4),
        "decoded": CARD % ("\t&lt;b&gt; &amp;amp;&nbsp;&quot;x\x01&#39;", "5"),
        "first text": CARD % ('</i><i class="fareCard__brand">A</i><i class="fareCard__brand">B', 6),
        "first attribute": (CARD % ("S", 7)).replace('data-stops="0"', """data-stops = '1' data-stops="2" """),
        "last class": (CARD % ("S", 8)).replace('<i class="fareCard__brand"', '<i class="x" title="fareCard__cabin" class="a fareCard__brand b"'),
        "bracket in a class": (CARD % ("S", 9)).replace('"fareCard__brand"', '"> fareCard__brand"'),
        "cut": (CARD % ("S", 3))[:-80], "no cabin": (CARD % ("S", 3)).replace("ECONOMY", "HUT"), "other class": (CARD % ("S", 3)).replace('"fareCard"', '"fareCards"'),
        "one faulty": CARD % ("S", 3) + CARD % ("S", "x"), "empty": "", "none": None, "open": '<div class="fareCard" data-carrier="6E"',
    }
    df = spark.createDataFrame([(k, "h", "r", None, v) for k, v in bodies.items()], CONTEXT)
    got = sorted((r.payload_id, r.fare_brand, str(r.total_fare), r.stops, r.refundable, r.currency) for r in payloads.map_cards(df).collect())
    brand = '<b> &amp; "x\''
    assert got == sorted(
        (k, b, f"{p}.00", s, True, "INR")
        for k, b, p, s in [("plain", "S", 3, 0), ("plain", "F", 4, 0), ("decoded", brand, 5, 0), ("first text", "A", 6, 0), ("first attribute", "S", 7, 1), ("last class", "S", 8, 0), ("bracket in a class", 'fareCard__brand">S', 9, 0)]
    )


def test_bodies_do_not_move_for_outcomes(spark):
    """Outcomes by payload id, which may repeat or be null; what a body says is read before the join."""
    rows = [("1", CARD % ("S", 3)), ("1", "<html>moved</html>"), ("2", '<div class="box noFlights">'), ("3", '<div class="G-Recaptcha"></div>'), ("3", "CHALLENGES.cloudflare.com"), ("4", "x"), (None, CARD % ("S", 3)), ("5", None)]
    df = spark.createDataFrame([(k, "h", "r", None, v) for k, v in rows], CONTEXT)
    out = payloads.collection_outcomes(df, payloads.map_cards(df))
    got = sorted((str(r.collection_run_id), r.status, r.quotes_collected, r.blocked_count, str(r.challenge)) for r in out.collect())
    want = [("1", "SUCCEEDED", 1, 0), ("1", "SUCCEEDED", 1, 0), ("2", "SUCCEEDED", 0, 0), ("3", "BLOCKED", 0, 1), ("3", "BLOCKED", 0, 1), ("4", "FAILED", 0, 0), ("5", "FAILED", 0, 0), ("None", "FAILED", 0, 0)]
    assert [g[:4] for g in got] == want and [g[4] for g in got] == ["None"] * 3 + ["cloudflare_challenge", "recaptcha"] + ["None"] * 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join LeftOuter", 1)
    assert "body#" not in above and re.match(r"\W*Project \[payload_id#\d+, source_code#\d+, route_code#\d+, query_date#\d+, \(", below.splitlines()[1])


def test_every_signature_holds_a_mark():
    for name, pattern in payloads.CHALLENGES:
        for alternative in pattern.replace("\\", "").split("|"):
            assert any(m in alternative.lower() for m in payloads.CHALLENGE_MARKS), (name, alternative)


def test_outcomes_read_the_tables_once(spark, tmp_path):
    out = ingest.collection_outcomes(spark, _tables(spark, tmp_path))
    assert "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.status, r.runs, r.quotes_collected) for r in out.collect()} == {("SUCCEEDED", 91, 172), ("BLOCKED", 5, 0), ("FAILED", 4, 0)}


def test_judged_payloads_are_split_by_id_without_moving(spark):
    """The same split as by a join of ids: ids that repeat with other shapes, null ids, null sources, and lists with other ids than the drifted ones."""
    same, more, less, cut = '{"a":1,"b":[{"c":2}]}', '{"a":1,"b":[{"c":2,"d":3}]}', '{"a":1}', '{"a":'
    rows = [("1", "s", same), ("2", "s", more), ("3", "s", less), ("4", "s", cut), ("5", "s", same), ("5", "s", more), ("6", "s", more), ("6", "s", more), (None, "s", same), (None, "s", more),
            ("7", None, same), ("8", "t", same), ("9", "s", None), ("10", "s", same), ("10", "s", same), ("11", "s", "[%s,1]" % same)]
    df = spark.createDataFrame(rows, "payload_id string, source_code string, body string")
    expected = spark.createDataFrame([("s", p) for p in ("a", "b", "b[].c")], "source_code string, key_path string")
    judged = drift.judged_payloads(df, expected)
    assert judged.columns == [*df.columns, *drift.VERDICT] and judged.count() == len(rows)
    assert "parse_json" not in judged._jdf.queryExecution().optimizedPlan().toString()
    texts = lambda d: sorted(map(str, d.select(*df.columns).collect()))
    plain = drift.drifted_payloads(df, expected)
    told = drift.drifted_payloads(judged, expected)
    assert sorted(map(str, plain.collect())) == sorted(map(str, told.collect())) and plain.columns == told.columns
    for listed in (plain, plain.where("added_paths > 0"), plain.union(plain).unionByName(spark.createDataFrame([("1", "s", 0, 1, False)], plain.schema)), plain.limit(0)):
        want, got = drift.quarantine_split(df, listed), drift.quarantine_split(judged, listed)
        assert [texts(w) for w in want] == [texts(g) for g in got]
        assert sum(g.count() for g in got) == len(rows)
    plan = drift.quarantine_split(judged, told)[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_quarantined_bodies_are_built_once(spark, tmp_path):
    out = ingest.quarantine_then_parse(spark, _tables(spark, tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "to_json" not in plan and "parse_json" not in plan
    kinds = ["cut" if k % 13 == 0 else "promo" if k % 7 == 0 else "tax" if k % 11 == 0 else "same" for k in range(1, 101)]
    assert [tuple(r) for r in out.select("source_code", "set_aside", "parsed", "quotes").collect()] == [("O", 100 - kinds.count("same"), kinds.count("same"), 2 * kinds.count("same"))]


def test_cards_read_together_and_one_by_one():
    """Bodies of odd and even fragments: read a column at a time or one by one, the cards are the same."""
    pieces = [
        '<div class="fareCard"', "<div id='a' class='wide fareCard x'", ' data-carrier="6E"', " data-stops = '1'", ' data-stops="2"', ' data-x=" data-carrier="', ">", ">", "<", 'class="', '"', "'",
        '<span class="fareCard__brand">', "A", " b ", "</span>", '<i title="x" class="q fareCard__cabin">', '<p class="fareCard__seats" class="fareCard__taxes">', "\n", "\x0b", "ä", "fareCard",
        "<DIV class='fareCard'>", "<divx class='fareCard'>", '<div title="a>b" class="fareCard">', '<div class="fareCard fareCard__brand">', "&lt;", "\x01", "",
    ]
    choice = random.Random(7)
    texts = ["".join(choice.choices(pieces, k=choice.randrange(24))) for _ in range(3000)] + [None, "", CARD % ("S", 3), CARD % ("S", 3) + "<p>" + CARD % ("F", 4)]
    together, single = cards.with_cards(pa.array(texts, pa.string())), cards._one_by_one(pa.array(texts, pa.string()))
    assert together.to_pylist() == single.to_pylist() and together.type == single.type
    assert sum(len(c or ()) for c in single.to_pylist()) > 500 and cards.with_cards(pa.array([], pa.string())).to_pylist() == []
