"""How often the queries read their tables and what they move: plans, calls and results on small tables of their own."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from quotemill.catalog import ingest, load_all
from quotemill.catalog import views as V
from quotemill.functions import staging
from quotemill.operators import analytics, provenance
from quotemill.sources import drift, ledger, payloads

DAY = dt.datetime(1997, 3, 5)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    n = 40
    made = {
        "region": [(k, name) for k, name in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))],
        "nation": [(k, f"N{k}", k % 5) for k in range(25)],
        "customer": [(k, f"C{k}", k % 25, 1.0, "BUILDING") for k in range(10)],
        "supplier": [(k, f"S{k}", k % 25, 1.0) for k in range(7)],
        "part": [(k, f"P{k}", f"Brand#{11 + k % 5}", "T", 1, 9.0) for k in range(1, 13)],
        "orders": [(k, k % 11, "O", 1.0, DAY + dt.timedelta(days=31 * (k % 20)), "1-URGENT") for k in range(n)],
        "lineitem": [
            (k % (n + 2), 1 + k % 13, k % 8, 1 + k % 7, float(1 + k % 50), 1000.0 + 37 * k, 0.05, 0.02, "RNA"[k % 3], "OF"[k % 2], DAY + dt.timedelta(days=31 * (k % 20) + 40 + k % 400))
            for k in range(300)
        ],
    }
    for name, rows in made.items():
        spark.createDataFrame(rows, V.TABLES[name]).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def reads(df, table: str) -> int:
    """Scans of a table of the folder in the plan of ``df``."""
    column = {"lineitem": "l_orderkey", "orders": "o_orderkey"}[table]
    return sum(1 for line in plan(df).splitlines() if "Relation [" in line and f"[{column}#" in line)


def test_customers_meet_orders_before_lines(spark, folder):
    q = V.quotes(spark, folder, "quote_id", "route_code", "carrier_iata")
    keys = re.findall(r"Join Inner, \((\w+)#\w+ = (\w+)#", plan(q))
    lines = next(k for k, pair in enumerate(keys) if set(pair) == {"l_orderkey", "o_orderkey"})
    customers = next(k for k, pair in enumerate(keys) if set(pair) == {"o_custkey", "c_custkey"})
    assert lines < customers, keys  # the plan is printed from the top
    # lines without order, part, supplier or customer are in no quote
    known = [k for k in range(300) if k % 42 < 40 and 1 + k % 13 <= 12 and k % 8 < 7 and (k % 42) % 11 < 10]
    assert q.count() == len(known)


def test_revisions_read_the_written_values(spark, folder):
    queries = load_all().QUERIES
    assert reads(queries["j15_revision_runs"](spark, folder), "lineitem") == 0
    assert reads(queries["w02_latest_run_per_revision"](spark, folder), "lineitem") == 0
    made = V.index_values(spark, folder)
    log = lambda df: sorted(map(str, df.collect()))
    assert log(V.revisions(spark, folder, made)) == log(V.revisions(spark, folder))


@pytest.mark.parametrize("name", ["j19_screened_quotes", "j22_detection_recall", "j12_broken_chains", "j12_provenance_chain"])
def test_quotes_are_written_once(spark, folder, name):
    out = load_all().QUERIES[name](spark, folder)
    assert reads(out, "lineitem") == 0
    out.collect()


def test_round_trip_makes_its_aggregates_once(spark, folder, monkeypatch):
    frames = []
    write = ledger.write_run
    monkeypatch.setattr(ledger, "write_run", lambda given, *rest: (frames.extend(given.values()), write(given, *rest)))
    ingest.run_round_trip(spark, folder).collect()
    assert frames and not any(reads(f, "lineitem") for f in frames)


def test_ledger_batches_are_cut_from_one_table(spark, folder, monkeypatch):
    batches = []
    append = ledger.append_quotes
    monkeypatch.setattr(ledger, "append_quotes", lambda batch, *rest: (batches.append(batch), append(batch, *rest))[1])
    out = ingest.ledger_writers(spark, folder)
    assert len(batches) == 4 and not any(reads(b, "lineitem") for b in batches)
    assert {r.batches for r in out.collect()} == {2} and out.where("quotes <> keys").isEmpty()


def test_shapes_are_parsed_once(spark):
    bodies = ['{"a":1}', '{"a":1,"b":{"c":2}}', "{cut", None]
    p = spark.createDataFrame([(k, "s", b) for k, b in enumerate(bodies)], "payload_id long, source_code string, body string")
    expected = spark.createDataFrame([("s", "a"), ("s", "z"), ("t", "y")], "source_code string, key_path string")
    out = drift.shape_difference(p, expected)
    assert "parse_json" not in plan(out)
    assert {tuple(r) for r in out.collect()} == {("s", "b", "added"), ("s", "b.c", "added"), ("s", "z", "removed"), ("t", "y", "removed")}


def test_imputed_rows_without_id_are_spread(spark):
    clean = spark.range(0, 4000, numPartitions=2).select(F.when(F.col("id") < 10, F.col("id").cast("string")).alias("quote_id"), F.lit("r").alias("route_code"))
    quotes = spark.createDataFrame([(str(k), "s" if k % 2 else None) for k in range(10)] + [(None, "s")], "quote_id string, source_id string")
    sources = spark.createDataFrame([("s", "src-s")], "source_id string, source_code string")
    out = analytics.cleaned_quotes_view(clean, quotes, sources)
    assert out.columns == ["quote_id", "route_code", "source_code"]
    assert {tuple(r) for r in out.groupBy("source_code").count().collect()} == {("src-s", 5), ("imputed", 3995)}
    assert "__spread" in plan(out)


def test_chain_moves_the_narrow_rows(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    quotes = one("quote_id string, collection_run_id string, source_id string, route_code string", ("q1", "r1", "s1", "A-B"), ("q2", "r9", "s1", "A-B"), (None, "r1", "s9", "A-B"))
    clean = one("quote_id string, clean_id string, is_outlier boolean, outlier_rule string, is_imputed boolean", ("q1", "c1", False, None, False), ("q2", None, True, "mad_log", False))
    out = provenance.provenance_chain(
        quotes, one("collection_run_id string", ("r1",)), one("source_id string", ("s1",)), one("source_id string, tos_verdict string", ("s1", "ALLOWED")),
        one("route_code string, origin_iata string", ("A-B", "A")), clean, one("clean_id string, series_code string", ("c1", "x"), ("c1", "y")),
    )
    assert out.columns[:5] == ["clean_id", "quote_id", "route_code", "source_id", "collection_run_id"]
    got = {r.quote_id: (r.clean_id, r.chain_broken, r.contributions, r.tos_verdict) for r in out.collect()}
    assert got == {"q1": ("c1", None, 2, "ALLOWED"), "q2": (None, "collection_run", 0, "ALLOWED"), None: (None, "source", 0, None)}
    keys = re.findall(r"Join LeftOuter, \((\w+)#\w+ = (\w+)#", plan(out))
    assert keys[0] == ("quote_id", "quote_id"), keys


def test_ledger_days_are_written(spark, tmp_path, monkeypatch):
    labels = []
    monkeypatch.setattr(ledger, "staged", lambda df, label: (labels.append(label), staging.staged(df, label))[1])
    batch = spark.createDataFrame([("a", DAY), ("a", DAY), ("b", DAY)], "content_hash string, collected_at timestamp")
    assert ledger.append_quotes(batch, str(tmp_path / "ledger"), "one")
    assert labels == ["days"] and ledger.read_ledger(spark, str(tmp_path / "ledger")).count() == 2


def test_plain_and_crowded_card_tags_read_alike(spark):
    fields = {"brand": "SAVER", "cabin": "ECONOMY", "baseFare": "10.00", "taxes": "1.00", "convenienceFee": "2.00", "totalFare": "13.00", "seats": "4", "refundable": "true"}
    tag = '<div class="fareCard" data-carrier="X" data-flight-number="X1" data-dep-time="2024-01-01T10:00:00" data-arr-time="2024-01-01T12:00:00" data-stops="0">'
    forms = ['<span class="fareCard__{}">{}</span>', '<p  class = \'fareCard__{}\' >{}</p>', '<span title="x" class="big fareCard__{} wide" lang="en">{}</span>', '<b class="other" class="fareCard__{}">{}</b>']
    rows = [(k, "s", "r", tag + "".join(form.format(*f) for f in fields.items()) + "</div>") for k, form in enumerate(forms)]
    p = spark.createDataFrame(rows, "payload_id long, source_code string, route_code string, body string")
    got = payloads.map_cards(p).select("payload_id", "fare_brand", F.col("total_fare").cast("string"), "seats_shown", "refundable").collect()
    assert sorted(map(tuple, got)) == [(k, "SAVER", "13.00", 4, True) for k in range(len(forms))]
