"""Splicing, publication, vintages, look-ahead guard, exports, ledger and run tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quotemill.config import CleaningOptions, IndexOptions
from quotemill.operators import gates, splice, vintages
from quotemill.plans import index_run as plan
from quotemill.sources import drift, exports, extracts, ledger, payloads

M = [dt.date(2026, m, 1) for m in range(1, 13)]


def series(spark, rows, name):
    return spark.createDataFrame([("S", M[i], float(v)) for i, v in enumerate(rows)], f"series_code string, period date, {name} double")


@pytest.mark.parametrize("method,want", [("movement", 156.0), ("window", 162.0), ("half", 151.2), ("mean", 156.0650849970), ("fbew", 162.0), ("fbmw", 162.0)])
def test_splice_golden(spark, method, want):
    w, p = series(spark, [1, 1.2, 1.5, 1.35, 1.62], "level"), series(spark, [100, 115, 140, 130], "value")
    assert splice.splice_all(w, p, (method,)).first()[method] == pytest.approx(want, abs=1e-8)


def cover(spark):
    return spark.createDataFrame([("S", 5, 80.0)], "series_code string, n_quotes long, coverage_pct double")


def test_publish_paths(spark):
    w = series(spark, [1, 1.2, 1.5], "level")
    none = series(spark, [], "value")
    v, r, s = splice.publish(w, none, cover(spark))
    assert v.first()["value"] == pytest.approx(1.5) and r.count() == 0 and s.count() == 0
    # an earlier period unpublished: bare window growth, or a skip
    v, _, _ = splice.publish(w, series(spark, [100], "value"), cover(spark))
    assert v.first()["value"] == pytest.approx(1.5)
    v, _, s = splice.publish(w, series(spark, [100], "value"), cover(spark), on_gap="skip")
    assert v.count() == 0 and s.count() == 1
    # the newest period already published: a revision only when it moves
    v, r, _ = splice.publish(w, series(spark, [100, 110, 130], "value"), cover(spark))
    assert v.first()["value"] == pytest.approx(137.5) and r.first()["old_value"] == 130
    _, r, _ = splice.publish(w, series(spark, [100, 110, 137.5], "value"), cover(spark))
    assert r.count() == 0
    _, _, s = splice.publish(w, none, cover(spark).where("n_quotes > 99"))
    assert s.first()["skip_reason"] == "no coverage entry for the series"
    with pytest.raises(ValueError):
        splice.publish(w, none, cover(spark), "nope")


def test_publication_rows_bootstrap(spark):
    cur = spark.createDataFrame([("S", 1.1, 5, 80.0)], "series_code string, index_value double, n_quotes long, coverage_pct double")
    pri = spark.createDataFrame([("S", 1.0), ("OLD", 1.0)], "series_code string, index_value double")
    out = splice.publication_rows(cur, pri, series(spark, [], "value"), F.lit("2026-03-15").cast("date"))
    got = {r["period"]: r["value"] for r in out["index_value"].collect()}
    assert got == {M[1]: 100.0, M[2]: pytest.approx(110.0)}
    assert {r["old_value"] for r in out["revision_log"].collect()} == {None} and out["revision_log"].count() == 2
    assert [r["series_code"] for r in out["skipped"].collect()] == ["OLD"]


def runs(spark):
    t = lambda d: dt.datetime(2026, d, 1, 6)
    return spark.createDataFrame(
        [("r1", dt.date(2026, 2, 1), t(2), t(2)), ("r2", dt.date(2026, 3, 1), t(3), t(3)), ("r3", dt.date(2026, 4, 1), t(4), None)],
        "index_run_id string, vintage_date date, computed_at timestamp, released_at timestamp",
    )


def values(spark):
    return spark.createDataFrame(
        [("r1", "S", M[0], 100.0, 3, 50.0), ("r2", "S", M[0], 101.0, 4, 60.0), ("r2", "S", M[1], 105.0, 4, None), ("r3", "S", M[0], 102.0, 9, 70.0)],
        "index_run_id string, series_code string, period date, value double, n_quotes long, coverage_pct double",
    )


def test_vintages(spark):
    latest = {r["period"]: r["value"] for r in vintages.latest_values(values(spark), runs(spark)).collect()}
    assert latest == {M[0]: 101.0, M[1]: 105.0}
    inside = vintages.latest_values(values(spark), runs(spark), role="internal").where(F.col("period") == M[0]).first()
    assert inside["value"] == 102.0
    asked = {(r["period"], r["as_of"]): r["value"] for r in vintages.value_as_of(values(spark), runs(spark), [dt.date(2026, 2, 1), dt.date(2026, 3, 2)]).collect()}
    assert asked == {(M[0], dt.date(2026, 2, 1)): 100.0, (M[0], dt.date(2026, 3, 2)): 101.0, (M[1], dt.date(2026, 3, 2)): 105.0}
    req = spark.createDataFrame([("S", dt.date(2026, 2, 15))], "series_code string, as_of date")
    assert [r["value"] for r in vintages.value_as_of(values(spark), runs(spark), req).collect()] == [100.0]


def test_look_ahead(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, 0),), (dt.datetime(2026, 1, 1, 0, 1),)], "collected_at timestamp")
    assert vintages.filter_as_of(df, dt.date(2026, 1, 1)).count() == 1
    with pytest.raises(vintages.LookAheadError):
        vintages.assert_no_look_ahead(df, dt.date(2026, 1, 1))
    vintages.assert_no_look_ahead(df, dt.date(2026, 1, 2))


def test_series_codes(spark):
    keys = spark.createDataFrame([("M.DEL-BOM.LCC.ALL",), ("M.ALL.LCC.AP00_03",), ("M.ALL.ALL.AP00_03",), ("M.ALL.ALL.ALL",), ("bad",)], "key string")
    got = [r[0] for r in keys.select(vintages.series_code_for_key()).collect()]
    assert got == ["PX.ROUTE.DEL-BOM.M", "PX.CARRIERTYPE.LCC.M", "PX.WINDOW.AP00_03.M", "PX.ALL.M", None]


def test_exports(spark, tmp_path):
    latest = vintages.latest_values(values(spark), runs(spark), revisions=spark.createDataFrame([("S", M[0])], "series_code string, period date"))
    rows = {r["period"]: r for r in exports.export_rows(latest).collect()}
    assert rows["2026-01-01"]["value"] == "101.000000" and rows["2026-01-01"]["status"] == "REVISED"
    assert rows["2026-02-01"]["coverage_pct"] == "" and rows["2026-02-01"]["status"] == "PUBLISHED"
    exports.write_csv(exports.export_rows(latest), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.splitlines()[0] == "series,period,value,n_quotes,coverage_pct,is_imputed,status,index_run_id,data_status"
    msg = exports.sdmx_messages(latest, ["DEL-BOM"], "AG", "Title", "2026-05-01 00:00:00")
    body = json.loads(msg.first()["message"])
    assert body["data"]["dataSets"][0]["series"]["0:0:0:0"]["observations"] == {"0": [101.0, 0, 0], "1": [105.0, 0, 1]}
    dims = body["data"]["structures"][0]["dimensions"]
    assert [d["id"] for d in dims["series"]] == ["FREQ", "ROUTE", "CARRIER_TYPE", "AP_WINDOW"] and dims["observation"][0]["values"][1]["id"] == "2026-02"
    exports.write_sdmx(msg, str(tmp_path / "sdmx"))
    assert json.loads(next((tmp_path / "sdmx").glob("series_code=S/*.txt")).read_text())["meta"]["id"] == "S"


def test_csv_extracts(spark, tmp_path):
    f = tmp_path / "fares.csv"
    f.write_text("# provenance\nroute_code,period,avg_fare\nA-B,2026-01,100.125\nA-B,2026-02,0\nA-B,2026-13,5\nZ-Z,2026-01,7\n")
    raw = extracts.read_commented_csv(spark, str(f), ["route_code", "period", "avg_fare"])
    extracts.assert_not_empty(raw, "fares")
    good, bad = extracts.parse_average_fares(raw, spark.createDataFrame([("A-B",)], "route_code string"))
    assert {str(r["avg_fare"]) for r in good.where("route_code = 'A-B'").collect()} == {"100.12"}
    assert {r["violation"] for r in bad.collect()} == {"avg_fare must be positive", "period is not YYYY-MM", "unknown route"}
    with pytest.raises(extracts.ExtractRefused):
        extracts.refuse_if_any(bad, "fares")
    empty = tmp_path / "empty.csv"
    empty.write_text("# nothing\nroute_code,period,avg_fare\n")
    with pytest.raises(extracts.ExtractRefused):
        extracts.assert_not_empty(extracts.read_commented_csv(spark, str(empty), ["route_code"]), "fares")
    with pytest.raises(ValueError):
        extracts.read_commented_csv(spark, str(f), ["nope"])


def test_checked_csv_refuses_lines_that_do_not_fit(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('# from somewhere\niata,city,lat\n"DEL","New ""Delhi"", city",28.5\n# a note\nBOM,Mumbai\nGOI,Goa,15.4,7\nMAA,,13\n')
    good, bad = extracts.read_checked_csv(spark, str(f), ["city", "iata"])
    assert sorted((r.iata, r.city) for r in good.collect()) == [("DEL", 'New "Delhi", city'), ("MAA", None)]
    assert sorted(r.line for r in bad.collect()) == ["BOM,Mumbai", "GOI,Goa,15.4,7"]
    with pytest.raises(extracts.ExtractRefused):
        extracts.refuse_if_any(bad, "airports")
    with pytest.raises(extracts.ExtractRefused, match="no column icao"):
        extracts.read_checked_csv(spark, str(f), ["icao"])


def test_rules_are_counted_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 5.0, 4.0), (3, None, 4.0)], "id int, ci_low double, ci_high double")
    path = str(tmp_path / "n")
    report = gates.write_checked(df, gates.NOWCAST_RULES, lambda rows: rows.write.parquet(path)).collect()
    assert [tuple(r) for r in report] == [("interval_ordered", 3, 1)] and spark.read.parquet(path).count() == 3
    empty = gates.write_checked(df.where("id > 9"), gates.NOWCAST_RULES, lambda rows: rows.write.parquet(path + "0")).collect()
    assert [tuple(r) for r in empty] == [("interval_ordered", 0, 0)]


def test_index_extract_keeps_repeated_periods(spark):
    raw = spark.createDataFrame([("2026-01", "101.1234565", "2012", "2026-02-12"), ("2026-01", "102", "2012", "2026-03-12"), ("2026-02", "-1", "2012", "2026-03-12"), ("2026-03", "1", "2012", "soon")],
                                "period string, value string, base_year string, release_date string")
    good, bad = extracts.parse_target_index(raw)
    assert sorted(str(r["value"]) for r in good.collect()) == ["101.123456", "102.000000"] and bad.count() == 2


def test_mappers_register_and_empty_results(spark):
    ctx = "payload_id string, source_code string, route_code string, query_date date, body string"
    day = M[0]
    df = spark.createDataFrame([("1", "s", "r", day, '<div class="noFlights"></div>'), ("2", "s", "r", day, "<p>changed</p>"), ("3", "t", "r", day, '{"x": 1}')], ctx)
    quotes = payloads.parse_payloads(df, {"s": "html_cards", "t": "nested_json"})
    assert quotes.count() == 0
    assert {r["payload_id"]: r["outcome"] for r in payloads.unparsed_payloads(df, quotes).collect()} == {"1": "empty_result", "2": "shape_mismatch", "3": "shape_mismatch"}
    payloads.register_mapper("none", lambda p: payloads.map_cards(p.limit(0)))
    assert payloads.mapper("none")(df).count() == 0
    with pytest.raises(ValueError):
        payloads.mapper("nope")


CARD = """<DIV data-carrier='6E' data-flight-number="1" class="big fareCard" data-stops="0" data-dep-time="2026-01-01T06:00:00" data-arr-time="2026-01-01T08:00:00"><div>inner</div>
<span class="fareCard__brand">A&amp;B</span><span class="fareCard__cabin">ECONOMY</span><i class="x fareCard__baseFare"> 90 </i><span class="fareCard__taxes">5</span>
<span class="fareCard__convenienceFee">5</span><span class="fareCard__totalFare">{total}</span><span class="fareCard__seats">2</span><span class="fareCard__refundable">True</span></DIV>"""


def test_a_faulty_quote_refuses_its_payload(spark):
    ctx = "payload_id string, source_code string, route_code string, query_date date, body string"
    cards = lambda *totals: "<html>" + "".join(CARD.format(total=t) for t in totals).replace("DIV", "div") + "</html>"
    fare = '{"brand":"S","cabin":"%s","baseFare":1,"taxes":1,"udf":1,%s"currency":"INR","seatsRemaining":1,"refundable":false,"baggageIncluded":true}'
    nested = lambda *fares: (
        '{"itineraries":[{"flightNumber":"1","carrier":"6E","departure":{"dateTime":"2026-01-01T06:00:00"},"arrival":{"dateTime":"2026-01-01T08:00:00"},"stops":0,"fareOptions":[%s]}]}' % ",".join(fares)
    )
    good, bare, odd = fare % ("ECONOMY", '"totalFare":3.10,'), fare % ("ECONOMY", ""), fare % ("DECK", '"totalFare":3.10,')
    df = spark.createDataFrame(
        [("1", "c", "r", M[0], cards("100", "101.50")), ("2", "c", "r", M[0], cards("100", "n/a")), ("3", "n", "r", M[0], nested(good, good)), ("4", "n", "r", M[0], nested(good, bare)),
         ("5", "n", "r", M[0], nested(odd)), ("6", "n", "r", M[0], '{"itineraries": []}'), ("7", "n", "r", M[0], None)], ctx)
    quotes = payloads.parse_payloads(df, {"c": "html_cards", "n": "nested_json"})
    got = sorted((r["payload_id"], str(r["total_fare"]), r["fare_brand"]) for r in quotes.collect())
    assert got == [("1", "100.00", "A&B"), ("1", "101.50", "A&B"), ("3", "3.10", "S"), ("3", "3.10", "S")]
    outcomes = {r["payload_id"]: r["outcome"] for r in payloads.unparsed_payloads(df, quotes).collect()}
    assert outcomes == {"2": "shape_mismatch", "4": "shape_mismatch", "5": "shape_mismatch", "6": "empty_result", "7": "shape_mismatch"}


def flat(value, prefix=""):
    """Key paths of a parsed JSON value by recursion."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for q in [f"{prefix}.{k}" if prefix else k] for p in {q} | flat(v, q)}
    return {p for v in value for p in flat(v, prefix + "[]")} if isinstance(value, list) else set()


def test_key_paths(spark):
    texts = [
        '{"a": [{"b": 1}, {"c": {"d": 2}}], "e": 1}', '[[{"x": 1}]]', '{"m": [1, {"x": {"y": [[], {"z}": "]"}]}}], "n" :{"o":[{"p":1}]}}', "{}", "[]", "3", "nope", None, '{"a": 1',
        '{"f g": {"h.i": [], "`q`": {}, "z: STRING, y": 1}, "OBJECT<": [{"VARIANT": 1}]}', '{"u\\u0041\\"": {"v": 1}, "w": ["a:", "{", {"x": "\\\\"}]}',
        '{"deep": ' + '[{"k": ' * 60 + "1" + "}]" * 60 + "}", '{"é": {"<": 1, ">": {"k": 2}}}',
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, body string")
    got = {r.k: r.paths for r in drift.payload_shapes(df, ["k"]).select("k", drift.key_paths(F.col("shape")).alias("paths")).collect()}
    for k, text in enumerate(texts):
        try:
            want = sorted(flat(json.loads(text)))
        except (TypeError, ValueError):
            want = None
        assert got[k] == want, text


def test_drift_is_judged_by_shape(spark):
    rows = [("1", "s", '{"a": 1, "b": [{"c": 2}]}'), ("2", "s", '{"a": "x", "b": [{"c": 2}, {"d": 2}]}'), ("3", "s", '{"a": 1}'), ("4", "s", "cut"), ("5", "t", '{"z": 1}'), ("6", "s", '{"b": [1, {"c": 1}], "a": 0}'), ("7", "s", None)]
    df = spark.createDataFrame(rows, "payload_id string, source_code string, body string")
    known = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b[].c")], "source_code string, key_path string")
    out = drift.drifted_payloads(df, known)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.payload_id: (r.added_paths, r.removed_paths, r.not_json) for r in out.collect()}
    assert got == {"2": (1, 0, False), "3": (0, 2, False), "4": (0, 3, True), "5": (1, 0, False), "7": (0, 3, True)}


def test_ledger_is_append_only_and_unique(spark, tmp_path):
    path = str(tmp_path / "ledger")
    t = dt.datetime(2026, 1, 1, 5)
    a = spark.createDataFrame([("h1", t, 1), ("h1", t, 1), ("h2", t, 2)], "content_hash string, collected_at timestamp, v int")
    ledger.append_quotes(a, path)
    b = spark.createDataFrame([("h1", t, 9), ("h3", dt.datetime(2026, 1, 2, 5), 3)], "content_hash string, collected_at timestamp, v int")
    ledger.append_quotes(b, path)
    got = {r["content_hash"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {"h1": 1, "h2": 2, "h3": 3} and spark.read.parquet(path).count() == 3


def run_quotes(spark):
    rows = []
    for day in range(1, 6):
        for fl in range(6):
            q = dt.date(2026, 1, day)
            travel = q + dt.timedelta(2)
            price = (1000 + 50 * fl) * (1 + 0.02 * (day - 1))
            rows.append((f"{day}-{fl}", "s", "web", dt.datetime(2026, 1, day, 4), "A-B", "A-B", "DEL", "6E" if fl < 3 else "AI", str(fl), travel, q, 2, 0, True, True,
                         None, None, None, None, round(price, 2), dt.datetime.combine(travel, dt.time(6 + fl))))
    return spark.createDataFrame(rows, "id string, source_id string, source_code string, collected_at timestamp, route_id string, route_code string, origin_iata string, carrier_iata string, flight_number string, travel_date date, query_date date, advance_days int, stops int, refundable boolean, baggage_included boolean, base_fare decimal(12,2), taxes decimal(12,2), udf decimal(12,2), convenience_fee decimal(12,2), total_fare double, dep_datetime_local timestamp_ntz").withColumn("total_fare", F.col("total_fare").cast("decimal(12,2)"))


def test_index_run_publishes_and_reproduces(spark, tmp_path):
    days = [(dt.date(2026, 1, d), dt.datetime(2026, 1, d, 4)) for d in range(1, 6)]
    inputs = plan.RunInputs(
        quotes=run_quotes(spark),
        runs=spark.createDataFrame([("s", "A-B", d, "SUCCEEDED", t) for d, t in days], "source_id string, route_id string, query_date date, status string, started_at timestamp"),
        carrier_types=spark.createDataFrame([("6E", "LCC"), ("AI", "FSC")], "carrier_iata string, carrier_type string"),
        airport_fee=spark.createDataFrame([("DEL", 100.0)], "origin_iata string, airport_udf double"),
        booking_weights=spark.createDataFrame([("AP00_03", 0.22)], "advance_window string, weight double"),
        pax_share=spark.createDataFrame([("A-B", 0.5)], "route_code string, weight double"),
        published=spark.createDataFrame([], "series_code string, period date, value double"),
        distances=spark.createDataFrame([("A-B", 500.0)], "route_id string, distance_km double"),
    )
    make = lambda: plan.index_run(inputs, dt.date(2026, 1, 5), "run-1", CleaningOptions(), IndexOptions(window_days=5))
    frames = make()
    got = {(r["series_code"], r["period"].month): r["value"] for r in frames["index_value"].collect()}
    assert got[("PX.ALL.M", 12)] == 100.0 and got[("PX.ALL.M", 1)] == pytest.approx(108.0, abs=1e-3)
    assert {k[0] for k in got} == {"PX.ALL.M", "PX.ROUTE.A-B.M", "PX.CARRIERTYPE.LCC.M", "PX.CARRIERTYPE.FSC.M", "PX.WINDOW.AP00_03.M"}
    assert frames["index_value_quote"].count() == 12 and frames["skipped_cells"].count() == 0
    stamp = frames["data_snapshot"].first()
    assert make()["data_snapshot"].first()["run_hash"] == stamp["run_hash"]
    out = str(tmp_path / "runs")
    plan.publish_run(frames, out, "run-1", dt.date(2026, 1, 5))
    assert ledger.read_run_table(spark, out, "index_value").count() == len(got)
    frames["index_value"].write.parquet(f"{out}/index_value/index_run_id=run-2")  # no manifest: not visible
    assert ledger.read_run_table(spark, out, "index_value").count() == len(got)


def test_floors(spark):
    cells = spark.createDataFrame([("a", 9, 90.0), ("b", 2, 90.0), ("c", 9, 10.0)], "route_code string, n_quotes long, coverage_pct double")
    good, thin = plan.thin_cells(cells, IndexOptions())
    assert [r[0] for r in good.collect()] == ["a"] and thin.count() == 2


def test_month_changes_over_a_gap(spark):
    """A series without May: June is compared with April; a series with May keeps it."""
    months = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(24)]
    rows = [("whole", m, 100.0 + k) for k, m in enumerate(months)] + [("gap", m, 100.0 + k) for k, m in enumerate(months) if m.month != 5]
    out = {(r.series_code, r.period): r for r in vintages.month_changes(spark.createDataFrame(rows, "series_code string, period date, value double")).collect()}
    assert len(out) == 24 + 22
    assert out["whole", dt.date(2001, 5, 1)].yoy_pct == pytest.approx(12 / 104 * 100) and out["whole", dt.date(2001, 5, 1)].mom_pct == pytest.approx(1 / 115 * 100)
    assert out["gap", dt.date(2001, 6, 1)].mom_pct == pytest.approx(2 / 115 * 100) and out["gap", dt.date(2000, 1, 1)].mom_reason == "fewer than two periods"
