"""Cleaning stages: edge cases, brute-force agreement, the composed run."""

import datetime as dt
import statistics
import uuid
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.config import CleaningOptions, GateOptions
from quotemill.functions import hashing, quantiles
from quotemill.functions.staging import staged
from quotemill.operators import cleaning, gates, missing
from quotemill.plans.cleaning_run import clean_quotes


def test_quarantine_reasons(spark):
    rows = [("a", "r", "10.0"), ("b", None, "-1"), ("c", "r", "x"), ("d", "r", "NaN"), ("e", "r", "Infinity"), ("f", "r", None), ("g", "r", "0"), ("h", "r", "-Infinity")]
    df = spark.createDataFrame(rows, "id string, route_id string, total_fare string")
    kept, bad = cleaning.quarantine_malformed(df, ["route_id"])
    assert [r["id"] for r in kept.collect()] == ["a"]
    got = {r["id"]: r["quarantine_reason"] for r in bad.collect()}
    assert got.pop("b") == "missing_identity_dimension"
    assert set(got.values()) == {"invalid_total_fare"} and len(got) == 6
    with pytest.raises(ValueError):
        cleaning.quarantine_malformed(df, ["nope"])


@pytest.mark.parametrize("seed", [0, 1])
def test_quantiles_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    # one hot group, negative and repeated values, a null key, single-row groups
    rows = [("hot" if rng.uniform() < 0.6 else rng.choice(["a", "b", None]), float(np.round(rng.normal(0, 50), 1))) for _ in range(400)] + [("lone", 3.0), ("pair", -1.0), ("pair", 2.0)]
    rows = [(None if k is None else str(k), v) for k, v in rows]
    df = spark.createDataFrame(rows, "k string, x double")
    counts = quantiles.value_counts(df, ["k"], "x")
    qs = {"a": 0.25, "m": 0.5, "z": 0.9}
    got = {r["k"]: r for r in quantiles.quantiles_of_counts(counts, ["k"], qs).collect()}
    for k in {r[0] for r in rows}:
        xs = [v for kk, v in rows if kk == k]
        assert got[k]["n_values"] == len(xs)
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(float(np.quantile(xs, q)), abs=1e-9), (k, name)


def test_quantiles_of_a_million_small_values(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("(id * 7919 % 1000000) / 1e8 as x")
    got = quantiles.grouped_quantiles(df, [], "x", {"a": 0.25, "m": 0.5}).first()
    assert got["n_values"] == n and [got["a"], got["m"]] == pytest.approx([0.25 * (n - 1) / 1e8, 0.5 * (n - 1) / 1e8], abs=1e-15)
    widest = df.where("x > 0").groupBy(quantiles.value_bucket(F.col("x")).alias("b")).count().agg(F.max("count")).first()[0]
    assert widest < 0.02 * n


def test_prices_with_type_suffixes_are_refused(spark):
    rows = [(p,) for p in ("12d", "1f", "12", " 1.5e2 ", "-3", ".5")]
    df = spark.createDataFrame(rows, "total_fare string")
    kept, _ = cleaning.quarantine_malformed(df, [])
    assert {r[0] for r in kept.collect()} == {"12", " 1.5e2 ", ".5"}


def brute_flags(prices):
    x = np.log(prices)
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    q1, q3 = np.quantile(x, [0.25, 0.75])
    z = 0.6745 * (x - med) / mad if mad > 0 else np.zeros(len(x))
    big = len(prices) >= 5
    return [big and abs(a) > 3.5 for a in z], [big and (a < q1 - 1.5 * (q3 - q1) or a > q3 + 1.5 * (q3 - q1)) for a in x]


def test_outliers(spark):
    rng = np.random.default_rng(3)
    cells = {"a": list(rng.lognormal(5, 0.1, 40)) + [900.0, 9.0], "small": [1.0, 2.0, 900.0, 3.0], "flat": [7.0] * 9 + [70.0]}
    rows = [(f"{c}{i}", c, float(p)) for c, ps in cells.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "id string, cell string, total_fare double")
    got = {r["id"]: r for r in cleaning.detect_outliers(df, ["cell"]).collect()}
    for c, ps in cells.items():
        mad, iqr = brute_flags(ps)
        for i in range(len(ps)):
            assert got[f"{c}{i}"]["is_outlier_mad"] == mad[i] and got[f"{c}{i}"]["is_outlier_iqr"] == iqr[i]
    assert got["a40"]["is_outlier"] and got["a40"]["outlier_rule"] == "mad_log" and got["a0"]["outlier_rule"] is None
    assert not got["flat9"]["is_outlier_mad"]
    with pytest.raises(ValueError):
        cleaning.detect_outliers(df, ["cell"], min_cell_size=1)


def test_flight_keys(spark):
    t = lambda m: dt.datetime(2026, 1, 1, 6, 0) + dt.timedelta(minutes=m)
    day = dt.date(2026, 1, 1)
    rows = [("a", "6E", "1", day, t(0)), ("b", "6E", "1", day, t(15)), ("c", "6E", "1", day, t(16)), ("d", "6E", "1", day, t(30)), ("e", "6E", "1", day, t(32)),
            ("f", "6E", None, day, t(0)), ("g", "6E", None, day, t(5)), ("h", "6E", "1", day, t(0))]
    df = spark.createDataFrame(rows, "id string, carrier_iata string, flight_number string, travel_date date, dep_datetime_local timestamp_ntz")
    got = {r["id"]: r["flight_key"] for r in cleaning.assign_flight_key(df).collect()}
    ns = uuid.UUID(hashing.FLIGHT_KEY_NAMESPACE)
    assert got["a"] == str(uuid.uuid5(ns, "6E|1|2026-01-01|0"))
    assert got["a"] == got["b"] == got["h"] and got["c"] == got["d"] != got["a"]
    assert got["e"] == str(uuid.uuid5(ns, "6E|1|2026-01-01|2"))
    assert got["f"] == got["g"] == str(uuid.uuid5(ns, "6E|None|2026-01-01|0"))


def test_decompose(spark):
    D = Decimal
    rows = [("rep", "DEL", D("900.00"), D("50.00"), D("50.00"), None, D("1000.00")), ("off", "DEL", D("900.00"), D("50.00"), D("50.00"), None, D("1000.50")),
            ("der", "DEL", None, None, None, D("49.00"), D("1199.00")), ("unk", "XXX", None, None, None, None, D("1000.00")), ("low", "DEL", None, None, None, None, D("90.00"))]
    df = spark.createDataFrame(rows, "id string, origin_iata string, base_fare decimal(12,2), taxes decimal(12,2), udf decimal(12,2), convenience_fee decimal(12,2), total_fare decimal(12,2)")
    fee = spark.createDataFrame([("DEL", D("100.00"))], "origin_iata string, airport_udf decimal(12,2)")
    got = {r["id"]: r for r in cleaning.decompose_fares(df, fee, 0.05).collect()}
    assert got["rep"]["fare_split_source"] == "reported" and got["rep"]["component_sum_consistent"]
    assert got["off"]["component_sum_consistent"] is False
    base = (D("1050.00") / D("1.05")).quantize(D("0.01"))
    assert (got["der"]["base_fare"], got["der"]["taxes"], got["der"]["udf"]) == (base, (base * D("0.05")).quantize(D("0.01")), D("100.00"))
    assert got["unk"]["fare_split_source"] == got["low"]["fare_split_source"] == "undetermined"
    assert got["unk"]["component_sum_consistent"] is None and got["low"]["base_fare"] is None
    with pytest.raises(ValueError):
        cleaning.decompose_fares(df, fee, 1.5)


def test_missing_imputation_coverage(spark):
    day, cell = dt.date(2026, 1, 1), "source_id string, route_id string, carrier_iata string, flight_number string, advance_days int, query_date date, travel_date date"
    key = lambda r, f: ("s", r, "6E", f, 3, day, day + dt.timedelta(3))
    expected = spark.createDataFrame([key("r1", "1"), key("r1", None), key("r2", "1"), key("r3", "1")], cell)
    observed = spark.createDataFrame([key("r1", None), key("r1", None)], cell)
    runs = spark.createDataFrame(
        [("s", "r1", day, "FAILED", dt.datetime(2026, 1, 1, 4)), ("s", "r1", day, "PARTIAL", dt.datetime(2026, 1, 1, 9)), ("s", "r2", day, "BLOCKED", dt.datetime(2026, 1, 1, 4)), ("s", None, day, "SUCCEEDED", dt.datetime(2026, 1, 1, 4))],
        "source_id string, route_id string, query_date date, status string, started_at timestamp",
    )
    gaps = missing.classify_missing(missing.missing_cells(expected, observed), runs)
    got = {r["route_id"]: r["missing_reason"] for r in gaps.collect()}
    assert got == {"r1": "sold_out", "r2": "not_collected", "r3": "not_collected"}
    clean = spark.createDataFrame([("r1", 3, "LCC", float(p)) for p in (10, 20, 60)] + [("r2", 3, "LCC", 5.0)], "route_id string, advance_days int, carrier_type string, total_fare double")
    sold = gaps.where("missing_reason = 'sold_out'").withColumn("carrier_type", F.lit("LCC"))
    done, left = missing.impute_sold_out(sold, clean)
    assert done.first()["total_fare"] == 30.0 and done.first()["imputation_method"] == "cell_mean" and left.count() == 0
    done, left = missing.impute_sold_out(sold, clean, min_size=4)
    assert done.count() == 0 and left.count() == 1
    cov = {r["route_id"]: r for r in missing.coverage(expected, observed, gaps).collect()}
    assert cov["r1"]["coverage_pct"] == 50.0 and cov["r1"]["sold_out_count"] == 1 and cov["r3"]["coverage_pct"] == 0.0


def gate_frames(spark, **change):
    row = dict(quote_id="q1", route_id="r", base_fare=1000.0, taxes=50.0, total_fare=1100.0, is_outlier=False, is_imputed=False, imputation_method=None)
    schema = "quote_id string, route_id string, base_fare double, taxes double, total_fare double, is_outlier boolean, is_imputed boolean, imputation_method string"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [row, {**row, "quote_id": None}, {**row, "quote_id": None}, {**row, **{"quote_id": "q2", **change}}]
    clean = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    return clean, spark.createDataFrame([(90.0,)], "coverage_pct double"), spark.createDataFrame([("r", 500.0)], "route_id string, distance_km double")


@pytest.mark.parametrize(
    "change,failing",
    [({}, set()), ({"base_fare": 99999.0}, {"base_fare_within_band__short"}), ({"base_fare": 99999.0, "is_outlier": True}, set()), ({"quote_id": "q1"}, {"no_duplicate_quote_id"}),
     ({"taxes": 900.0}, {"tax_share_within_band"}), ({"is_imputed": True}, {"no_imputed_row_without_method"}), ({"route_id": "zz"}, {"route_distance_known"})],
)
def test_gates(spark, change, failing):
    report = gates.quality_report(*gate_frames(spark, **change))
    assert {r["gate"] for r in report.collect() if not r["success"]} == failing
    if failing:
        with pytest.raises(gates.GateFailure):
            gates.assert_gates(report)
    else:
        gates.assert_gates(report)


def test_coverage_gate(spark):
    clean, _, dist = gate_frames(spark)
    low = spark.createDataFrame([(10.0,), (120.0,), (50.0,)], "coverage_pct double")
    report = {r["gate"]: r for r in gates.quality_report(clean, low, dist).collect()}
    assert report["coverage_above_floor"]["unexpected_count"] == 2


def test_clean_run_end_to_end(spark):
    day = dt.date(2026, 1, 1)
    D = Decimal
    base = dict(source_id="s", route_id="r", origin_iata="DEL", carrier_iata="6E", travel_date=day + dt.timedelta(3), advance_days=3, stops=0)
    rows = []
    for i in range(7):
        total = D("9000.00") if i == 6 else D(1000 + 7 * i)
        rows.append((f"q{i}", "s", dt.datetime(2026, 1, 1, 4), "r", "DEL", "6E", str(i), base["travel_date"], 3, 0, True, None, None, None, None, None, total, dt.datetime(2026, 1, 4, 6, i)))
    rows.append(("bad", "s", dt.datetime(2026, 1, 1, 4), None, "DEL", "6E", "9", base["travel_date"], 3, 0, True, None, None, None, None, None, D("5.00"), dt.datetime(2026, 1, 4, 6)))
    q = spark.createDataFrame(rows, "id string, source_id string, collected_at timestamp, route_id string, origin_iata string, carrier_iata string, flight_number string, travel_date date, advance_days int, stops int, refundable boolean, baggage_included boolean, base_fare decimal(12,2), taxes decimal(12,2), udf decimal(12,2), convenience_fee decimal(12,2), total_fare decimal(12,2), dep_datetime_local timestamp_ntz")
    expected = spark.createDataFrame([("s", "r", "6E", str(i), 3, day, base["travel_date"]) for i in range(9)], "source_id string, route_id string, carrier_iata string, flight_number string, advance_days int, query_date date, travel_date date")
    runs = spark.createDataFrame([("s", "r", day, "SUCCEEDED", dt.datetime(2026, 1, 1, 4))], "source_id string, route_id string, query_date date, status string, started_at timestamp")
    out = clean_quotes(q, expected, runs, spark.createDataFrame([("6E", "LCC")], "carrier_iata string, carrier_type string"),
                       spark.createDataFrame([("DEL", D("100.00"))], "origin_iata string, airport_udf decimal(12,2)"), "snap")
    clean = [r.asDict(recursive=True) for r in out.clean.collect()]
    assert [r["id"] for r in out.quarantined.collect()] == ["bad"]
    assert sum(r["is_outlier"] for r in clean) == 1 and sum(r["is_imputed"] for r in clean) == 2 and len(clean) == 9
    imputed = [r for r in clean if r["is_imputed"]][0]
    assert imputed["total_fare"] == D(str(statistics.mean([1000 + 7 * i for i in range(6)]))).quantize(D("0.01"))
    assert imputed["quote_id"] is None and imputed["base_fare"] is None and imputed["quality_vector"]["carrier_type"] == "LCC"
    seen = [r for r in clean if not r["is_imputed"]][0]
    assert seen["quality_vector"]["fare_split"] == "derived" and seen["quality_vector"]["baggage_included"] is None and seen["dep_hour_bucket"] == 6
    assert out.coverage.first()["coverage_pct"] == pytest.approx(100 * 7 / 9)


def test_urls_and_hashes(spark):
    urls = ["HTTP://Ex.com:80?b=2&a=1#x", "https://ex.com:8443/P?q=a%20b&q=A", "http://ex.com/?a=1&b=2", "https://ex.com:443/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(hashing.normalise_url(F.col("u"))).collect()]
    assert got == ["http://ex.com/?a=1&b=2", "https://ex.com:8443/P?q=A&q=a+b", "http://ex.com/?a=1&b=2", "https://ex.com/x"]
    odd = {
        "http://h_1.com/a b?d=10%zz&p=x|y z": "http://h_1.com/a b?d=10%25zz&p=x%7Cy+z",
        "https://u:p@Ex.com:0443/?t=~*&e": "https://ex.com/?e=&t=~%2A",
        "http://[::1]:80?k=%E2%82%AC": "http://::1/?k=%E2%82%AC",
        "ftp://ex.com:80": "ftp://ex.com:80/",
    }
    got = spark.createDataFrame([(u,) for u in odd], "u string").select("u", hashing.normalise_url(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in got} == odd
    rows = spark.createDataFrame([(str(i),) for i in range(50)], "x string")
    one = hashing.rows_hash(rows, F.col("x")).first()["content_hash"]
    assert one == hashing.rows_hash(rows.orderBy(F.rand(1)), F.col("x")).first()["content_hash"]
    assert one != hashing.rows_hash(rows.limit(49), F.col("x")).first()["content_hash"]
    assert hashing.config_hash({"b": 1, "a": 2}) == hashing.config_hash({"a": 2, "b": 1})


def test_rule_violations_and_staging(spark):
    df = spark.createDataFrame([("a", 5.0, 6.0), ("b", 7.0, 6.0), ("c", None, 1.0)], "id string, ci_low double, ci_high double")
    assert gates.rule_report(df, gates.NOWCAST_RULES).first()["violations"] == 1
    bad = gates.rule_violations(df, gates.NOWCAST_RULES, ["id"]).collect()
    assert [(r["id"], r["broken_rules"]) for r in bad] == [("b", ["interval_ordered"])]
    assert staged(df).count() == 3
    assert GateOptions().bands[-1][1] is None and CleaningOptions().min_cell_size == 5
