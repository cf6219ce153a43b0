"""Regressions, decomposition, back-test, watchdog, as-of join and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.config import BridgeOptions, SurgeOptions
from quotemill.functions import smallstats as st
from quotemill.operators import backtest, decomposition, hedonic, nowcast, provenance, watchdog
from quotemill.streaming import jobs


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def test_t_distribution():
    assert st.t_two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert st.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert st.t_quantile(0.025, 4) == pytest.approx(-2.776445105, abs=1e-8)
    assert st.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


def observations(spark, n=60, seed=1, late=None):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 0.05, n)) + 4
    y = 0.6 * x + np.cumsum(rng.normal(0, 0.02, n)) + 1
    rows = []
    for i in range(n):
        known = dt.datetime.combine(month(i), dt.time()) + dt.timedelta(days=40)
        if late == i:
            known = dt.datetime(2099, 1, 1)
        rows.append(("S", month(i), float(np.exp(x[i])), None if i == n - 1 else float(np.exp(y[i])), known))
    return spark.createDataFrame(rows, "series_code string, period date, index_value double, target_value double, collected_at timestamp"), x, y


def test_bridge_against_direct_computation(spark):
    n = 60
    obs, x, y = observations(spark, n)
    coef, now = nowcast.fit_bridge(obs, month(n - 1), dt.date(2030, 1, 1), BridgeOptions())
    dx, dy = np.diff(x, prepend=np.nan), np.diff(y, prepend=np.nan)
    idx = range(3, n - 1)
    a = np.array([[1, dx[i], dx[i - 1], dx[i - 2], dy[i - 1]] for i in idx])
    b = np.array([dy[i] for i in idx])
    beta = np.linalg.solve(a.T @ a, a.T @ b)
    e = b - a @ beta
    inv = np.linalg.inv(a.T @ a)
    s = sum(e[t] ** 2 * np.outer(a[t], a[t]) for t in range(len(b)))
    for lag in range(1, 4):
        g = sum(e[t] * e[t - lag] * np.outer(a[t], a[t - lag]) for t in range(lag, len(b)))
        s = s + (1 - lag / 4) * (g + g.T)
    v = inv @ s @ inv
    got = {r["term"]: r for r in coef.collect()}
    names = ["const", "d_index_value_lag0", "d_index_value_lag1", "d_index_value_lag2", "d_target_value_lag1"]
    for i, name in enumerate(names):
        assert got[name]["estimate"] == pytest.approx(beta[i], abs=1e-9)
        assert got[name]["std_error"] == pytest.approx(math.sqrt(v[i, i]), abs=1e-9)
    f = now.first()
    px = np.array([1, dx[n - 1], dx[n - 2], dx[n - 3], dy[n - 2]])
    mean, dof = px @ beta, len(b) - 5
    half = st.t_quantile(0.975, dof) * math.sqrt(px @ v @ px + e @ e / dof)
    level = math.exp(y[n - 2])
    assert f["point_estimate"] == pytest.approx(level * math.exp(mean), rel=1e-9)
    assert f["ci_low"] == pytest.approx(level * math.exp(mean - half), rel=1e-8) and f["ci_high"] == pytest.approx(level * math.exp(mean + half), rel=1e-8)
    assert f["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e), rel=1e-9)


def test_bridge_refusals(spark):
    obs, _, _ = observations(spark, 60, late=20)
    coef, now = nowcast.fit_bridge(obs, month(59), dt.date(2030, 1, 1))
    assert coef.count() == 0 and "look-ahead" in now.first()["skip_reason"]
    obs, _, _ = observations(spark, 20)
    assert "required" in nowcast.fit_bridge(obs, month(19), dt.date(2030, 1, 1))[1].first()["skip_reason"]
    both = obs.unionByName(obs)
    assert "more than one row" in nowcast.fit_bridge(both, month(19), dt.date(2030, 1, 1))[1].first()["skip_reason"]
    with pytest.raises(ValueError):
        nowcast.fit_bridge(obs, month(19), dt.date(2030, 1, 1), BridgeOptions(covariance="HC3"))


def test_passthrough_recovers_known_lags(spark):
    rng = np.random.default_rng(0)
    n = 80
    dx = rng.normal(0, 0.05, n)
    dy = 0.5 * dx + 0.3 * np.concatenate([[0], dx[:-1]]) + 0.01
    rows = [("S", month(i), float(np.exp(2 + dy[: i + 1].sum())), float(np.exp(3 + dx[: i + 1].sum())), dt.datetime(2000, 1, 1)) for i in range(n)]
    obs = spark.createDataFrame(rows, "series_code string, period date, fare_value double, input_price double, collected_at timestamp")
    fit = nowcast.fit_passthrough(obs, max_lag=3)
    cum = {r["lag"]: r for r in nowcast.cumulative_passthrough(fit).collect()}
    assert cum[0]["coefficient"] == pytest.approx(0.5, abs=1e-8) and cum[3]["cumulative_coefficient"] == pytest.approx(0.8, abs=1e-8)


@pytest.mark.parametrize("seed", [1, 2])
def test_decomposition_is_exact(spark, seed):
    rng = np.random.default_rng(seed)
    def cells(shift):
        return [(r, w, c, int(rng.integers(1, 50)), int(rng.integers(1, 50)), float(rng.uniform(0.5, 2)), float(rng.uniform(0.5, 2) + shift)) for r in "abc" for w in ("w1", "w2") for c in "xy"]
    schema = "route_code string, advance_window string, carrier_iata string, n_quotes_prior long, n_quotes_current long, index_value_prior double, index_value_current double"
    total, base = spark.createDataFrame(cells(0.1), schema), spark.createDataFrame(cells(0.0), schema)
    booking = spark.createDataFrame([("w1", 0.6, 0.4), ("w2", 0.4, 0.6)], "advance_window string, weight_prior double, weight_current double")
    pax = spark.createDataFrame([("a", 0.2, 0.3), ("b", 0.3, 0.3), ("c", 0.5, 0.4)], "route_code string, weight_prior double, weight_current double")
    out = decomposition.decompose_movement(total, base, booking, pax).first()
    assert abs(out["residual"]) < 1e-9
    steady = total.withColumn("index_value_current", F.col("index_value_prior")).withColumn("n_quotes_current", F.col("n_quotes_prior"))
    flat = pax.withColumn("weight_current", F.col("weight_prior"))
    calm = decomposition.decompose_movement(steady, steady, booking.withColumn("weight_current", F.col("weight_prior")), flat).first()
    assert all(abs(calm[c]) < 1e-12 for c in calm.asDict())
    assert decomposition.unweighted(total, booking, pax.where("route_code <> 'a'")).first()["code"] == "a"


def test_backtest(spark):
    a = [("national", month(i), float(v)) for i, v in enumerate([1, 2, 3, 2, 5, 6])] + [("r", month(0), 1.0)] + [("flat", month(i), 1.0) for i in range(6)]
    b = [("national", month(i), float(v)) for i, v in enumerate([2, 2, 4, 3, 4, 7])] + [("r", month(0), 1.0)] + [("flat", month(i), float(i + 1)) for i in range(6)] + [("only", month(0), 1.0)]
    s = "scope string, period date, value double"
    got = {r["scope"]: r for r in backtest.score(spark.createDataFrame(a, s), spark.createDataFrame(b, s)).collect()}
    n = got["national"]
    assert n["correlation"] == pytest.approx(np.corrcoef([1, 2, 3, 2, 5, 6], [2, 2, 4, 3, 4, 7])[0, 1])
    assert n["mape"] == pytest.approx(np.mean([0.5, 0, 0.25, 1 / 3, 0.25, 1 / 7]) * 100) and n["directional_accuracy"] == pytest.approx(100.0)
    assert got["r"]["correlation"] is None and "5 required" in got["r"]["coverage_note"]
    assert got["flat"]["correlation"] is None and got["only"]["coverage_note"] == "no overlapping periods"
    pair = backtest.score_national_and_routes(spark.createDataFrame(a, s), spark.createDataFrame(b, s))
    assert {r["scope"] for r in pair.collect()} == {"national", "r", "flat"}


def brute_surges(fares, o):
    out = []
    for i, x in enumerate(fares):
        h = np.array(fares[max(0, i - o.baseline_rows) : i])
        if len(h) < o.min_history:
            out.append((None, False))
            continue
        med = float(np.median(h))
        mad = float(np.median(np.abs(h - med)))
        out.append((med, mad > 0 and abs(x - med) > o.k * mad))
    return out


def test_surges_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(4)
    o = SurgeOptions(7, 3.0, 4)
    data = {"a": [round(float(v), 2) for v in rng.lognormal(4, 0.2, 30)], "b": [5.0] * 10 + [50.0]}
    rows = [(r, dt.date(2026, 1, 1) + dt.timedelta(i), f) for r, fs in data.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "route_code string, travel_date date, fare double")
    batch = {(r["route_code"], r["travel_date"]): r for r in watchdog.detect_surges(df, o).collect()}
    for r, fs in data.items():
        for i, (med, hit) in enumerate(brute_surges(fs, o)):
            got = batch[(r, dt.date(2026, 1, 1) + dt.timedelta(i))]
            assert got["is_surge"] == hit and got["baseline_median"] == (pytest.approx(med) if med is not None else None)
    path = str(tmp_path / "in")
    df.where(F.col("travel_date") < dt.date(2026, 1, 12)).write.parquet(path)
    df.where(F.col("travel_date") >= dt.date(2026, 1, 12)).write.mode("append").parquet(path)
    stream = jobs.read_stream(spark, path, df.schema)
    live = {(r["route_code"], r["travel_date"]): r["is_surge"] for r in jobs.run_available(jobs.surge_stream(stream, o), "t").collect()}
    assert live == {k: r["is_surge"] for k, r in batch.items()}


def test_dispersion_sellout_probe_rail(spark):
    p = spark.createDataFrame([("s", "f", dt.datetime(2026, 1, 1), "1", 100.0), ("s", "f", dt.datetime(2026, 1, 1), "2", 110.0), ("s", "g", dt.datetime(2026, 1, 1), "1", 5.0)],
                              "source_code string, flight_key string, probed_at timestamp, session_id string, total_fare double")
    got = {r["flight_key"]: r for r in watchdog.dispersion(p).collect()}
    assert got["f"]["value"] == pytest.approx(np.std([100, 110], ddof=1) / 105) and got["g"]["value"] == 0.0
    allowed = watchdog.probe_allowed(p, spark.createDataFrame([("s",), ("t",)], "source_code string"), F.lit("2026-01-01 11:00:00").cast("timestamp"))
    assert {r["source_code"]: r["allowed"] for r in allowed.collect()} == {"s": False, "t": True}
    m = spark.createDataFrame([("r", d, "sold_out") for d in (1, 2, 9, 3, 4)] + [("r", 30, "not_collected"), ("q", 9, "sold_out")], "route_id string, advance_days int, missing_reason string")
    v = watchdog.sellout_velocity(m, ["route_id"]).collect()
    assert [(r["route_id"], r["first_sold_out_lead"], r["sold_out_count"]) for r in v] == [("r", 9, 5)]
    air = spark.createDataFrame([("r", dt.date(2026, 1, 1), 100.0)], "route_code string, period date, fare double")
    rail = spark.createDataFrame([("r", dt.date(2026, 1, 1), 50.0)], "route_code string, period date, rail_fare double")
    assert watchdog.compare_to_rail(air, rail).first()["ratio"] == 2.0
    assert watchdog.compare_to_rail(air, rail.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [3600, 86_400, 10_000_000])
def test_as_of_join_against_brute_force(spark, bucket):
    rng = np.random.default_rng(7)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 6000)))
    keys = ["hot"] * 6 + ["b", None]
    left = [(i, keys[int(rng.integers(0, 8))], at()) for i in range(200)]
    right = [(keys[int(rng.integers(0, 8))], t, f"d{i}") for i, t in enumerate({at() for _ in range(60)})] + [("hot", left[0][2] if left[0][1] == "hot" else dt.datetime(2026, 1, 1), "tie")]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    l = spark.createDataFrame(left, "id int, k string, ts timestamp")
    r = spark.createDataFrame(right, "k string, rts timestamp, decision string")
    got = {x["id"]: x["decision"] for x in provenance.as_of_join(l, r, ["k"], "ts", "rts", ["decision"], bucket).collect()}
    assert len(got) == 200
    for i, k, t in left:
        known = [(rt, v) for kk, rt, v in right if kk == k and rt <= t]
        assert got[i] == (max(known)[1] if known else None)


def test_ledger_stream_drops_copies(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("h", t), ("h", t), ("i", t)], "content_hash string, collected_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.ledger_stream(jobs.read_stream(spark, str(tmp_path / "in"), df.schema)), "led")
    assert out.count() == 2


def test_hedonic_with_many_levels_agrees_with_least_squares(spark):
    rng = np.random.default_rng(8)
    levels, n = 5000, 15_000
    level = np.concatenate([np.arange(levels), rng.integers(0, levels, n - levels)])
    period, size = rng.integers(0, 3, n), rng.normal(0, 1, n)
    effect = rng.normal(0, 0.3, levels)
    y = 3 + 0.1 * (period == 1) + 0.2 * (period == 2) + 0.4 * size + effect[level] + rng.normal(0, 0.05, n)
    df = spark.createDataFrame([(f"p{p}", f"c{c:05d}", float(s), float(np.exp(v))) for p, c, s, v in zip(period, level, size, y)], "period string, model string, size double, total_fare double")
    got = {r["term"]: r for r in hedonic.hedonic_time_dummy(df, [], ["model", "size"]).collect()}
    # within levels: demeaned regression gives the same coefficients
    x = np.column_stack([period == 1, period == 2, size]).astype(float)
    inside = lambda m: m - np.array([np.bincount(level, c) / np.bincount(level) for c in m.T]).T[level]
    want = np.linalg.lstsq(inside(x), inside(y[:, None])[:, 0], rcond=None)[0]
    assert [got["period_p1"]["coefficient"], got["period_p2"]["coefficient"], got["size"]["coefficient"]] == pytest.approx(list(want), abs=1e-8)
    assert sum(t.startswith("model__") for t in got) == levels - 1


def test_hedonic_refuses_missing_numeric_quality(spark):
    rows = [(f"p{k % 2}", float(k), 10.0 + k) for k in range(9)] + [("p1", None, 12.0)]
    got = hedonic.hedonic_time_dummy(spark.createDataFrame(rows, "period string, size double, total_fare double"), [], ["size"]).collect()
    assert [r["kind"] for r in got] == ["skip"] and "missing" in got[0]["skip_reason"]
