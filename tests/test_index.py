"""Elementary, bilateral, multilateral, hedonic and roll-up golden values and identities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.operators import aggregate, elementary, hedonic, multilateral


def pairs(spark, p0, pt):
    return spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(p0, pt)], "g string, p_0 double, p_t double")


@pytest.mark.parametrize(
    "name,p0,pt,want",
    [
        ("jevons", [100, 200, 50], [110, 180, 60], 1.0591045006),
        ("jevons", [1000, 4000], [1200, 3600], 1.0392304845),
        ("dutot", [1000, 4000], [1200, 3600], 0.96),
        ("carli", [1000, 4000], [1200, 3600], 1.05),
    ],
)
def test_elementary(spark, name, p0, pt, want):
    got = elementary.elementary_index(pairs(spark, p0, pt), ["g"], name).first()["index_value"]
    assert got == pytest.approx(want, abs=1e-9)


def test_elementary_refuses_non_positive_prices_and_unknown_names(spark):
    assert elementary.elementary_index(pairs(spark, [0, 2], [1, 1]), ["g"]).first()["index_value"] is None
    with pytest.raises(ValueError):
        elementary.formula("fisher")
    with pytest.raises(ValueError):
        elementary.publishable_formula("carli")


def test_registered_formula(spark):
    elementary.register_formula("harmonic", lambda a, b: 1 / F.avg(b / a))
    got = elementary.elementary_index(pairs(spark, [100, 100], [100, 200]), ["g"], "harmonic").first()["index_value"]
    assert got == pytest.approx(1 / 0.75)


def panel(spark, data):
    return spark.createDataFrame([("c", *r) for r in data], "cell string, period int, product_id string, price double, share double")


DRIFT = [(t, "A", 100.0, 0.5 if t in (0, 3) else 0.6) for t in range(4)] + [
    (t, "B", p, 0.5 if t in (0, 3) else 0.4) for t, p in enumerate([100.0, 60.0, 90.0, 100.0])
]


def levels(df):
    return {r["period"]: r["index_value"] for r in df.collect()}


def test_tornqvist_and_two_period_geks(spark):
    data = [(0, "A", 100.0, 0.4), (0, "B", 200.0, 0.6), (1, "A", 120.0, 0.5), (1, "B", 180.0, 0.5)]
    got, skips = multilateral.geks_tornqvist(panel(spark, data), ["cell"])
    assert levels(got)[1] == pytest.approx(1.0243890816, abs=1e-9)
    assert levels(got)[0] == 1.0 and skips.count() == 0


def test_geks_has_no_chain_drift(spark):
    got, _ = multilateral.geks_tornqvist(panel(spark, DRIFT), ["cell"])
    assert levels(got)[3] == pytest.approx(1.0, abs=1e-12)
    tpd, _ = multilateral.time_product_dummy(panel(spark, DRIFT), ["cell"])
    assert levels(tpd)[3] == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("share", [1.0, 0.0])
def test_tpd_two_periods_is_jevons(spark, share):
    data = [(0, "A", 100.0, share), (0, "B", 200.0, share), (1, "A", 120.0, share), (1, "B", 170.0, share)]
    got, _ = multilateral.time_product_dummy(panel(spark, data), ["cell"])
    assert levels(got)[1] == pytest.approx(1.0099504938, abs=1e-9)


def random_panel(seed, periods=5, products=6, drop=0.2):
    rng = np.random.default_rng(seed)
    return [
        (t, f"p{i}", float(rng.lognormal(4, 0.4)), float(rng.uniform(0.1, 1)))
        for t in range(periods) for i in range(products) if i == 0 or rng.uniform() > drop
    ]


def brute_geks(data):
    by = {}
    for t, p, price, share in data:
        by.setdefault(t, {})[p] = (price, share)
    ts = sorted(by)
    c = []
    for t in ts:
        s = 0.0
        for l in ts:
            if l == t:
                continue
            common = by[l].keys() & by[t].keys()
            w = {p: (by[l][p][1] + by[t][p][1]) / 2 for p in common}
            s += sum(w[p] * math.log(by[t][p][0] / by[l][p][0]) for p in common) / sum(w.values())
        c.append(s / len(ts))
    return {t: math.exp(x - c[0]) for t, x in zip(ts, c)}


def brute_tpd(data):
    ts, ps = sorted({r[0] for r in data}), sorted({r[1] for r in data})
    x = np.array([[1.0] + [float(r[0] == t) for t in ts[1:]] + [float(r[1] == p) for p in ps[1:]] for r in data])
    y, w = np.log([r[2] for r in data]), np.sqrt([r[3] for r in data])
    beta = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
    return {t: math.exp(b) for t, b in zip(ts, [0.0, *beta[1 : len(ts)]])}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_multilateral_against_brute_force_and_scaling(spark, seed):
    data = random_panel(seed)
    frame = panel(spark, data)
    got, _ = multilateral.geks_tornqvist(frame, ["cell"])
    assert levels(got) == pytest.approx(brute_geks(data), abs=1e-9)
    scaled, _ = multilateral.geks_tornqvist(frame.withColumn("price", F.col("price") * 7.5), ["cell"])
    assert levels(scaled) == pytest.approx(levels(got), abs=1e-9)
    tpd, _ = multilateral.time_product_dummy(frame, ["cell"])
    assert levels(tpd) == pytest.approx(brute_tpd(data), abs=1e-8)


def test_incomplete_and_bad_panels_are_skipped_with_a_reason(spark):
    rows = [("gap", 0, "A", 1.0, 1.0), ("gap", 1, "B", 2.0, 1.0), ("neg", 0, "A", -1.0, 1.0), ("neg", 1, "A", 1.0, 1.0),
            ("one", 0, "A", 1.0, 1.0), ("long", 0, "A", 1.0, 1.0), ("long", 99, "A", 1.0, 1.0), ("ok", 0, "A", 1.0, 1.0), ("ok", 1, "A", 2.0, 1.0),
            ("zero", 0, "A", 1.0, 0.0), ("zero", 1, "A", 1.0, 0.0)]
    p = spark.createDataFrame(rows, "cell string, period int, product_id string, price double, share double")
    got, skips = multilateral.geks_tornqvist(p, ["cell"], 50)
    assert {r["cell"] for r in got.collect()} == {"ok"}
    reasons = {r["cell"]: r["skip_reason"] for r in skips.collect()}
    assert reasons == {
        "gap": "a pair of periods shares no product", "neg": "prices must be strictly positive", "one": "needs at least two periods",
        "long": "window longer than declared", "zero": "a pair of periods shares no product",
    }
    _, tpd_skips = multilateral.time_product_dummy(p.where("cell in ('gap', 'ok')"), ["cell"])
    assert [r["cell"] for r in tpd_skips.collect()] == ["gap"]


# --- hedonic ---------------------------------------------------------------------------------


def hedonic_rows(spark, spec):
    rows = [("g", t, cls, float(p)) for t, cls, p, n in spec for _ in range(n)]
    return spark.createDataFrame(rows, "g string, period int, cls string, total_fare double")


def hedonic_index(df, min_r2=0.0):
    out = hedonic.hedonic_time_dummy(df, ["g"], ["cls"], min_r2).collect()
    return {r["period"]: r["index_value"] for r in out if r["kind"] in ("period", "reference")}, out


def test_hedonic_uniform_rise(spark):
    idx, out = hedonic_index(hedonic_rows(spark, [(0, "eco", 100, 2), (0, "biz", 300, 2), (1, "eco", 110, 2), (1, "biz", 330, 2)]))
    assert idx["1"] == pytest.approx(1.1, abs=1e-9) and idx["0"] == 1.0
    assert out[0]["r_squared"] == pytest.approx(1.0)


def test_hedonic_ignores_mix_shift(spark):
    idx, _ = hedonic_index(hedonic_rows(spark, [(0, "eco", 100, 3), (0, "biz", 300, 1), (1, "eco", 100, 1), (1, "biz", 300, 3)]))
    assert idx["1"] == pytest.approx(1.0, abs=1e-9)


def test_hedonic_against_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [("g", int(t), c, int(lead), float(np.exp(4 + 0.1 * t + 0.5 * (c == "b") - 0.01 * lead + rng.normal(0, 0.2))))
            for t in range(3) for c in "abc" for lead in range(1, 15)]
    df = spark.createDataFrame(rows, "g string, period int, cls string, lead int, total_fare double")
    out = {r["term"]: r for r in hedonic.hedonic_time_dummy(df, ["g"], ["cls", "lead"], 0.0).collect()}
    x = np.array([[1.0, r[1] == 1, r[1] == 2, r[2] == "b", r[2] == "c", r[3]] for r in rows], float)
    y = np.log([r[4] for r in rows])
    b = np.linalg.solve(x.T @ x, x.T @ y)
    e = y - x @ b
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - 6))
    for name, coef, err in zip(["const", "period_1", "period_2", "cls__b", "cls__c", "lead"], b, se):
        assert out[name]["coefficient"] == pytest.approx(coef, abs=1e-8)
        assert out[name]["std_err"] == pytest.approx(err, abs=1e-8)


def test_hedonic_floor_and_rank(spark):
    flat = hedonic_rows(spark, [(0, "eco", 100, 1), (0, "biz", 300, 1), (1, "eco", 300, 1), (1, "biz", 100, 1)])
    _, out = hedonic_index(flat, 0.3)
    assert all(r["skip_reason"] for r in out)
    same = hedonic_rows(spark, [(0, "eco", 100, 3), (1, "biz", 300, 3)])
    assert hedonic_index(same)[1][0]["skip_reason"] == "rank deficient"


# --- roll-ups --------------------------------------------------------------------------------


def test_combine_windows(spark):
    v = spark.createDataFrame([("r", "a", 1.10), ("r", "b", 1.05), ("r", "c", 0.95), ("s", "a", 1.10), ("s", "b", 1.05)], "k string, advance_window string, index_value double")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "advance_window string, weight double")
    got = {r["k"]: r for r in aggregate.combine_windows(v, w, ["k"], 1.0).collect()}
    assert got["r"]["index_value"] == pytest.approx(1.0534110104, abs=1e-9) and got["r"]["coverage_pct"] == pytest.approx(100)
    assert got["s"]["index_value"] == pytest.approx(1.0809769050, abs=1e-9) and got["s"]["coverage_pct"] == pytest.approx(80)


def test_national_index_and_exclusions(spark):
    routes = spark.createDataFrame(
        [("DEL-BOM", 1.0797204592, 150, 86.6666666667), ("BOM-DEL", 0.9696927826, 50, 82.0), ("X-Y", 1.5, 10, 50.0)],
        "route_code string, index_value double, n_quotes long, coverage_pct double",
    )
    shares = spark.createDataFrame([("DEL-BOM", 0.7), ("BOM-DEL", 0.3)], "route_code string, weight double")
    row, excluded = aggregate.national_index(routes, shares)
    r = row.first()
    assert r["index_value"] == pytest.approx(1.0454618280, abs=1e-8)
    assert r["n_quotes"] == 200 and r["coverage_pct"] == pytest.approx(85.5, abs=1e-6)
    assert [x[0] for x in excluded.collect()] == ["X-Y"]
    with pytest.raises(ValueError):
        aggregate.assert_all_weighted(excluded, "routes")
    nothing, _ = aggregate.national_index(routes, shares.where("weight > 9"))
    assert nothing.count() == 0


def test_passenger_shares_are_all_or_nothing(spark):
    routes = spark.createDataFrame([("a", "X", "Y"), ("b", "Y", "X")], "route_code string, origin_city string, dest_city string")
    pax = spark.createDataFrame([("X", "Y", 1), ("Y", "X", 2)], "origin_city string, dest_city string, passengers long")
    good, missing = aggregate.passenger_shares(routes, pax, 3)
    assert {r[0]: str(r[1]) for r in good.collect()} == {"a": "0.33333333", "b": "0.66666667"} and missing.count() == 0
    good, missing = aggregate.passenger_shares(routes, pax.limit(1), 3)
    assert good.count() == 0 and missing.count() == 1
