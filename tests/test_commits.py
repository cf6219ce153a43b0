"""Ledger and run tables under two writers, failures and repeats; streaming sinks and the surge watch's timers."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from quotemill.config import SurgeOptions
from quotemill.functions import hashing
from quotemill.sources import commits, ledger
from quotemill.streaming import jobs

KEYS = "content_hash string, collected_at timestamp, v int"
T = [dt.datetime(2026, 1, d, 5) for d in range(1, 10)]


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a = spark.createDataFrame([("h1", T[0], 1), ("h1", T[0], 1), ("h2", T[1], 2)], KEYS)
    assert ledger.append_quotes(a, path, "a") and not ledger.append_quotes(a, path, "a")
    # other rows under the name of a batch that is there are not looked at: the name says what it is
    assert not ledger.append_quotes(spark.createDataFrame([("h9", T[0], 9)], KEYS), path, "a")
    assert ledger.append_quotes(a, path, "b")
    assert sorted(r.content_hash for r in ledger.read_ledger(spark, path).collect()) == ["h1", "h2"]
    assert [r.key for r in commits.entries(spark, path).orderBy("version").collect()] == ["a", "b"]


@pytest.mark.parametrize("second_day, redone", [(T[0], True), (T[5], False)])
def test_the_second_of_two_writers_looks_again(spark, tmp_path, monkeypatch, second_day, redone):
    """Another writer commits between this one's read and its commit."""
    path = str(tmp_path / "ledger")
    ledger.append_quotes(spark.createDataFrame([("h0", T[0], 0)], KEYS), path, "zero")
    mine = spark.createDataFrame([("h1", T[0], 1), ("h2", T[1], 1)], KEYS)
    theirs = spark.createDataFrame([("h1", second_day, 2), ("h3", second_day, 2)], KEYS)
    plain, tries = commits.commit, []

    def commit(spark_, root, key, *args, **kw):
        if key == "mine":
            tries.append(key)
            if len(tries) == 1:
                ledger.append_quotes(theirs, path, "theirs")
        return plain(spark_, root, key, *args, **kw)

    monkeypatch.setattr(commits, "commit", commit)
    assert ledger.append_quotes(mine, path, "mine")
    got = {(r.content_hash, r.collected_at): r.v for r in ledger.read_ledger(spark, path).collect()}
    want = {("h0", T[0]): 0, ("h1", second_day): 2, ("h3", second_day): 2, ("h2", T[1]): 1}
    assert got == (want if redone else want | {("h1", T[0]): 1}) and len(tries) == (2 if redone else 1)
    assert ledger.read_ledger(spark, path).count() == len(got)


def test_many_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    frames = [spark.createDataFrame([(f"h{k % 7}", T[k % 3], n) for k in range(n, n + 12)], KEYS) for n in range(5)]
    threads = [threading.Thread(target=ledger.append_quotes, args=(f, path, f"b{n}")) for n, f in enumerate(frames)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    want = {(f"h{k % 7}", T[k % 3]) for n in range(5) for k in range(n, n + 12)}
    rows = ledger.read_ledger(spark, path).collect()
    assert {(r.content_hash, r.collected_at) for r in rows} == want and len(rows) == len(want)
    assert [r.version for r in commits.entries(spark, path).orderBy("version").collect()] == [1, 2, 3, 4, 5]


def test_a_run_written_again_replaces_its_tables_at_once(spark, tmp_path):
    out = str(tmp_path / "runs")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    ledger.write_run({"x": frame((1, "old"), (2, "old")), "y": frame((1, "old"))}, out, "0012", {"vintage_date": "2026-01-01"})
    ledger.write_run({"x": frame((5, "b")), "y": frame()}, out, "1e5", {})
    bad = frame((1, "new")).withColumn("v", F.raise_error(F.lit("lost job")).cast("string"))
    with pytest.raises(Exception, match="lost job"):
        ledger.write_run({"x": frame((1, "new")), "y": bad}, out, "0012", {})
    read = lambda t: sorted((r.index_run_id, r.k, r.v) for r in ledger.read_run_table(spark, out, t).collect())
    assert read("x") == [("0012", 1, "old"), ("0012", 2, "old"), ("1e5", 5, "b")] and read("y") == [("0012", 1, "old")]
    ledger.write_run({"x": frame((3, "new")), "y": frame((4, "new"), (4, "new"))}, out, "0012", {})
    assert read("x") == [("0012", 3, "new"), ("1e5", 5, "b")] and read("y") == [("0012", 4, "new"), ("0012", 4, "new")]
    assert ledger.committed_runs(spark, out).count() == 2
    # what a lost job left, and what was replaced, can go
    frame((9, "left")).write.parquet(f"{out}/x/index_run_id=0012@{commits.new_attempt()}")
    assert read("x")[0] == ("0012", 3, "new")
    assert commits.sweep(spark, out, older_than_seconds=3600) == [] and len(commits.sweep(spark, out, older_than_seconds=-5)) == 3
    assert read("x") == [("0012", 3, "new"), ("1e5", 5, "b")]


def test_stream_into_the_ledger_drops_copies_however_late(spark, tmp_path):
    inbox, path, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    batches = [[("h1", T[0], 1), ("h2", T[1], 1)], [("h1", T[0], 2), ("h5", T[8], 2)], [("h1", T[0], 3), ("h2", T[1], 3), ("h2", T[2], 3)]]
    for rows in batches:
        spark.createDataFrame(rows, KEYS).coalesce(1).write.mode("append").parquet(inbox)
        jobs.append_stream(jobs.read_stream(spark, inbox, KEYS, files_per_batch=1), path, state)
    got = sorted((r.content_hash, r.collected_at, r.v) for r in ledger.read_ledger(spark, path).collect())
    assert got == [("h1", T[0], 1), ("h2", T[1], 1), ("h2", T[2], 3), ("h5", T[8], 2)]


def test_idle_routes_are_forgotten_and_late_days_marked(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    o = SurgeOptions(5, 3.0, 2)
    known = []
    for rows in (
        [("a", day(n), 10.0 + n) for n in range(4)] + [("b", day(0), 5.0), ("b", day(1), 6.0), ("b", day(2), 7.0), ("b", day(2), 7.5)],
        [("a", day(n), 20.0) for n in range(4, 60)] + [("b", day(1), 5.0), ("b", day(40), 7.0)],  # b has a day late, and is known still
        [("a", day(61), 20.0)],
        [("a", day(200), 20.0)],
        [("a", day(201), 20.0)],
        [("b", day(202), 900.0), ("a", day(202), 21.0)],  # b is new again
    ):
        spark.createDataFrame(rows, "route_code string, travel_date date, fare double").coalesce(1).write.mode("append").parquet(inbox)
        stream = jobs.read_stream(spark, inbox, "route_code string, travel_date date, fare double", files_per_batch=1)
        jobs.run_available(jobs.surge_stream(stream, o, "30 days", 90), "s", out=out, checkpoint=state)
        states = spark.read.format("statestore").option("path", state).option("stateVarName", "baseline").load()
        known.append("".join(sorted(r.key.route_code for r in states.collect())))
    assert known[:3] == ["ab", "ab", "ab"] and known[4:] == ["a", "ab"]
    got = {(r.route_code, r.travel_date, r.is_late): r for r in spark.read.parquet(out).collect()}
    assert sorted((k[0], k[1]) for k in got if k[2]) == [("b", day(1)), ("b", day(2))]
    assert got["b", day(40), False].baseline_available and got["b", day(40), False].baseline_median == 6.0
    assert not got["b", day(202), False].baseline_available and got["a", day(202), False].baseline_available


def test_hashes_move_as_bytes(spark):
    """Digests in hex take 32 bytes; no two texts share their bytes, and each is read back as it was."""
    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest[:-1], digest + "0", "", "x" * 31, "x" * 32, "x" * 33, "x" * 32 + "\0", "ä" * 16, bytes.fromhex("61" * 32).decode(), "61" * 32, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.packed(F.col("t")).alias("b"))
    got = df.select("t", "b", hashing.unpacked(F.col("b")).alias("back")).collect()
    assert all(r.t == r.back for r in got) and len({r.b and bytes(r.b) for r in got}) == len(texts)
    assert len(next(r.b for r in got if r.t == digest)) == 32
    quotes = spark.createDataFrame([(digest, T[0], 1), (digest, T[0], 1), (None, T[0], 1), (None, T[0], 1), ("h", None, 2), ("h", T[1], 3), ("g", T[1], 4)], KEYS)
    held = spark.createDataFrame([("h", T[1], 9), (None, T[0], 9), ("h", None, 9)], KEYS)
    fresh = ledger.new_quotes(quotes, held)
    assert fresh.columns == quotes.columns
    assert {tuple(r) for r in fresh.collect()} == {(digest, T[0], 1), (None, T[0], 1), ("h", None, 2), ("g", T[1], 4)} and fresh.count() == 4
    moved = [line for line in fresh._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(content_hash" in line]
    assert moved and "unhex(" in fresh._jdf.queryExecution().optimizedPlan().toString()


def test_an_attempt_made_again_reads_what_it_wrote(spark, tmp_path, monkeypatch):
    """Not the batch, and not the part of the ledger it was compared with before."""
    path = str(tmp_path / "ledger")
    ledger.append_quotes(spark.createDataFrame([("h0", T[0], 0)], KEYS), path, "zero")
    mine = spark.createDataFrame([("h0", T[0], 1), ("h1", T[0], 1), ("h1", T[0], 1), ("h2", T[1], 1)], KEYS)
    theirs = spark.createDataFrame([("h1", T[0], 2), ("h3", T[0], 2)], KEYS)
    plain, fresh, seen, tries = commits.commit, ledger.new_quotes, [], []

    def commit(spark_, root, key, *args, **kw):
        if key == "mine" and not tries:
            tries.append(key)
            ledger.append_quotes(theirs, path, "theirs")
        return plain(spark_, root, key, *args, **kw)

    def watched(incoming, existing):
        seen.append((incoming.count(), existing.count()))
        return fresh(incoming, existing)

    monkeypatch.setattr(commits, "commit", commit)
    monkeypatch.setattr(ledger, "new_quotes", watched)
    assert ledger.append_quotes(mine, path, "mine")
    assert seen == [(4, 1), (2, 1), (2, 2)]  # mine, theirs within, mine once more: h1 and h2 against h1 and h3
    assert sorted((r.content_hash, r.v) for r in ledger.read_ledger(spark, path).collect()) == [("h0", 0), ("h1", 2), ("h2", 1), ("h3", 2)]
    # only attempts that count are left
    assert len(list((tmp_path / "ledger").glob("attempt=*"))) == 3


def test_distinct_texts_by_fingerprints(spark, monkeypatch):
    """Also where fingerprints of unlike texts are the same, and for null keys and texts."""
    rows = [("a", "x"), ("a", "y"), ("a", "x"), ("a", None), ("a", None), ("b", "x"), ("b", "z"), (None, "x"), (None, "x"), (None, "q"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, t string")
    want = {("a", 5, 2), ("b", 2, 2), (None, 3, 2), ("c", 1, 0)}
    assert {tuple(r) for r in hashing.rows_and_distinct(df, "k", "t", "n", "d").collect()} == want
    monkeypatch.setattr(hashing.F, "xxhash64", lambda c: F.length(c).cast("long"))
    out = hashing.rows_and_distinct(df, "k", "t", "n", "d")
    assert out.columns == ["k", "n", "d"] and {tuple(r) for r in out.collect()} == want


def test_attempts_that_do_not_count_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("h0", T[0], 0), ("h1", T[1], 0)], KEYS)
    ledger.append_quotes(rows, path, "one")
    ledger.append_quotes(spark.createDataFrame([("h2", T[0], 0)], KEYS), path, "two")
    other = f"{path}/attempt={commits.new_attempt()}"
    rows.withColumn("collected_day", F.to_date("collected_at")).write.partitionBy("collected_day").parquet(other)
    whole, newer = ledger.read_ledger(spark, path), ledger.read_ledger(spark, path, 1)
    commits.discard_attempt(spark, [other])  # after the folders were listed
    assert sorted(r.content_hash for r in whole.collect()) == ["h0", "h1", "h2"] and [r.content_hash for r in newer.collect()] == ["h2"]
