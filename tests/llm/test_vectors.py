"""Vector links and exact top-k against brute force."""

import math

import numpy as np
from conftest import *  # noqa: F403

from quotemill.llm import cover_topk, vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def fixture():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k] * 3 + rng.normal(size=8) * 0.05).tolist()) for k in range(20)]
    rows += [(200 + k, base[0].tolist()) for k in range(5)]
    return rows + [(300, None), (400, []), (500, [0.0] * 8), (600, [math.nan] + [1.0] * 7), (700, [1.0] * 7 + [None]), (800, [math.inf] + [1.0] * 7)]


def test_links_as_brute_force(spark):
    rows = fixture()
    df = table(spark, rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links.link_vectors(df).collect()}
    good = [(i, np.array(np.float32(v), dtype=float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: [j for j, w in good if j != i and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9] for i, v in good}
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for i in near:
            comp[i] = min([comp[i], *(comp[j] for j in near[i])])
    assert got == {i: (len(near.get(i, [])), comp[i], comp[i] == i) for i, _ in rows}
    assert vector_links.audit(df, vector_links.link_vectors(df)) == 1.0
    assert vector_links.link_vectors(table(spark, [])).count() == 0


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "SHARD", 300)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(2000 + k, (base[k] + rng.normal(size=24) * 0.25).tolist()) for k in range(500)]
    df = table(spark, rows)
    assert vector_links.audit(df, vector_links.link_vectors(df), sample=2000) >= 0.9


def test_topk_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_topk, "BLOCK", 40)
    monkeypatch.setattr(cover_topk, "QUESTIONS", 3)
    rows = fixture()
    got = {}
    for r in cover_topk.top_k(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(1024 * np.array(np.float32(v), dtype=float))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for i, q in good:
        if i % 100 == 0:
            best = sorted((-int(q @ x), j) for j, x in good if j != i)[:10]
            want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert cover_topk.top_k(table(spark, [])).count() == 0
    assert cover_topk.top_k(table(spark, [(0, [1.0])])).count() == 0


def test_tight_groups_are_no_islands(spark):
    """One shard of groups of 150 near copies: no group has one of its 48 nearest rows outside itself."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(10, 64))
    rows = [(150 * k + j, (v + rng.normal(size=64) * 0.02).tolist()) for k, v in enumerate(base) for j in range(150)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.link_vectors(table(spark, rows)).collect()}
    assert got == {i: (149, i - i % 150) for i, _ in rows}


def test_links_across_many_shards_are_whole(spark, monkeypatch):
    """Over a hundred shards of directions without clusters: partners' homes may be any two of them."""
    monkeypatch.setattr(vector_links, "SHARD", 10)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000 + k, (v + rng.normal(size=64) * 0.4).tolist()) for k, v in enumerate(base[:500])]
    rows += [(2000 + k, (base[0] + rng.normal(size=64) * 0.01).tolist()) for k in range(100)]
    got = {r.vec_id: r.n_links for r in vector_links.link_vectors(table(spark, rows)).collect()}
    x = np.array([np.float32(v) for _, v in rows], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert got == dict(zip([i for i, _ in rows], ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist(), strict=True))


def test_no_task_holds_all_who_ask(spark, monkeypatch):
    """One hot cluster: a task gets a bounded number of rows that ask and of rows stored."""
    monkeypatch.setattr(vector_links, "SHARD", 25)
    rng = np.random.default_rng(4)
    rows = [(k, (np.ones(16) + rng.normal(size=16) * 0.1).tolist()) for k in range(600)] + [(1000 + k, rng.normal(size=16).tolist()) for k in range(300)]
    inner = vector_links._search

    def bounded(table):
        assert table.num_rows <= 2 * 2 * 4 * 25, table.num_rows
        return inner(table)

    monkeypatch.setattr(vector_links, "_search", bounded)
    got = {r.vec_id: r.n_links for r in vector_links.link_vectors(table(spark, rows)).collect()}
    x = np.array([np.float32(v) for _, v in rows], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert got == dict(zip([i for i, _ in rows], ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist(), strict=True))


def test_the_walk_scores_few_pairs_of_clustered_rows():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 32))
    make = lambda n: np.floor(1024 * (middle[rng.integers(0, 40, n)] + rng.normal(size=(n, 32)) * 0.05))
    x, q = make(4000), make(300)
    ids, asked = np.arange(4000), 10_000 + np.arange(300)
    found_q, found_x, scores, taken = cover_topk.meet(q, asked, x, ids, 10)
    assert taken < 0.2 * len(q) * len(x)
    want = {(int(asked[i]), int(j), int(s[j])) for i, s in enumerate(q @ x.T) for j in np.lexsort((ids, -s))[:10]}
    assert set(zip(found_q, found_x, scores)) == want


@pytest.mark.parametrize("seed", range(40))
def test_meetings_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m, d, k = (int(rng.integers(1, top)) for top in (200, 30, 10, 12))
    x, q = (np.floor(rng.normal(size=(rows, d)) * rng.choice([2, 900])) for rows in (n, m))
    if seed % 3 == 0:
        x[: n // 2], q[: m // 2] = x[0], q[0]
    ids = rng.permutation(2 * n)[:n]
    asked = np.concatenate([ids[: m // 2], 1000 + np.arange(m)])[:m]
    want = []
    for i, s in zip(asked, q @ x.T):
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        want += [(int(i), int(ids[j]), int(s[j])) for j in order]
    assert sorted(zip(*cover_topk.meet(q, asked, x, ids, k)[:3])) == sorted(want)


def test_top_k_of_repeated_ids_and_mixed_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [9.0]), (100, [1.0, 1.0]), (4, [9.0, 9.0, 9.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in cover_topk.top_k(table(spark, rows)).collect()]
    one = 1024 * 1024
    assert sorted(got) == [(0, 1, 2, one), (0, 2, 1, one // 2), (0, 3, 100, one // 2), (100, 1, 1, 2 * one), (100, 2, 2, 2 * one), (100, 3, 0, one // 2)]


def test_links_of_repeated_ids_and_mixed_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (4, [5.0]), (4, [1.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [-1.0]), (None, [1.0, 0.0]), (7, [2.0]), (7, None)]
    got = sorted(tuple(r) for r in vector_links.link_vectors(table(spark, rows)).collect())
    # 2 is (0, 1), 4 is (1, 0): smaller than (5)
    assert got == sorted([(1, 1, 1, True)] * 2 + [(2, 1, 2, True)] * 2 + [(3, 1, 2, False)] + [(4, 1, 1, False)] * 2 + [(5, 0, 5, True), (6, 0, 6, True)] + [(7, 0, 7, True)] * 2)
    assert vector_links.link_vectors(table(spark, [])).count() == 0
