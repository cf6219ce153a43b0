"""Suffix-array and weighted MinHash dedup against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import *  # noqa: F403
from conftest import sha

from quotemill.llm import minhash_dedup, suffix_dedup


def brute_rows(rows, length=100):
    """What is left of every row, as a list per id."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0], sha(r[1] or ""))):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\x01" * length
            seen.add(w)
        rest = bytes(x for x, c in zip(b, cover) if not c)
        out.setdefault(i, []).append((len(b), sum(cover), sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1])), sha(rest)))
    return {i: sorted(x) for i, x in out.items()}


def brute_cut(rows, length=100):
    """What is left of every row, ids being unique."""
    return {i: x[0] for i, x in brute_rows(rows, length).items()}


def cut(df):
    got = {}
    for r in suffix_dedup.remove_repeats(df).collect():
        got.setdefault(r.row_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept))
    return {i: sorted(x) for i, x in got.items()}


@pytest.fixture(params=[10_000, 3])
def batches(spark, request):
    """Arrow batches of many and of few documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def test_cut_as_brute_force(documents, prose, batches):
    a, b, line = prose(1), prose(2), prose(3, 18)
    rows = [
        (1, a), (2, a), (3, "x" + a[50:400] + b), (4, None), (5, ""), (6, "short"), (7, "short"), (8, "z" * 1000), (9, b[:99]), (10, b[:100]), (11, "é" * 300),
        (12, a[100:199] + "q" + a[100:200]), (13, "ab" * 400), (14, prose(9, 9000)), (15, prose(9, 9000)[7:]), (16, "y" + "é" * 200),
        *[(20 + k, prose(100 + k, 30) + line + prose(200 + k, 30)) for k in range(12)],
    ]
    assert cut(documents(rows)) == brute_rows(rows)


def test_repeated_ids_keep_one_text(documents, prose):
    a, b = prose(1), prose(2)
    rows = [(1, a), (1, a), (1, a), (2, b), (2, a + b), (3, b), (3, b[:300]), (4, None), (4, ""), (5, prose(5)), (5, prose(6)), (None, a)]
    got = cut(documents(rows))
    assert got == brute_rows([r for r in rows if r[0] is not None])
    assert sorted(x[1] for x in got[1]) == [0, len(a.encode()), len(a.encode())]


def test_a_passage_in_every_document(documents, prose, batches):
    line = prose(3, 60) + ". "
    rows = [(k, prose(100 + k, 30 + k % 7) + line * (1 + k % 3) + prose(300 + k, 30) + (line if k % 4 == 0 else "")) for k in range(60)]
    assert cut(documents(rows)) == brute_rows(rows)


def test_cut_keeps_columns_and_empty_table(documents, prose):
    out = suffix_dedup.remove_repeats(documents([(1, prose(1)), (2, prose(1))]), texts=True, carry=["lang"]).collect()
    assert {(r.row_id, r.kept == "", r.lang) for r in out} == {(1, False, "en"), (2, True, "en")}
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def brute_classes(rows):
    """Exact components at the plain Jaccard similarity of five-word shingles; fixtures stay clear of the threshold."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


def edited(text, at, word="changed"):
    w = text.split()
    for k in at:
        w[k] = word + str(k)
    return " ".join(w)


def test_classes_as_brute_force(documents, prose):
    a, b = prose(1, 300), prose(2, 300)
    rows = [
        (1, a), (2, a), (3, a.upper()), (4, edited(a, [100])), (5, edited(a, [100, 200])), (6, b), (7, edited(b, range(0, 300, 9))), (8, None), (9, ""), (10, "  "), (11, "one two"),
        (12, "one  two"), (13, "one three"), (14, prose(5, 12_000)), (15, edited(prose(5, 12_000), [7])),
        # a chain: each step is close to the next, its ends are not close
        *[(30 + k, edited(prose(7, 200), range(10, 10 + 8 * k, 8))) for k in range(5)],
    ]
    got = {r.row_id: r.class_id for r in minhash_dedup.classes(documents(rows)).collect()}
    want = brute_classes(rows)
    assert {k: got[k] for k in got if k < 30} == {k: want[k] for k in want if k < 30}
    assert minhash_dedup.classes(documents([])).count() == 0


def test_rows_that_share_an_id_are_one_document(documents, prose):
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a), (1, a), (2, b), (3, c), (3, c), (4, edited(a, [50])), (5, prose(5, 90)), (5, prose(6, 90)), (6, edited(b, [9])), (6, c), (7, edited(prose(6, 90), [80])), (8, None), (8, ""), (9, a), (9, b), (None, a)]
    got = sorted((r.row_id, r.class_id) for r in minhash_dedup.classes(documents(rows)).collect())
    # 9 holds the texts of 1 and 2, and 6 one like that of 2 and the one of 3
    one = {i: 1 for i in (1, 2, 3, 4, 6, 9)} | {5: 5, 7: 5, 8: 8}
    assert got == sorted((i, one[i]) for i, _ in rows if i is not None)


def test_tiles_find_links_between_parts(prose):
    import numpy as np

    base = [prose(k, 100) for k in range(6)]
    bodies = base + [edited(t, [50]) for t in base]
    idf = minhash_dedup.idf_table(np.zeros(minhash_dedup.SKETCH_ROWS * minhash_dedup.SKETCH_CELLS), 12)
    links = set(minhash_dedup._tile_links(list(range(12)), list(range(12)), [k >= 6 for k in range(12)], bodies, idf))
    assert {(b, a) for a, b in links} == {(k, k + 6) for k in range(6)}


def test_counting_shingles_keeps_a_worker_small():
    """The sketch is 8 MB; texts are cut up in small parts and counts are sent without a Python number for each (44 MB at the peak before)."""
    words = [" ".join(f"w{(7 * k * j) % 999983}" for j in range(400)) for k in range(1, 401)]
    batches = [pa.RecordBatch.from_pydict({"body": words})]
    tracemalloc.start()
    try:
        (out,) = list(minhash_dedup._count(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = np.zeros(minhash_dedup.SKETCH_ROWS * minhash_dedup.SKETCH_CELLS, dtype=np.int64)
    for cell in minhash_dedup.cells(minhash_dedup.shingles(words)[0]):
        want += np.bincount(cell, minlength=len(want))
    got = np.zeros_like(want)
    rows = out.to_pydict()
    for at, counts in zip(rows["slice"][:-1], rows["counts"][:-1], strict=True):
        got[at * 4096 : (at + 1) * 4096] = counts
    assert (got == want).all() and (rows["slice"][-1], rows["counts"][-1]) == (-1, [400])
    assert peak < 36e6
    (none,) = list(minhash_dedup._count(iter([])))
    assert none.to_pydict() == {"slice": [-1], "counts": [[0]]}


def test_tiles_keep_a_worker_small(prose):
    """A tile of two times TILE texts is cut up in parts and multiplied a few columns at a time (103 MB at the peak before, 44 now)."""
    n = 2 * minhash_dedup.TILE
    bodies = [prose(k % 500, 300) for k in range(n)]
    idf = minhash_dedup.idf_table(np.zeros(minhash_dedup.SKETCH_ROWS * minhash_dedup.SKETCH_CELLS), n)
    tracemalloc.start()
    try:
        links = set(minhash_dedup._tile_links(list(range(n)), list(range(n)), [k >= 500 for k in range(n)], bodies, idf))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert links == {(k, k - 500) for k in range(500, n)}
    assert peak < 70e6


def test_anchors_keep_a_worker_small(prose):
    """Texts are hashed in parts of 200,000 bytes (20 MB at the peak before, 9 now)."""
    texts = [prose(k, 300).encode() for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts, pa.binary())], names=["row", "body"])
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(suffix_dedup._anchor_rows(iter([batch]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    alone = [(v, k, a) for k, t in enumerate(texts) for v, a in zip(*[x.tolist() for x in suffix_dedup.anchors(np.frombuffer(t, dtype=np.uint8), np.zeros(1, dtype=np.int64))[1::-1]], strict=True)]
    assert list(zip(out["anchor"].to_numpy().view(np.uint64).tolist(), out["row"].to_pylist(), out["at"].to_pylist(), strict=True)) == alone
    assert peak < 14e6
