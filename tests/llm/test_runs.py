"""Periodic runs against a version that looks at every lag, and the query against plain Python."""

import random
import zlib

import pytest
from conftest import *  # noqa: F403

from quotemill.llm import periodic_runs
from quotemill.llm.periodic_runs import find_runs


def plain(words):
    """Every maximal stretch of every lag; smallest periods by trying all smaller ones."""
    out, n = [], len(words)
    for q in range(1, n):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begun = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begun - q, i - begun + q
            piece = words[start : start + length]
            if length >= max(6, 4 * q) and not any(all(piece[k] == piece[k - d] for k in range(d, length)) for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(300))
def test_runs_equal_all_lags(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(6):
        letters = [b"a", b"b", b"c", b"d", b"e"][: rnd.randint(1, 5)]
        words = [rnd.choice(letters) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4)):
            block = [rnd.choice(letters) for _ in range(rnd.randint(1, 25))]
            cut = rnd.randint(0, len(block))
            words[rnd.randint(0, len(words)) : 0] = block * rnd.randint(2, 7) + block[:cut]
        texts.append(words)
    assert find_runs(texts) == [plain(t) for t in texts]


def test_long_texts_and_many_lags():
    rnd = random.Random(5)
    block = [rnd.choice([b"x", b"y", b"z"]) for _ in range(700)]
    assert find_runs([[b"w"] * 200_000, block * 5 + [b"end"], [b"a", b"b"] * 40_000 + [b"b"], []]) == [
        [(0, 200_000, 1)],
        plain(block * 5 + [b"end"]),
        [(0, 80_000, 2)],
        [],
    ]


def rewritten(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_the_query(spark, documents, tmp_path, prose):
    from quotemill.llm import queries

    given = [(k, prose(k, 5 + k % 90)) for k in range(120)]
    given += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "x " * 500), (204, "x " * 500), (205, "a b c\x1cd " * 30), (206, "é\x0bü\x0c" * 50)]
    given += [(300 + k, " ".join(["lo", "la", "li"] * k)) for k in range(60)]
    documents(given).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text in given:
        words = rewritten(doc_id, text)
        runs = plain(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))))  # noqa: F405
    assert got == sorted(want, key=str)
    assert sum(r[1] for r in got) > 40


def test_edge_rows(spark, documents):
    out = {r.doc_id: r for r in periodic_runs.periodic_runs(documents([(None, "a a a a a a a"), (1, None)])).collect()}
    assert out[None].collapsed == "a" and out[None].runs[0].asDict() == {"start": 0, "length": 7, "period": 1}
    assert out[1].n_words == 0 and out[1].runs == [] and out[1].collapsed == ""
    assert periodic_runs.periodic_runs(documents([])).count() == 0
