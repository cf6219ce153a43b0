"""All five stages of the corpus pipeline against plain Python."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from conftest import *  # noqa: F403
from conftest import sha
from test_dedup import brute_classes, brute_cut, edited
from tokenizers import Tokenizer

from quotemill.llm import minhash_dedup, quality

MAIL = "anna.miller@example.com"


def test_stages_as_plain_python(spark, documents, prose, tmp_path, monkeypatch):
    good = {k: prose(k, 150) for k in range(1, 41)}
    junk = {100 + k: "@@## $$%% ^^&& !!~~ {}|| " * (20 + k) for k in range(20)}
    passage = prose(500, 40)
    rows = [
        *good.items(), *junk.items(),
        (60, good[1]), (61, edited(good[2], [70])), (62, prose(600, 60) + " " + passage), (63, prose(601, 60) + " " + passage + " " + prose(602, 30)),
        (64, prose(603, 60) + f" {MAIL} " + prose(604, 60)), (None, good[1]), (None, good[1]), (None, None), (65, None),
    ]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in good] + [(k, 0) for k in junk], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    written, inner = {}, corpus_pipeline.staged
    monkeypatch.setattr(corpus_pipeline, "staged", lambda df, name="stage": written.setdefault(name, inner(df, name)))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for name in ("quality", "near_duplicates", "repeats", "personal_data"):
        out = written[name].collect()
        assert written[name].columns == ["doc_id", "text", "lang", "row_id"] and all((r.lang, r.row_id) == ("en", 5) for r in out)
        got[name] = [(r.doc_id, r.text) for r in out]

    docs = documents(rows)
    scores = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")), "doc_id", "text").collect()
    kept = [(r.doc_id, r.text) for r in scores if r.score >= quality.CUT]
    assert Counter(got["quality"]) == Counter(kept)
    assert set(good) | {60, 61, 62, 63, 64} <= {i for i, _ in kept} and not set(junk) & {i for i, _ in kept}

    top = brute_classes([r for r in kept if r[0] is not None])
    assert top[60] == 1 and top[61] == 2
    rest = [(i, t) for i, t in kept if i is None or top[i] == i]
    assert Counter(got["near_duplicates"]) == Counter(rest)

    cut = brute_cut([r for r in rest if r[0] is not None])
    assert cut[63][1] >= len(passage)
    plain = lambda out: Counter((i, sha((t or "").encode())) for i, t in out)
    assert plain(got["repeats"]) == Counter([(i, c[3]) for i, c in cut.items()]) + plain([r for r in rest if r[0] is None])

    assert len(got["personal_data"]) == len(got["repeats"])
    same = lambda out: plain([r for r in out if r[0] != 64])
    assert same(got["personal_data"]) == same(got["repeats"])
    assert MAIL in dict(got["repeats"])[64] and MAIL not in dict(got["personal_data"])[64]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in got["personal_data"]:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in packed:
        have[r.doc_id] += r.length
    assert have == want


def test_chain_is_one_class(documents, prose):
    """Each step is close to the next: one class, as by brute force."""
    rows = [(30 + k, edited(prose(7, 200), range(10, 10 + 8 * k, 8))) for k in range(9)]
    want = brute_classes(rows)
    assert set(want.values()) == {30}
    assert {r.row_id: r.class_id for r in minhash_dedup.classes(documents(rows)).collect()} == want
