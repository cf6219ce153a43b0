"""Alignment against plain sets of ends, and the query against both libraries."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from conftest import *  # noqa: F403
from tokenizers import Tokenizer

from quotemill.llm import queries, token_alignment
from quotemill.llm.token_alignment import Aligned, ByteBpe, pair_bound, shared_cuts, sides

A, B, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
RND = random.Random(8)


def test_shared_cuts_equal_sets():
    for seed in range(300):
        rnd = np.random.default_rng(seed)
        n = int(rnd.integers(1, 120))
        a = np.unique(np.append(rnd.integers(0, n, int(rnd.integers(0, n + 1))), [0, n]))
        b = np.unique(np.append(rnd.integers(0, n, int(rnd.integers(0, n + 1))), [0, n]))
        at, bt = shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        assert a[at].tolist() == b[bt].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def plain(a_ids, b_ids, a_len, b_len):
    """Groups from sets of ends."""
    a_ends, b_ends = np.cumsum([a_len[x] for x in a_ids]).tolist(), np.cumsum([b_len[x] for x in b_ids]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        p, q = a_ends.index(cut) + 1, b_ends.index(cut) + 1
        groups.append((a_ids[i:p], b_ids[j:q]))
        i, j = p, q
    return groups


def test_many_texts_at_once_some_without_tokens():
    size = np.array([1, 2, 3, 4, 5])
    for seed in range(100):
        rnd = random.Random(seed)
        a_all, b_all = [], []
        for _ in range(rnd.randint(1, 9)):
            a = [rnd.randrange(5) for _ in range(rnd.randint(0, 12))]
            total = sum(x + 1 for x in a)
            b = []
            while total:
                b.append(rnd.randrange(min(5, total)))
                total -= b[-1] + 1
            a_all.append(a)
            b_all.append(b)
        both = Aligned(a_all, b_all, size, size)
        names = token_alignment._names(5, "|"), token_alignment._names(5, ";")
        want = [plain(a, b, size, size) for a, b in zip(a_all, b_all)]
        assert both.strings(*names) == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in want]
        assert list(zip(*map(list, both.links()))) == [(x[-1], y[-1]) for g in want for x, y in g]
        assert both.n_groups.tolist() == list(map(len, want))


def test_ranks_give_the_ids_of_the_library():
    side = ByteBpe(A, RANKS, public_tokenizers.PATTERN)
    assert side.fast
    texts = [" " + "".join(chr(RND.choice([RND.randrange(32, 127), RND.randrange(9, 14), RND.randrange(0x80, 0x250), RND.randrange(0x390, 0x460), RND.randrange(0x2000, 0x3100), RND.randrange(0x4E00, 0x4F00), 0x20, 0x20, 39, 115, 0x1C, 0x85, 0xA0])) for _ in range(RND.randrange(200))) for _ in range(2000)]
    texts += [" <|endoftext|> a<|endoftext|>", " " + "a" * 100_000, " " + " " * 30_000, " " + "!?" * 20_000, " 7" * 5000, " \n\n \t x"]
    assert side.encode(texts) == [e.ids for e in side.slow.encode_batch(texts, add_special_tokens=False)]


def test_the_query(spark, documents, tmp_path, prose):
    texts = [
        None, "", " ", "  two  blanks ", "\n\n\tx\r\n", "it's <|endoftext|> <s></s> <unk> <0x41>", "a▁b", "日本語 text 🙂🙂 ỗ", "café naïve Straße", "\x00nul\x01", "ﬁne ½ ²", "x" * 3000, "é combining",
        "the cat " * 400, "same text", "same text", *[prose(k, 40) for k in range(30)], *["".join(chr(RND.randrange(0x20, 0x3100)) for _ in range(50)) for _ in range(30)],
    ]
    rows = [(None if k == 9 else 14 if k == 15 else k, t) for k, t in enumerate(texts)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_token_alignment"](spark, str(tmp_path)).collect()
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    a_side, b_side = sides(A, B, None, None)
    want, count = [], Counter()
    for d, t in rows:
        a, b = a_lib.encode(" " + (t or ""), add_special_tokens=False).ids, b_lib.encode(t or "")
        whole = (" " + (t or "")).encode()
        if not t or b"".join(a_side.bytes[x] for x in a) != whole or b"".join(b_side.bytes[x] for x in b) != whole:
            a, b = [], []
        groups = plain(a, b, [len(x) for x in a_side.bytes], [len(x) for x in b_side.bytes])
        links = [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        want.append((d, a, b, groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows_ = []
    for d, a, b, groups, links in want:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows_.append((d, len(a), len(b), len(groups), len(links), sha(text) if text else "", sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links)))  # noqa: F405
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(rows_, key=str)
    assert sum(bool(r.n_a) for r in got) > 50


def test_pairs_are_bounded_by_the_vocabularies():
    assert pair_bound([b"a", b"ba"], [b"a", b"cba", b"x"]) == 4  # a-a, ba-a, a-cba, ba-cba
    a_side, b_side = sides(A, B, None, None)
    assert pair_bound(a_side.bytes, b_side.bytes) < 1_000_000


def test_empty_table(documents):
    out = token_alignment.align_and_count(documents([]), A, B)
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
