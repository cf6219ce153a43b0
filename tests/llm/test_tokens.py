"""BPE codec and packing against the tokenizers library and by exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import *  # noqa: F403
from tokenizers import Tokenizer

from quotemill.llm import bpe_codec, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
RND = random.Random(4)
TEXTS = [
    "", None, "   ", "Hello, WORLD!! it's <|endoftext|> x<|startoftext|>y don't 'LL", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ²³ ½ Ⅷ é äb", "\x1c a\x1db \x85c d e​f",
    "日本語テキスト 12345 中文。 🙂🙂 " + "a" * 90, "a_b__c ___ --- ...!!??", "<|END|> <|", "مرحبا हिन्दी ไทย ỗŶǻዅ✃", "xyz" * 3000, "same words again " * 4000, "same text", "same text",
    *["".join(RND.choice("abcdeth'in s.é1") for _ in range(200)) for _ in range(60)],
    *["".join(chr(RND.randrange(0x20, 0x3100)) for _ in range(60)) for _ in range(60)],
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_and_decode_as_the_library(documents, library):
    df = documents([(None if k == 3 else k, t) for k, t in enumerate(TEXTS)])
    got = sorted((r.ids, r.decoded, r.n_tokens) for r in bpe_codec.encode_decode(df, PATH).collect())
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert got == sorted((" ".join(map(str, i)), library.decode(i, skip_special_tokens=False), len(i)) for i in ids)


def test_no_rows(documents):
    assert bpe_codec.encode_digests(documents([]), PATH).count() == 0
    assert packing.pack_documents(documents([]), PATH).count() == 0


def test_every_id_in_one_piece(documents, library):
    df = documents(list(enumerate(TEXTS)))
    rows = packing.pack_documents(df, PATH, with_ids=True).collect()
    for k, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in mine for i in r.ids] == ids and [r.start for r in mine] == [sum(m.length for m in mine[:j]) for j in range(len(mine))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.doc_tokens == len(ids) for r in mine)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:j]) for j in range(len(pieces))]
        n = sum(p.length for p in pieces)
        assert n == 4096 or n & (n - 1) == 0


@pytest.mark.parametrize("seed", range(5))
def test_limits_hold_together(seed):
    rnd = np.random.default_rng(seed)
    size = rnd.integers(1, 3000, 300)
    loss = np.minimum(size, rnd.integers(0, 1500, 300))
    limits = packing.Limits(tokens=1024, segments=5, loss_tokens=600)
    seen = {}
    for seq in packing.pack_block(size, loss, limits):
        assert sum(n for _, _, n in seq) <= 1024 and len(seq) <= 5
        assert sum(packing._loss(p, size, loss) for p in seq) <= 600
        for k, at, n in seq:
            seen.setdefault(k, []).append((at, n))
    for k, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) == size[k]
    assert len(seen) == 300
