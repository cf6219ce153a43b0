"""Secrets against plain matching and entropies counted window by window."""

import math
import random
import re
from collections import Counter

from conftest import *  # noqa: F403

from quotemill.llm import queries, secret_scan
from quotemill.llm.secret_scan import CLASSES, even_windows

RND = random.Random(3)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def random_string(letters, n):
    return "".join(RND.choice(letters) for _ in range(n))


def base(text):
    found = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text, re.I | re.A if k == 0 else 0):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def by_counting(text, cls):
    good = []
    for at in range(len(text) - 19):
        piece = text[at : at + 20]
        even = -sum(c / 20 * math.log2(c / 20) for c in Counter(piece).values())
        if all(c in cls.characters for c in piece) and even >= cls.bits and re.search("[0-9]", piece) and re.search("[A-Za-z]", piece):
            good.append(at)
    spans = []
    for at in good:
        if spans and at <= spans[-1][1]:
            spans[-1][1] = at + 20
        else:
            spans.append([at, at + 20])
    return [tuple(s) for s in spans]


def test_windows_equal_those_counted_anew():
    import numpy as np

    for letters, n in (("0123456789abcdef", 300), ("ab12", 200), (BASE64, 500), ("0123456789abcdef ", 400), ("abcABC123_ ", 300), (BASE64 + "     ", 2000)):
        text = random_string(letters, n)
        for cls in CLASSES:
            got = even_windows(np.frombuffer(text.encode(), dtype=np.uint8), cls)
            assert list(zip(*map(list, got))) == by_counting(text, cls)


def test_the_query(spark, documents, tmp_path, prose):
    keys = ["password = 'hunter2x'", "API_KEY:abc", "Secret=token:abcdefg", "passwd=secret=abcdef", "AKIA" + "Q" * 15, "AKIAAKIA" + "Z9" * 8, "f" * 24, "0" * 23, "toKen  =  x.y-z_1", "apikey\"='ABCDEF", "ſecret=abcdefgh"]
    texts = [" ".join([prose(k, 12), keys[k % len(keys)], "é🙂", keys[(k * 7) % len(keys)], random_string(BASE64, k)]) for k in range(60)]
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)] + [(100, None), (101, ""), (102, texts[5]), (102, texts[5]), (103, prose(1, 30000) + " token=" + "a" * 7)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op11_entropy_secrets"](spark, str(tmp_path)).collect()
    want = sorted(((d, base(t or "")) for d, t in rows), key=str)
    got = sorted(out, key=lambda r: str((r.doc_id, base(dict(rows)[r.doc_id] or ""))))
    names = list(PATTERNS)
    for r, (d, spans) in zip(got, want, strict=True):
        assert r.doc_id == d and [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r.base_sha256 == sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans))  # noqa: F405
        listed = [s for s in r.spans.split(",") if s]
        assert [s for s in listed if not s.startswith("entropy")] == [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        assert [int(s.split(":")[1]) for s in listed] == sorted(int(s.split(":")[1]) for s in listed)


def kinds(text):
    return [(secret_scan.KINDS[k], text[a:b]) for a, k, b in next(secret_scan.scan([text]))]


def test_random_strings_are_found_and_plain_ones_are_not():
    for letters, n in ((BASE64, 40), (BASE64[:62], 32), ("0123456789ABCDEF", 40)):
        hits = sum(any(k.startswith("entropy") for k, _ in kinds(f"the value {random_string(letters, n)} was sent")) for _ in range(200))
        assert hits >= 194
    for plain in (
        "donaudampfschifffahrtsgesellschaft kapitaensmuetze", "4995154084748072 49951540847480721234", "550e8400-e29b-41d4-a716-446655440000", "aaaaaaaaaaaaaaaaaaaaaaaa1",
        "see https://example.org/a/Qx7RkP2mZt9LwVb3Ny8Jh5Gd for more", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "0123456789abcdefghijklmnopqrstuvwxyz", "/usr/local/lib/python3/site-packages/numpy",
        "2024-05-06T07:08:09.123456Z", "getElementsByClassNameAndTag", "DUMMYkey9f8Xq2LmN4pR7sT1vW3y", "some_function_name_with_words_2",
    ):
        assert not [k for k in kinds(plain) if k[0].startswith("entropy")], plain


def test_allowed_texts_never_suppress_named_matches():
    assert [k for k, _ in kinds("https://host/?token=Qx7RkP2mZt9LwVb3Ny8Jh5Gd")] == ["assign"]
    assert kinds("commit 0123456789abcdef0123456789abcdef")[0][0] == "hex"


def test_empty_table(documents):
    assert secret_scan.find_secrets(documents([])).count() == 0
