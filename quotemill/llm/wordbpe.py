"""Word-level BPE with an end-of-word mark, encoded by a walk over a trie of distinct words.

The tokenizer file (a path parameter) gives vocabulary and merges. A text is normalised and cut into words as the file's
normaliser and pre-tokeniser say; each distinct word is then encoded once per worker, as long as its memory holds:

* The distinct words of an Arrow batch go into a trie whose edges are symbols (one byte of a word in its printable form).
* A depth-first walk carries, for every prefix on the path, the last token of that prefix's own encoding. BPE encodings are
  prefix-closed: cutting the last token off an encoding leaves the encoding of the shorter string. So the last token of a
  prefix is the one vocabulary entry ``t`` that ends there and may follow the last token of the prefix before ``t``. Prefixes
  shared by many words are solved once.
* ``t`` may follow ``s`` if and only if BPE on the two strings joined gives back ``s, t``: no merge crosses the border before
  the pieces on both sides have been taken up by merges of their own. That is decided by walking the right spine of the merge
  tree of ``s`` and the left spine of ``t``, and remembered per pair.

Decoding is the plain vocabulary lookup joined by one blank, as the tokenizers library does for a file without a decoder.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: The pieces the file's pre-tokeniser keeps, and its two special strings.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"

#: Distinct words remembered per worker; beyond that the memory goes on with the words in use (a matter of speed and memory,
#: not of results).
REMEMBERED = 800_000

#: Pairs of tokens of which it is remembered whether one may follow the other; beyond that the memory starts afresh.
PAIRS = 1_000_000

#: Characters outside the ranges whose letters, numbers and cases no longer change between versions of Unicode.
RARE = re.compile("[^\x00-\u0237\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u3000-\u3020\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")

SPACE = regex.compile(r"\s+", flags=regex.V1)

#: What the file's patterns take for white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Control characters that Python takes for white space and the file's patterns do not.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def ranges(kind: str) -> str:
    """The two-byte characters of a Unicode kind as the inside of a pattern's brackets."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    runs = (m.group() for m in regex.finditer(rf"\p{{{kind}}}+", plane))
    return "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in runs)


@lru_cache(maxsize=1)
def common_pieces() -> re.Pattern:
    """``PIECES`` for texts without rare characters, as a pattern of the faster standard module."""
    letters, numbers = ranges("L"), ranges("N")
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{WHITE}{letters}{numbers}]+")


class WordBpe:
    """Vocabulary, merges and the states of the walk over tries of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = self.vocab[a], self.vocab[b]
            z = self.vocab[a + b]
            self.rank[x, y] = r
            self.left[z], self.right[z], self.made[z] = x, y, r
        # vocabulary by symbols; the last symbol of a word carries the end mark
        self.by_symbols = {self.spelled(x): i for x, i in self.vocab.items() if i in self.made or len(self.spelled(x)) == 1}
        self.prefixes = {x[:k] for x in self.by_symbols for k in range(1, len(x) + 1)}
        self.read: list[tuple[str, ...]] = [()]
        self.state_of: dict[tuple[str, ...], int] = {(): 0}
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.symbols = byte_symbols()
        self.pieces = common_pieces().findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.byte_of = {c: b for b, c in enumerate(self.symbols)}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.odd: dict[str, list[str]] = {}
        self.follows: dict[tuple[int, int], bool] = {}

    @staticmethod
    def spelled(entry: str) -> tuple[str, ...]:
        body = entry.removesuffix(END)
        return (*body[:-1], body[-1] + END) if body != entry else tuple(entry)

    # -- words ---------------------------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """The file's normaliser: NFC, runs of white space to one blank, lower case letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-casing is per letter: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def cut(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        if not RARE.search(text):
            return self.pieces(self.normal(text))
        # no word and no normalisation step reaches across white space: only strings with a rare character go the slow way
        out: list[str] = []
        for c in text.split() if not ODD_SPACE.search(text) else SPACE.split(text):
            out += self._cut_odd(c) if RARE.search(c) else self.pieces(self.normal(c))
        return out

    def _cut_odd(self, chunk: str) -> list[str]:
        """Scripts in which Unicode versions differ on what is a letter: the library's own normaliser and pre-tokeniser."""
        got = self.odd.get(chunk)
        if got is None:
            if len(self.odd) >= REMEMBERED // 8:
                self.odd.clear()
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            got = self.odd[chunk] = [bytes(map(self.byte_of.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in pieces]
        return got

    def words(self, text: str) -> list[str]:
        """Words of a text in order; special strings come out as themselves."""
        if "<|" not in text:
            return self.cut(text)
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                out.append(part)
            else:
                out += self.cut(part)
        return out

    # -- trie ----------------------------------------------------------------------------------------------------

    def may_follow(self, s: int, t: int) -> bool:
        key = (s, t)
        got = self.follows.get(key)
        if got is None:
            got = self.follows[key] = not self._crossed(s, t)
        return got

    def _crossed(self, s: int, t: int) -> bool:
        """Does a merge join pieces of both sides before each is taken up by its own side?"""
        never = len(self.made) + 1
        x, x_until = s, never
        while True:
            y, y_until = t, never
            while True:
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return True
                if y not in self.left:
                    break
                y, y_until = self.left[y], self.made[y]
            if x not in self.right:
                return False
            x, x_until = self.right[x], self.made[x]

    def encode(self, words) -> Iterator[tuple[str, list[int]]]:
        """Each of the given distinct words with its ids, all from one walk over their trie."""
        if len(self.follows) > PAIRS:
            self.follows.clear()
        table = self.symbols
        yield from ((w, [self.special[w]]) for w in words if w in self.special)
        fresh = sorted(("".join(map(table.__getitem__, w.encode("utf-8", "surrogateescape"))), w) for w in words if w not in self.special)
        # The sorted words are the trie in depth-first order: going to the next word means going back to the node of the
        # common prefix, whose state is still on the stacks, and down from there.
        last: list[int] = []  # last token of the encoding of each prefix on the path
        size: list[int] = []  # symbols of that token
        where: list[int] = [0]  # which vocabulary entries may still be growing at the end of each prefix
        before = ""
        step, ends, follows, may = self.step, self.ends, self.follows, self.may_follow
        for word, spoken in fresh:
            stop = len(word) - 1
            common = 0
            limit = min(len(before), stop, len(last))
            while common < limit and before[common] == word[common]:
                common += 1
            del last[common:], size[common:], where[common + 1 :]
            state = where[common]
            for end in range(common, stop):
                state = step[state].get(word[end], -1)
                if state < 0:
                    state = self._grow(where[end], word[end])
                for n, t in ends[state]:
                    if n > end:
                        break
                    s = last[end - n]
                    ok = follows.get((s, t))
                    if ok or ok is None and may(s, t):
                        break
                last.append(t)
                size.append(n)
                where.append(state)
            final = word[stop] + END
            state = step[state].get(final, -1)
            if state < 0:
                state = self._grow(where[stop], final)
            for n, t in ends[state]:
                if n > stop or may(last[stop - n], t):
                    break
            ids = [t]
            start = stop + 1 - n
            while start:
                ids.append(last[start - 1])
                start -= size[start - 1]
            ids.reverse()
            yield spoken, ids
            before = word

    def _grow(self, state: int, symbol: str) -> int:
        """The state after one more symbol: the longest end of what was read that begins some vocabulary entry. Made when first met."""
        read = (*self.read[state], symbol)
        while read and read not in self.prefixes:
            read = read[1:]
        got = self.state_of.get(read)
        if got is None:
            got = self.state_of[read] = len(self.read)
            self.read.append(read)
            self.step.append({})
            tails = (read[k:] for k in range(len(read)))
            self.ends.append([(len(x), self.by_symbols[x]) for x in tails if x in self.by_symbols])
        self.step[state][symbol] = got
        return got


class Remembered:
    """What ``make(ids)`` gives for each word, solved a batch of texts at a time."""

    def __init__(self, bpe: WordBpe, make):
        self.bpe, self.make = bpe, make
        self.made: dict[str, object] = {}

    def look_up(self, texts: list[str]) -> Iterator[list]:
        """The values of the words of each text, in order."""
        cut = [self.bpe.words(t) for t in texts]
        used = set().union(*cut)
        made, make = self.made, self.make
        fresh = [w for w in used if w not in made]
        if len(made) + len(fresh) > REMEMBERED:
            # go on with what this batch uses: frequent words stay, rare ones are solved again when met
            made = self.made = {w: made[w] for w in used if w in made}
        made.update((w, make(ids)) for w, ids in self.bpe.encode(fresh))
        get = made.__getitem__
        return (list(map(get, ws)) for ws in cut)


_remembered: dict[tuple[str, str], Remembered] = {}


def remembered(path: str, kind: str, make_for) -> Remembered:
    """The memory of this worker for one file and kind of value; a worker keeps it from task to task. ``make_for(bpe)`` gives ``make``."""
    if (path, kind) not in _remembered:
        bpe = tokenizer(path)
        _remembered[path, kind] = Remembered(bpe, make_for(bpe))
    return _remembered[path, kind]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One per worker and file."""
    return WordBpe(path)


def forget() -> None:
    """Give the memories of this worker back: for tasks of another kind that run in the same worker later."""
    _remembered.clear()
    tokenizer.cache_clear()
