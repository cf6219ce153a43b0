"""Align the tokens of two tokenizers on the same texts, and count how often their entries end together over the whole corpus.

Both tokenizers cut the same bytes; a byte offset where a token of each ends is a shared cut. Cuts are found by divide and conquer, for all texts of a
group at a time (``shared_cuts``): an interval between two shared cuts is probed at its middle token of A, its end looked for among the ends of B by
bisection; without a match the search leaps on from the next end of the other side to the right, then to the left. A cut found splits the
interval in two; an interval without a cut inside is a leaf: one group of tokens that belong together.

Corpus-wide counts of linked id pairs have a bound that does not depend on the corpus: of two tokens that end together, the shorter one's bytes end
the longer one, so an entry of length n has at most n shorter partners, and there are at most as many pairs as both vocabularies have bytes
(about 0.6 million for the two files; ``pair_bound`` gives the number). Counts are combined map-side, summed by pair, checked
against the bound and sent to the workers once.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.staging import staged
from quotemill.llm.bpe_codec import groups
from quotemill.llm.wordbpe import RARE, byte_symbols

#: Characters of texts tokenised and aligned at a time (a longer text alone).
GROUP_CHARS = 400_000

#: A stretch of one sort of characters longer than this goes through the library, whose time does not grow with its square.
LONG_PIECE = regex.compile(r"\p{L}{2000}|\p{N}{2000}|[^\s\p{L}\p{N}]{2000}|\s{2000}")


class ByteBpe:
    """The byte-level side (A): ids as the ``tokenizers`` library gives them for a text, special strings as plain text.

    Where a file of the same vocabulary as ranks is named, texts of common characters are encoded by ``tiktoken``, which gives the same ids in a third of
    the time; texts with characters whose kinds differ between versions of Unicode, and very long pieces, go through ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = self.slow.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for entry, k in vocab.items():
            self.bytes[k] = bytes(map(byte.__getitem__, entry))
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(entry): int(k) for entry, k in map(bytes.split, f)}
            if all(self.bytes[k] == entry for entry, k in ranks.items()):
                self.fast = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            if RARE.search(t) or (len(t) >= 2000 and LONG_PIECE.search(t)):
                out.append(self.slow.encode(t, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(t))
        return out


class PieceBpe:
    """The sentence-piece side (B): its own leading blank stands for the one written before the text on side A."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode("utf-8")
            for k, piece in enumerate(self.model.id_to_piece(list(range(n))))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str, ranks_path: str | None, pattern: str | None) -> tuple[ByteBpe, PieceBpe]:
    """Both tokenizers, loaded once per worker."""
    return ByteBpe(a_path, ranks_path, pattern), PieceBpe(b_path)


def pair_bound(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """How many pairs of entries can ever end together: those of which one's bytes end the other's."""
    a_by, b_by = {}, {}
    for entries, by in ((a_bytes, a_by), (b_bytes, b_by)):
        for e in entries:
            by[e] = by.get(e, 0) + 1
    within = sum(n * b_by.get(e[-k:], 0) for e, n in a_by.items() for k in range(1, len(e) + 1))
    return within + sum(n * a_by.get(e[-k:], 0) for e, n in b_by.items() for k in range(1, len(e)))


def shared_cuts(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (sorted ends, strictly ascending) of all ends in both, within intervals of ``a``.

    ``low`` and ``high`` are places in ``a`` of ends known to be shared, one pair per text. All open intervals are probed together: each round halves
    them, so there are about log2 of the longest text's tokens rounds.
    """
    found = [low, high]
    while True:
        wide = high - low > 1
        low, high = low[wide], high[wide]
        if not len(low):
            break
        middle = (low + high) >> 1
        # to the right: the first shared end from the middle on; the upper border is one
        up = middle.copy()
        open_ = np.arange(len(up))
        while len(open_):
            end = a[up[open_]]
            near = b[np.searchsorted(b, end)]
            miss = near != end
            open_ = open_[miss]
            up[open_] = np.searchsorted(a, near[miss])
        cut = up < high
        # to the left, where the right half has none: the last shared end before the middle; the lower border is one
        down = middle - 1
        open_ = np.flatnonzero(~cut)
        while len(open_):
            end = a[down[open_]]
            near = b[np.searchsorted(b, end, side="right") - 1]
            miss = near != end
            open_ = open_[miss]
            down[open_] = np.searchsorted(a, near[miss], side="right") - 1
        left = ~cut & (down > low)
        found += [up[cut], down[left]]
        # right of the middle nothing is shared before ``up``: both halves of a cut interval go on, of one cut on the left only the left part
        low, high = np.concatenate([low[cut], up[cut], low[left]]), np.concatenate([up[cut], high[cut], down[left]])
        order = np.argsort(low)
        low, high = low[order], high[order]
    places = np.unique(np.concatenate(found))
    return places, np.searchsorted(b, a[places])


class Aligned:
    """Tokens of both sides of several texts, and the shared cuts of each."""

    def __init__(self, a_ids: list[list[int]], b_ids: list[list[int]], a_size: np.ndarray, b_size: np.ndarray):
        self.n_a = np.array([len(x) for x in a_ids], dtype=np.int64)
        self.n_b = np.array([len(x) for x in b_ids], dtype=np.int64)
        # each text starts with an end of its own on both sides, one byte after the last text
        self.a = self._chain(a_ids, self.n_a)
        self.b = self._chain(b_ids, self.n_b)
        a_ends = np.cumsum(np.where(self.a >= 0, a_size[self.a], 1))
        b_ends = np.cumsum(np.where(self.b >= 0, b_size[self.b], 1))
        self.a_first = np.concatenate([[0], np.cumsum(self.n_a + 1)[:-1]]).astype(np.int64)
        self.b_first = np.concatenate([[0], np.cumsum(self.n_b + 1)[:-1]]).astype(np.int64)
        self.at, self.bt = shared_cuts(a_ends, b_ends, self.a_first, self.a_first + self.n_a)
        inside = self.a[self.at] >= 0
        self.at, self.bt = self.at[inside], self.bt[inside]
        self.owner = np.searchsorted(self.a_first, self.at, side="right") - 1
        self.n_groups = np.bincount(self.owner, minlength=len(a_ids))

    @staticmethod
    def _chain(ids: list[list[int]], sizes: np.ndarray) -> np.ndarray:
        out = np.full(int(sizes.sum()) + len(ids), -1, dtype=np.int64)
        at = 0
        for x in ids:
            out[at + 1 : at + 1 + len(x)] = x
            at += len(x) + 1
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids that end together, one pair per shared cut, text by text."""
        return self.a[self.at], self.b[self.bt]

    def strings(self, a_names: tuple[list[str], list[str]], b_names: tuple[list[str], list[str]]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text, from the names of ids within a group and at its end."""
        a_last, b_last = np.zeros(len(self.a), dtype=bool), np.zeros(len(self.b), dtype=bool)
        a_last[self.at], b_last[self.bt] = True, True
        # the place of a token: all tokens of earlier groups, then A before B
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        b_done = np.concatenate([[0], self.bt + 1])  # tokens of B up to the end of each group
        a_done = np.concatenate([[0], self.at + 1])
        names = a_names[0] + a_names[1] + b_names[0] + b_names[1]
        n = len(a_names[0])
        code = np.full(len(self.a) + len(self.b), len(names), dtype=np.int64)
        code[np.arange(len(self.a)) + b_done[a_group]] = np.where(self.a >= 0, self.a + n * a_last, len(names))
        code[np.arange(len(self.b)) + a_done[np.minimum(b_group + 1, len(a_done) - 1)]] = np.where(self.b >= 0, 2 * n + self.b + len(b_names[0]) * b_last, len(names))
        # the ends that texts start with have no name
        pieces = list(map(names.__getitem__, code[code < len(names)].tolist()))
        out, at = [], 0
        for size in (self.n_a + self.n_b).tolist():
            out.append("".join(pieces[at : at + size])[:-1])
            at += size
        return out


def _names(n: int, end: str) -> tuple[list[str], list[str]]:
    return [f"{k}," for k in range(n)], [f"{k}{end}" for k in range(n)]


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``, ids in order) and ``links``
    (4 bytes each: both ids as unsigned 16-bit little-endian numbers, A first). With ``digests`` ``groups`` is its SHA-256, so that the long
    strings stay in the worker that makes them.

    A text that is null or empty, or whose tokens' bytes on either side are not those of a blank and the text, has no tokens: zeros, empty ``groups`` (not
    hashed) and ``links``. Rows with a null or repeated id are rows like others; columns not named are not read. Texts are taken whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"

    def run(batches):
        a_side, b_side = sides(a_path, b_path, ranks_path, pattern)
        if max(len(a_side.bytes), len(b_side.bytes)) > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        a_size, b_size = (np.array([len(e) for e in s.bytes], dtype=np.int64) for s in (a_side, b_side))
        a_names, b_names = _names(len(a_side.bytes), "|"), _names(len(b_side.bytes), ";")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in groups(texts, GROUP_CHARS):
                spaced = [" " + t for t in texts[x:y]]
                a_ids, b_ids = a_side.encode(spaced), b_side.encode(texts[x:y])
                for k, t in enumerate(spaced):
                    want = t.encode("utf-8")
                    if len(t) == 1 or b"".join(map(b_side.bytes.__getitem__, b_ids[k])) != want or b"".join(map(a_side.bytes.__getitem__, a_ids[k])) != want:
                        a_ids[k], b_ids[k] = [], []
                both = Aligned(a_ids, b_ids, a_size, b_size)
                strings = both.strings(a_names, b_names)
                a, b = both.links()
                packed = np.stack([a, b], axis=1).astype("<u2").tobytes()
                ends = np.concatenate([[0], np.cumsum(both.n_groups)]).tolist()
                n_groups = pa.array(both.n_groups, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(x, y - x),
                        pa.array(both.n_a, pa.int64()),
                        pa.array(both.n_b, pa.int64()),
                        n_groups,
                        n_groups,  # one pair of tokens ends at each shared cut
                        pa.array([hashlib.sha256(s.encode()).hexdigest() if s and digests else s for s in strings], pa.string()),
                        pa.array([packed[4 * p : 4 * q] for p, q in zip(ends, ends[1:])], pa.binary()),
                    ],
                    names=[id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )

    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__body"))
    return source.mapInArrow(run, schema)


def _keys(column: pa.Array) -> np.ndarray:
    """Links of a batch as one number each: A id times 2^16 plus B id."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").astype(np.int64)
    return (raw[0::2] << 16) | raw[1::2]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair of ids; ``pair`` is the A id times 65536 plus the B id."""

    def run(batches):
        for batch in batches:
            pair, n = np.unique(_keys(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """``aligned`` (a table that is read twice: write it before) with ``n_best``, the links whose count is the highest of their B id, ties included,
    and ``count_sum``, the counts of all links summed, in place of ``links``.

    ``counts`` (written before as well) goes to the workers whole: at most ``bound`` rows of 16 bytes, as the vocabularies give it (see ``pair_bound``).
    """
    spark = aligned.sparkSession
    if (found := counts.count()) > bound:
        raise ValueError(f"{found} id pairs are more than the vocabularies' {bound}")
    held = counts.toArrow()
    pair, n = np.asarray(held["pair"]), np.asarray(held["n"])
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    top = np.zeros(1 << 16, dtype=np.int64)
    np.maximum.at(top, pair & 0xFFFF, n)
    sent = spark.sparkContext.broadcast((pair, n, n == top[pair & 0xFFFF]))
    kept = [c for c in aligned.columns if c != "links"]
    fields = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        pair, n, best = sent.value
        for batch in batches:
            column = batch.column(len(kept))
            spot = np.searchsorted(pair, _keys(column))
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in column.to_pylist()])]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(v[spot].astype(np.int64))]) for v in (best, n)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *[pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]], names=[*kept, "n_best", "count_sum"]
            )

    return aligned.select(*[f"`{c}`" for c in kept], "links").mapInArrow(run, f"{fields}, n_best long, count_sum long")


def align_and_count(docs: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """``align`` with the corpus-wide counts of its links; the aligned table is written once and read twice."""
    a_side, b_side = sides(a_path, b_path, None, None)
    aligned = staged(align(docs, a_path, b_path, **options), "aligned")
    return with_counts(aligned, staged(pair_counts(aligned), "pairs"), pair_bound(a_side.bytes, b_side.bytes))
