"""Find secrets in texts: named patterns, and stretches whose characters are too evenly spread for words or numbers.

The second part slides a window over candidate strings, class of characters by class. The Shannon entropy of a window of W characters with counts c is
log2 W - (sum of c log2 c) / W; a step takes one character out and one in, so the sum changes by four terms of a table, and no window is counted anew.
The table holds whole numbers (terms times 2^32), so a window's verdict does not depend on where counting started. Long runs are cut into
segments of windows, and all segments of a batch take their steps together.

Windows that reach their class's entropy, and hold a digit and a letter, are united into spans. Spans that an allow-list explains (``ALLOWED``), and
spans inside a named pattern's match or inside a span of a narrower class, are not reported. Matches of named patterns are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Named patterns with what a match needs to count. Letters of ``assign``'s names stand in either case (ASCII only).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 6
#: ``AKIA[A-Z0-9]+`` of 20 characters and ``[0-9a-f]+`` of 24: runs of one class, so the shorter ones can be left out while matching.
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
#: One of these stands in every text with a match of ASSIGN, once ASCII letters are small.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

NAMED = ("assign", "access", "hex")

#: Characters of a candidate string; a window's length is the shortest candidate.
WINDOW = 20
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{%d,}" % WINDOW)


@dataclass(frozen=True)
class CharacterClass:
    """A kind of span: its characters, and the entropy in bits that a window of them must reach."""

    kind: str
    characters: str
    bits: float


_DIGITS, _SMALLS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: From narrow to wide. Random strings lie about 0.3 bits above: 20 hexadecimal digits at 3.4, letters and digits at 4.0. Words run to 3.4.
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", 3.0),
    CharacterClass("entropy_alnum", _DIGITS + _SMALLS + _SMALLS.upper(), 3.6),
    CharacterClass("entropy_base64", _DIGITS + _SMALLS + _SMALLS.upper() + "+/_=-", 3.75),
)

#: What explains an even spread: each is looked for around a span, and suppresses the spans it covers.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.)[A-Za-z0-9+/_=.:%&?#~-]+"),  # address
    re.compile(r"\d{4}-\d\d-\d\d[T_-]\d\d[:-]?\d\d[A-Za-z0-9:+.-]*"),  # time
    re.compile(r"(?:sha(?:1|256|384|512)|md5)[-:][A-Za-z0-9+/=]+"),  # digest named as such
    re.compile(r"(?:commit|revision)\x20+[0-9a-f]+"),  # version control
    re.compile(r"(?:[A-Za-z0-9_-]*(?:0123456789|abcdefghij|ABCDEFGHIJ))+[A-Za-z0-9+/_=-]*"),  # alphabets and counting
    re.compile(r"[A-Za-z0-9+/_=-]*(?i:example|placeholder|changeme|dummy|xxxx)[A-Za-z0-9+/_=-]*"),  # stand-ins
    re.compile(r"(?:/?[A-Za-z_-]+[0-9]{0,3}/)+[A-Za-z_-]+[0-9]{0,3}"),  # paths
    re.compile(r"[A-Za-z]+(?:[_-][A-Za-z]+)+[_-]?[0-9]{0,4}"),  # words joined by lines, with a number
)
#: Characters before and after a span within which an allowed pattern may start and end.
AROUND = 200

#: Windows of a segment, and segments that take their steps together.
SEGMENT, TOGETHER = 64, 100_000
_SCALE = 1 << 32


def named_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the matches of the named patterns, leftmost and not overlapping within a kind."""
    found = []
    small = text.encode("utf-8", "surrogatepass").translate(_SMALL)
    if any(w in small for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def even_windows(data: np.ndarray, cls: CharacterClass, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of united windows of a buffer that lie within runs of the class and reach its entropy, with a digit and a letter each."""
    symbol = np.full(256, -1, dtype=np.int16)
    for k, c in enumerate(cls.characters):
        symbol[ord(c)] = k
    codes = symbol[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]).astype(np.int8)))
    first, last = edges[0::2], edges[1::2]
    long_ = last - first >= window
    first, last = first[long_], last[long_]
    # segments: the first window, and how many windows follow it
    pieces = -((last - first - window + 1) // -SEGMENT)
    begin = np.repeat(first, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    windows = np.minimum(np.repeat(last, pieces) - begin - window + 1, SEGMENT)
    counts = np.arange(window + 2, dtype=np.float64)
    term = np.rint(counts * np.log2(np.maximum(counts, 1)) * _SCALE).astype(np.int64)
    most = int(np.floor(window * (np.log2(window) - cls.bits) * _SCALE))
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    letters = np.concatenate([[0], np.cumsum((data >= 65) & (data != 95))])  # of a run: all above the digits but the underscore
    good = np.zeros(len(data) + 1, dtype=bool)
    for part in np.array_split(np.arange(len(begin)), max(1, -(len(begin) // -TOGETHER))):
        at, n = begin[part], windows[part]
        held = np.zeros((len(part), len(cls.characters)), dtype=np.int16)
        total = np.zeros(len(part), dtype=np.int64)
        rows = np.arange(len(part))
        for step in range(window + SEGMENT - 1):
            if step >= window:
                # segments that have windows left lose the character their window starts with
                rows = rows[n[rows] > step - window + 1]
                if not len(rows):
                    break
                out = codes[at[rows] + step - window]
                c = held[rows, out]
                total[rows] += term[c - 1] - term[c]
                held[rows, out] = c - 1
            came = codes[at[rows] + step]
            c = held[rows, came]
            total[rows] += term[c + 1] - term[c]
            held[rows, came] = c + 1
            if step >= window - 1:
                hit = at[rows[total[rows] <= most]] + step - window + 1
                good[hit] = (digits[hit + window] > digits[hit]) & (letters[hit + window] > letters[hit])
    start = np.flatnonzero(good)
    if not len(start):
        return start, start
    # windows that overlap or touch are one span
    new = np.concatenate([[True], np.diff(start) > window])
    return start[new], np.concatenate([start[np.flatnonzero(new)[1:] - 1], start[-1:]]) + window


def explained(text: str, start: int, end: int) -> bool:
    """Whether an allowed pattern covers a span."""
    low = max(0, start - AROUND)
    around = text[low : end + AROUND]
    return any(m.start() + low <= start and m.end() + low >= end for p in ALLOWED for m in p.finditer(around))


def entropy_spans(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind's number, end) of every text's spans by entropy, kinds numbered after the named ones; allowed ones left out."""
    # candidates of all texts one after the other, with a character of no class between
    where, parts, size = [], [], 0
    for k, text in enumerate(texts):
        for m in CANDIDATE.finditer(text):
            where.append((size, k, m.start()))
            parts.append(m.group())
            size += m.end() - m.start() + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    data = np.frombuffer(" ".join(parts).encode("ascii"), dtype=np.uint8)
    offsets = np.array([w[0] for w in where], dtype=np.int64)
    for number, cls in enumerate(CLASSES, len(NAMED)):
        for start, end in zip(*(x.tolist() for x in even_windows(data, cls)), strict=True):
            base, k, at = where[int(np.searchsorted(offsets, start, side="right")) - 1]
            a, b = start - base + at, end - base + at
            if not any(s <= a and b <= e for s, _, e in out[k]) and not explained(texts[k], a, b):
                out[k].append((a, number, b))
    return out


SECRETS = "array<struct<kind:string,start:long,end:long>>"
KINDS = (*NAMED, *(c.kind for c in CLASSES))


def scan(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """(start, kind's number, end) of all secrets of each text, by start, then kind."""
    for text, even in zip(texts, entropy_spans(texts), strict=True):
        named = named_matches(text)
        yield sorted(named + [s for s in even if not any(a <= s[0] and s[2] <= b for a, _, b in named)])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``secrets``, spans in code points (end exclusive) by start, then kind in the order of KINDS.

    A null or empty text has none. Rows with a null or repeated id are rows like others; columns not named are not read, whatever they are
    called. Texts are read whole; the map needs no shuffle, and a batch of texts is all a worker holds.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found] for found in scan(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, made)], names=[id_col, "secrets"])

    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__body"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, secrets {SECRETS}")
