"""Periodic runs of words: stretches that repeat with their smallest period q over at least max(6, 4 q) words.

The method is an online sparse dynamic program over diagonals. The diagonal of lag q holds, while words are read from left to right, how many
words in a row equal the word q places before. Each word lets its earlier occurrences carry their diagonals on; a diagonal that is not
carried on ends, and one that ends with max(6 - q, 3 q) matches or more emits its run at once.

Following every earlier occurrence of a word costs the square of its count, so only diagonals that can still become runs are opened,
without losing one (``openings``):

* A diagonal of lag q long enough starts with a phrase of L words (L <= max(6 - q, 3 q)) that also stands q words before.
* With L >= 2 q, the phrase at the start of a run of smallest period q does not stand again in between: two occurrences less than q apart
  would give the run the greatest common divisor of both distances as a period. So only the nearest earlier occurrence counts, and lags that are
  multiples of a run's period are never opened.
* The lags from 3 (L / 9) to L / 2 share the phrase length L; lengths grow by half from step to step, so a word opens one diagonal a
  step at most. The number of a phrase comes from those of the two shorter phrases that cover it (exact, no hashes), and only places whose shorter
  phrases occur twice in the document stay in the race: for prose the first step leaves next to nothing.

Work grows as words times the logarithm of the longest repeat, whatever the text. Texts are independent: a map over the table, no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.bpe_codec import groups

SHORTEST, REPEATS = 6, 4
FIRST_PHRASE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def needed(lag: int) -> int:
    """Matches that a diagonal needs for its run to be long enough."""
    return max(SHORTEST - lag, (REPEATS - 1) * lag)


def phrase_lengths(longest: int):
    """(length, smallest lag, largest lag) of each step, for texts of up to ``longest`` words. Every lag occurs once; a length is at most
    twice the one before."""
    yield FIRST_PHRASE, 1, 2
    yield 9, 3, 4
    lag = 5
    while 4 * lag <= longest:
        length = 3 * lag
        yield length, lag, length // 2
        lag = length // 2 + 1


def _ranked(key: np.ndarray, places: np.ndarray):
    """Numbers of equal keys, whether a key occurs again, and the nearest earlier place with the same key (-1: none)."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)]) if len(key) else np.zeros(0, dtype=np.int64)
    before = np.full(len(key), -1, dtype=np.int64)
    before[order[1:]] = np.where(same, places[order[:-1]], -1)
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return rank, again, before


def openings(words: np.ndarray, text: np.ndarray, first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags at which a diagonal that can become a run starts, in order of places.

    ``words`` are numbers of the words of several texts one after the other, each text followed by a number that occurs nowhere else;
    ``text`` is the number of each place's text and ``first`` the first place of each text.
    """
    n = len(words) - FIRST_PHRASE + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 1:
        return none, none
    # equal phrases have equal hashes: what occurs once by hash occurs once
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * _ODD
        mixed ^= mixed >> np.uint64(29)
        hashed = text[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(FIRST_PHRASE):
            hashed = (hashed ^ (hashed >> np.uint64(31))) * _ODD + mixed[k : k + n]
    in_order = np.sort(hashed)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return none, none
    spot = np.minimum(np.searchsorted(twice, hashed), len(twice) - 1)
    places = np.flatnonzero(twice[spot] == hashed)
    # numbers of the first phrases, word by word
    number = text[places].astype(np.int64)
    most = int(words.max()) + 1
    for k in range(FIRST_PHRASE):
        key = number * most + words[places + k]
        number, again, before = _ranked(key, places)
    known = np.full(len(words) + 1, -1, dtype=np.int64)
    at, lags, had = [], [], FIRST_PHRASE
    for length, low, high in phrase_lengths(longest):
        if length > FIRST_PHRASE:
            step = length - had
            inside = places + step < len(words)
            places = places[inside]
            tail = known[places + step]
            places, tail = places[tail >= 0], tail[tail >= 0]
            number, again, before = _ranked(known[places] * len(words) + tail, places)
            known[:] = -1
            had = length
        lag = places - before
        fits = (before >= 0) & (lag >= low) & (lag <= high)
        here, lag = places[fits], lag[fits]
        # the diagonal starts here, not earlier
        starts = (here - lag == first[text[here]]) | (words[here - 1] != words[here - 1 - lag])
        at.append(here[starts])
        lags.append(lag[starts])
        known[places[again]] = number[again]
        places = places[again]
        if not len(places):
            break
    at, lags = np.concatenate(at), np.concatenate(lags)
    order = np.lexsort((lags, at))
    return at[order], lags[order]


def runs_of(words: list[int], opened: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period: the diagonals read online, from left to right."""
    found: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag -> place of the first match
    n, nxt, at = len(words), 0, 0
    while active or nxt < len(opened):
        if not active:
            at = opened[nxt][0]
        ended = [lag for lag in active if at == n or words[at] != words[at - lag]]
        for lag in ended:
            begun = active.pop(lag)
            if at - begun >= needed(lag):
                found.append((begun - lag, at - begun + lag, lag))
        while nxt < len(opened) and opened[nxt][0] == at:
            if opened[nxt][1] not in active and words[at] == words[at - opened[nxt][1]]:
                active[opened[nxt][1]] = at
            nxt += 1
        at += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as lists of words."""
    numbers = defaultdict(count().__next__)
    parts = [list(map(numbers.__getitem__, words)) for words in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = np.fromiter((x for k, p in enumerate(parts) for x in (*p, len(numbers) + k)), dtype=np.int64, count=int(sizes.sum()))
    text = np.repeat(np.arange(len(parts)), sizes)
    at, lags = openings(words, text, first, int(sizes.max(initial=1)) - 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    owner = text[at]
    for k in np.unique(owner).tolist():
        a, b = np.searchsorted(owner, [k, k + 1])
        out[k] = runs_of(parts[k], list(zip((at[a:b] - first[k]).tolist(), lags[a:b].tolist(), strict=True)))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``runs`` (by start and period; starts count words from 0) and ``collapsed``: the words
    that no run holds after its first period, joined by one blank.

    Words are separated by the ASCII blanks (space, tab to carriage return) alone. A null text counts as empty: no words, no runs, empty
    ``collapsed``. Rows with a null or repeated id are rows like others; columns not named are not read, whatever they are called. Texts
    are read whole, whatever their length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs {RUN}, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                words = [t.split() for t in texts[a:b]]  # of bytes: the ASCII blanks
                runs = find_runs(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(map(len, words), pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], run_type),
                        pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=[id_col, "n_words", "runs", "collapsed"],
                )

    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("__body"))
    return source.mapInArrow(run, schema)


def strongest(runs):
    """The run with the greatest length / period, compared exactly; of equals the first by start and period. Null without runs."""
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.reduce(runs, F.get(runs, F.lit(0)), better)
