"""Remove every byte that a repeated string covers: exact duplicate passages of at least ``LENGTH`` bytes, over all documents.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller id, or same document, earlier start). The suffix
array is never built over the whole corpus; only suffixes that can take part in a repeat are sorted:

1. Every window of LENGTH bytes names one anchor, the position of the smallest hash among its GRAM-byte strings (a minimiser).
   Equal windows name anchors at equal places, so windows are split among anchors, about one anchor per 30 bytes.
2. Anchors whose string occurs once in the corpus are dropped (map-side combined counts, then a join Spark can split where
   a key is hot).
3. Each remaining anchor has a super-window, the bytes of all windows that named it. Of equal ones among the documents of a batch only the first goes on;
   the others are repeated whole (compared byte by byte), so a passage that many documents share is sent about once a batch. What goes on meets at the
   anchor's hash. There the suffixes that start at the anchors are merge-sorted; two suffixes are compared by their longest common extension, found by binary search
   over prefix polynomial hashes (log of the length per comparison) and verified byte by byte for neighbours, so that a
   collision is noticed and sorted out exactly. The same is done to the left. Two windows at distance d from their anchors are
   equal iff the right extensions agree on LENGTH - d bytes and the left ones on d: runs in the two orders.
   The earliest of each set of equal windows stays, the others are marked in a bit mask per anchor.
4. Masks meet their document, become runs and are cut out.

Exact copies of a whole document are handled before: all but the first are removed whole (or kept whole below LENGTH bytes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.staging import discard, staged
from quotemill.llm.components import narrowed, without
from quotemill.llm.rolling import FIRST, mix

LENGTH, GRAM = 100, 40
SPAN = LENGTH - GRAM + 1  # grams in a window; distances fit into a 64-bit mask
#: Bytes hashed at a time (a longer document is hashed alone).
CHUNK = 200_000
#: Bytes of super-windows that later ones of a batch are compared with; beyond that the comparison starts afresh (a matter of memory, not of results).
COMPARED = 2_000_000


def anchors(data: np.ndarray, starts: np.ndarray):
    """Anchors of the windows of each document in a buffer: positions, hashes, first window and number of windows."""
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return empty, np.zeros(0, dtype=np.uint64), empty, empty
    prefix = FIRST.prefix(data)
    value = mix(FIRST.windows(prefix, GRAM))
    low, at = value, np.arange(len(value), dtype=np.int32)
    width = 1
    while width < SPAN:  # smallest of SPAN neighbours by doubling; the leftmost of equals
        shift = min(width, SPAN - width)
        take = low[shift:] < low[: len(low) - shift]
        at = np.where(take, at[shift:], at[: len(at) - shift])
        low = np.where(take, low[shift:], low[: len(low) - shift])
        width += shift
    windows = n - LENGTH + 1
    at = at[:windows]
    ends = np.append(starts[1:], n)
    inside = np.ones(windows + 1, dtype=bool)
    for e in ends:  # windows that cross the end of a document
        inside[max(0, e - LENGTH + 1) : e] = False
    inside[windows] = False
    edge = np.empty(windows + 1, dtype=bool)
    edge[0] = True
    edge[1:windows] = at[1:] != at[:-1]
    edge[windows] = True
    edge[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(edge)
    count = np.diff(first)
    first = first[:-1]
    keep = inside[first]
    first, count = first[keep], count[keep]
    where = at[first].astype(np.int64)
    return where, value[where], first, count


def _buffers(texts: list[bytes]):
    """Groups of consecutive texts as (first text, buffer, starts)."""
    k = 0
    while k < len(texts):
        size, stop = 0, k
        while stop < len(texts) and (stop == k or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        lengths = np.array([len(t) for t in texts[k:stop]], dtype=np.int64)
        yield k, np.frombuffer(b"".join(texts[k:stop]), dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        k = stop


#: What a row is told by: its id, or, where ids repeat, its id and its place among the rows of that id. The order of documents is the order of these.
_ALONE, _NTH = "long", "struct<row_id:long,nth:int>"
_FOUND = "array<struct<at:int,mask:long>>"


def _anchor_rows(batches):
    """(anchor string's hash, document, position) of every anchor."""
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1).to_pylist()
        for k, data, starts in _buffers(texts):
            where, value, _, _ = anchors(data, starts)
            doc = np.searchsorted(starts, where, side="right") - 1
            # several empty texts share a start: the last one before a position is the one that holds it
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), rows.take(pa.array(k + doc)), pa.array((where - starts[doc]).astype(np.int32))], names=["anchor", "row", "at"]
            )


def _whole(windows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Masks with the distances of all windows: lead - windows + 1 .. lead."""
    return ((np.int64(1) << windows) - 1) << (lead - windows + 1)


def _found(at: np.ndarray, mask: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of (at, mask); list n holds what lies between ends n and n + 1."""
    pairs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(mask)], names=["at", "mask"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)


def _order(rows: pa.Array) -> np.ndarray:
    """Places of rows in the order of documents."""
    if pa.types.is_struct(rows.type):
        return np.lexsort((np.asarray(rows.field("nth")), np.asarray(rows.field("row_id"))))
    return np.argsort(np.asarray(rows), kind="stable")


def _super_windows(batches):
    """The bytes of all windows of each repeated anchor, unless an earlier one of the batch equals them: then the document's list names the anchor with all
    its windows. One row per anchor that goes on, one per document with such a list."""
    for batch in batches:
        # in order of documents, so that the first of equals is the earliest
        table = pa.Table.from_batches([batch])
        table = table.take(pa.array(_order(table.column(0).combine_chunks())))
        rows, texts, wanted = table.column(0).combine_chunks(), table.column(1).to_pylist(), table.column(2).to_pylist()
        seen: set[tuple[int, bytes]] = set()
        held = 0
        for k, data, starts in _buffers(texts):
            where, value, first, count = anchors(data, starts)
            places = np.sort(np.concatenate([np.asarray(w, dtype=np.int64) + s for w, s in zip(wanted[k : k + len(starts)], starts, strict=True)]))
            spot = np.searchsorted(where, places)
            where, value, first, count = where[spot], value[spot], first[spot], count[spot]
            doc = np.searchsorted(starts, where, side="right") - 1
            lead, at = where - first, (where - starts[doc]).astype(np.int32)
            raw = data.tobytes()
            strings = [raw[a : a + c + LENGTH - 1] for a, c in zip(first.tolist(), count.tolist(), strict=True)]
            fresh = np.ones(len(strings), dtype=bool)
            for n, key in enumerate(zip(lead.tolist(), strings, strict=True)):
                if key in seen:
                    fresh[n] = False
                else:
                    if held > COMPARED:
                        seen.clear()
                        held = 0
                    seen.add(key)
                    held += len(key[1])
            go = np.flatnonzero(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value[go].view(np.int64)), rows.take(pa.array(k + doc[go])), pa.array(at[go]), pa.array(lead[go].astype(np.int32)),
                    pa.array([strings[n] for n in go.tolist()], pa.binary()), pa.nulls(len(go), pa.list_(pa.struct([("at", pa.int32()), ("mask", pa.int64())]))),
                ],
                names=["h", "row", "at", "lead", "bytes", "found"],
            )
            stay = np.flatnonzero(~fresh)
            if len(stay):
                holders, begin = np.unique(doc[stay], return_index=True)
                found = _found(at[stay], _whole(count[stay], lead[stay]), np.append(begin, len(stay)))
                n = len(holders)
                yield pa.RecordBatch.from_arrays(
                    [
                        # dealt out like any other value
                        pa.array(mix((k + holders).astype(np.uint64) ^ value[stay[begin]]).view(np.int64)), rows.take(pa.array(k + holders)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()), found,
                    ],
                    names=["h", "row", "at", "lead", "bytes", "found"],
                )


class _Suffixes:
    """Suffixes of a buffer, each with a limit on how far it reaches, compared through prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = FIRST.prefix(data)

    def extension(self, a, b, most):
        """Common extension of pairs of positions. A claim by hash is checked against the bytes; on a collision the bytes decide."""
        got = FIRST.common(self.prefix, a, b, most)
        span = int(got.max(initial=0))
        if span:
            steps = np.arange(span)
            for part in np.array_split(np.arange(len(a)), max(1, len(a) * span // 400_000)):
                inside = steps < got[part, None]
                # a hash that agrees on a longer string than the bytes do is a collision
                wrong = inside & (self.data[np.minimum(a[part, None] + steps, len(self.data) - 1)] != self.data[np.minimum(b[part, None] + steps, len(self.data) - 1)])
                bad = wrong.any(axis=1)
                if bad.any():
                    got[part[bad]] = wrong[bad].argmax(axis=1)
        return got

    def compare(self, a, la, b, lb):
        """Negative, zero or positive: how suffix a (of length la) compares with suffix b. A proper prefix is smaller."""
        most = np.minimum(la, lb)
        same = FIRST.common(self.prefix, a, b, most)
        last = len(self.data) - 1
        byte = self.data[np.minimum(a + same, last)].astype(np.int64) - self.data[np.minimum(b + same, last)]
        return np.where(same >= most, la - lb, byte)

    def sort(self, at, length, group):
        """Merge sort within groups (equal consecutive numbers), bottom up; every level merges all pairs of runs at once. Stable."""
        n = len(at)
        order = np.arange(n)
        begin = np.searchsorted(group, group, side="left")  # first row of the group of each row
        size = np.searchsorted(group, group, side="right") - begin
        width = 1
        while width < size.max(initial=0):
            place = np.arange(n) - begin
            run = place // width
            other = begin + (run ^ 1) * width  # start of the sister run
            other_end = np.minimum(other + width, begin + size)
            moves = (size > width) & (other < other_end)
            rows = np.flatnonzero(moves)
            low, high = other[rows].copy(), other_end[rows].copy()
            right = (run[rows] & 1).astype(bool)
            me, my_length = at[order[rows]], length[order[rows]]
            while True:  # how many of the sister run come before each row
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                it, its = at[order[middle]], length[order[middle]]
                sign = self.compare(it, its, me[open_], my_length[open_])
                before = (sign < 0) | (right[open_] & (sign == 0))  # of equal suffixes the left run's come first
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            ahead = low - other[rows]
            merged = np.arange(n)
            own = place[rows] % width
            merged[rows] = begin[rows] + (run[rows] & ~1) * width + own + ahead
            fresh = order.copy()
            fresh[merged] = order
            order = fresh
            width *= 2
        return order


def repeated_windows(strings: list[bytes], lead: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For super-windows sorted by group and, within it, by document and position: a mask per row of the distances from the anchor
    at which its window equals that of an earlier row of the group."""
    # equal super-windows are repeated whole: only the first of each is sorted
    seen: dict[tuple[int, int, bytes], int] = {}
    first = np.array([seen.setdefault(k, n) for n, k in enumerate(zip(group.tolist(), lead.tolist(), strings, strict=True))], dtype=np.int64)
    alone = np.flatnonzero(first == np.arange(len(strings)))
    if len(alone) < len(strings):
        mask = np.empty(len(strings), dtype=np.int64)
        mask[alone] = repeated_windows([strings[k] for k in alone], lead[alone], group[alone])
        again = np.flatnonzero(first != np.arange(len(strings)))
        mask[again] = _whole(np.array([len(strings[k]) for k in again], dtype=np.int64) - LENGTH + 1, lead[again])
        return mask
    n = len(strings)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    anchor = starts + lead
    right = _Suffixes(data)
    reach = np.minimum(starts + sizes - anchor, LENGTH)
    by_right = right.sort(anchor, reach, group)
    left = _Suffixes(np.ascontiguousarray(data[::-1]))
    mirrored = len(data) - anchor  # reading to the left of the anchor
    back = np.minimum(lead, LENGTH).astype(np.int64)
    by_left = left.sort(mirrored, back, group)

    def neighbours(suffixes, order, at, length):
        a, b = order[:-1], order[1:]
        same = suffixes.extension(at[a], at[b], np.minimum(length[a], length[b]))
        return np.where(group[a] == group[b], same, -1)

    right_common = neighbours(right, by_right, anchor, reach)
    left_common = neighbours(left, by_left, mirrored, back)
    mask = np.zeros(n, dtype=np.int64)
    right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    windows = sizes - LENGTH + 1
    furthest, nearest = lead, lead - windows + 1  # distances of the first and the last window
    for d in range(SPAN):
        rows = np.flatnonzero((nearest <= d) & (d <= furthest))
        if len(rows) < 2:
            continue
        right_class[by_right] = np.concatenate([[0], np.cumsum(right_common < LENGTH - d)])
        left_class[by_left] = np.concatenate([[0], np.cumsum(left_common < d)])
        key = right_class[rows] * (n + 1) + left_class[rows]
        order = np.argsort(key, kind="stable")
        again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        mask[rows[order[again]]] |= np.int64(1) << np.int64(d)
    return mask


def _sort_and_mark(batches):
    """(row, found): masks of repeated windows, a bounded number of whole groups at a time; rows come sorted by group, document, position. Lists that are there
    already are handed on."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(t: pa.Table):
        group = np.unique(np.asarray(t["h"]), return_inverse=True)[1]
        # equal numbers must be consecutive: rows are sorted by h, and so are its ranks
        mask = repeated_windows(t["bytes"].to_pylist(), np.asarray(t["lead"]).astype(np.int64), group)
        hit = np.flatnonzero(mask)
        rows = t["row"].combine_chunks().take(pa.array(hit))
        return pa.RecordBatch.from_arrays([rows, _found(np.asarray(t["at"])[hit], mask[hit], np.arange(len(hit) + 1))], names=["row", "found"])

    for batch in batches:
        known = batch.column(5).is_valid()
        if known.true_count:
            yield batch.filter(known).select(["row", "found"])
            batch = batch.filter(batch.column(5).is_null())
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= 8_000:
            t = pa.Table.from_batches(held)
            key = np.asarray(t["h"])
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:  # the last group may go on in the next batch
                yield work(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                size = t.num_rows - cut
    if held:
        yield work(pa.Table.from_batches(held))


def _finish(keep_bytes: bool, carried: list[str]):
    def run(batches):
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1).to_pylist()
            ids = rows.field("row_id") if pa.types.is_struct(rows.type) else rows
            copies = batch.column(2).to_pylist()
            marks = batch.column(3).to_pylist()
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, copy, found in zip(texts, copies, marks, strict=True):
                data = text
                n_bytes.append(len(data))
                if copy and len(data) >= LENGTH:
                    n_removed.append(len(data))
                    n_spans.append(1)
                    rest = b""
                elif found and not copy:
                    at = np.array([f["at"] for f in found], dtype=np.int64)
                    mask = np.array([f["mask"] for f in found], dtype=np.int64)
                    start = np.concatenate([at[(mask >> d) & 1 == 1] - d for d in range(SPAN)])
                    edge = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + LENGTH, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    rest = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                    rest = data
                kept.append(rest.decode("utf-8", "ignore") if keep_bytes else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string()), *batch.columns[4:]],
                names=["row_id", "n_bytes", "n_removed", "n_spans", "kept", *carried],
            )

    return run


def numbered(source: DataFrame) -> tuple[DataFrame, str]:
    """``source`` with ``row`` in place of ``row_id``, and the type of ``row``: the id, or where ids repeat the id and the place of the row among the rows of
    that id, by the digest of its text."""
    again = staged(source.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_id"), "again")
    if again.isEmpty():
        discard(again)
        return source.withColumnRenamed("row_id", "row"), _ALONE
    others = [c for c in source.columns if c != "row_id"]
    row = lambda nth: F.struct("row_id", nth.cast("int").alias("nth")).alias("row")
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(F.sha2("body", 256))) - 1
    several = narrowed(source, again, "row_id").join(again, "row_id", "left_semi")
    return without(source, again, "row_id").select(row(F.lit(0)), *others).unionByName(several.select(row(place), *others)), _NTH


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per document: row_id, n_bytes, n_removed, n_spans and ``kept``: the SHA-256 of the bytes left or, with ``texts``, those bytes
    as text (halves of characters at a cut are dropped).

    Ids are whole numbers and give the order of documents; rows that share an id are documents of their own, in the order of their texts' digests (so of
    rows equal in id and text one stays, and the others are its copies). Rows with a null id are not read, as they have no place in the order. A null text
    counts as empty. Texts shorter than LENGTH bytes are kept as they are. Columns named in ``carry`` follow as they are; others are not read.
    """
    spark = docs.sparkSession
    carry = carry or []
    inner = [f"_carried_{k}" for k in range(len(carry))]
    extra = [F.col(c).alias(i) for c, i in zip(carry, inner, strict=True)]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), *extra)
    source, kind = numbered(source)
    # the one exchange of the texts; everything that needs them reads it again
    held = source.repartition(partitions, "row")
    digest = source.select("row", F.sha2("body", 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = digest.join(first, "digest").where("row <> first").select("row", F.lit(True).alias("copy"))
    known = held.join(copies, "row", "left")
    # with the columns carried, though not read: a plan that leaves them out here would exchange the texts once more
    distinct = known.where("copy is null").select("row", "body", *inner)

    rows = distinct.mapInArrow(_anchor_rows, f"anchor long, row {kind}, at int")
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    repeated = rows.join(counts, "anchor").groupBy("row").agg(F.collect_list("at").alias("at"))
    wide = distinct.join(repeated, "row").select("row", "body", "at", *inner).mapInArrow(_super_windows, f"h long, row {kind}, at int, lead int, bytes binary, found {_FOUND}")
    sorted_ = wide.repartition("h").sortWithinPartitions("h", "row", "at")
    marks = sorted_.mapInArrow(_sort_and_mark, f"row {kind}, found {_FOUND}")
    gathered = marks.groupBy("row").agg(F.flatten(F.collect_list("found")).alias("marks"))
    done = known.join(gathered, "row", "left").select("row", "body", "copy", "marks", *inner)
    schema = "row_id long, n_bytes long, n_removed long, n_spans long, kept string"
    kinds = "".join(f", {i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(carry, inner, strict=True))
    out = done.mapInArrow(_finish(texts, inner), schema + kinds)
    return out.withColumnsRenamed(dict(zip(inner, carry, strict=True))) if carry else out
