"""Pack tokenised documents into fixed-length sequences: vector bin packing with the dot-product heuristic.

Every document is a vector of demands (tokens, segments, loss-bearing tokens) and every sequence a vector of capacities. In a
block of documents the items are placed by falling size; each goes to the open sequence that can take it whole and whose
remaining capacities have the largest dot product with its demands (both in shares of capacity, so that the scarcer
resource weighs more); if none can, a new one is opened. A document longer than a sequence is first cut into full sequences
and a rest. Then the gaps are filled by cutting: the emptiest sequences are dissolved and their pieces poured into the free
room of the fuller ones. What is still not full is split at powers of two, which need no padding.

A block is what one task reads (flushed at ``BLOCK_TOKENS``, so memory is bounded): no shuffle, and nothing depends on
other tasks. Ids of sequences carry the partition's number, so a task run again gives the same ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.bpe_codec import groups
from quotemill.llm.wordbpe import remembered

#: Tokens after which a task packs what it holds.
BLOCK_TOKENS = 4_000_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


def _place(size: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length); items are whole or, if too long, cut into full sequences and a rest."""
    full: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int, int]] = []
    for k in range(len(size)):
        n, lost, at = int(size[k]), int(loss[k]), 0
        head = n - lost  # tokens without loss come first
        while n - at > 0:
            take = min(n - at, limits.tokens)
            bearing = max(0, at + take - max(at, head))
            if bearing > limits.loss_tokens:
                take = max(0, head - at) + limits.loss_tokens
                bearing = limits.loss_tokens
            if take == n - at and take < limits.tokens and bearing < limits.loss_tokens:
                rests.append((take, bearing, k, at))
            else:
                full.append([(k, at, take)])
            at += take
    rests.sort(key=lambda r: (-max(r[0] / limits.tokens, r[1] / limits.loss_tokens), r[2]))
    room = np.empty((max(1, len(rests)), 3))
    scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
    bins: list[list[tuple[int, int, int]]] = []
    closed = 0  # sequences before this one are full and no longer looked at
    for n, bearing, k, at in rests:
        need = np.array([n, 1, bearing]) / scale
        open_room = room[closed : len(bins)]
        fit = (open_room >= need - 1e-12).all(axis=1)
        if fit.any():
            score = np.where(fit, open_room @ need, -1.0)
            b = closed + int(score.argmax())
        else:
            b = len(bins)
            bins.append([])
            room[b] = 1.0
        bins[b].append((k, at, n))
        room[b] -= need
        while closed < len(bins) and room[closed].min() < 1e-9:
            closed += 1
    return full + bins


def _loss(piece: tuple[int, int, int], size: np.ndarray, loss: np.ndarray) -> int:
    k, at, n = piece
    head = int(size[k] - loss[k])
    return max(0, at + n - max(at, head))


def _pour(bins, size, loss, limits: Limits):
    """Dissolve the emptiest sequences into the free room of the others; split what is not full at powers of two."""
    fill = lambda b: sum(n for _, _, n in b)
    done = [b for b in bins if fill(b) >= limits.tokens]
    part = sorted((b for b in bins if fill(b) < limits.tokens), key=fill)
    lo, hi = 0, len(part) - 1
    while lo < hi:
        target = part[hi]
        while lo < hi:
            free = limits.tokens - fill(target)
            slots = limits.segments - len(target)
            lossy = limits.loss_tokens - sum(_loss(p, size, loss) for p in target)
            if free <= 0 or slots <= 0:
                break
            source = part[lo]
            k, at, n = source[-1]
            take = min(n, free)
            # tokens without loss come first: a prefix bears the least
            head = max(0, int(size[k] - loss[k]) - at)
            take = min(take, head + max(0, lossy))
            if take <= 0:
                break
            target.append((k, at, take))
            if take < n:
                source[-1] = (k, at + take, n - take)
            else:
                source.pop()
            if not source:
                lo += 1
        done.append(target)
        hi -= 1
    if lo == hi and part[lo]:
        done.append(part[lo])
    out = []
    for b in done:
        while (n := fill(b)) < limits.tokens and n & (n - 1):
            size_now, head_part = 1 << (n.bit_length() - 1), []
            while size_now:
                k, at, m = b[0]
                take = min(m, size_now)
                head_part.append((k, at, take))
                size_now -= take
                b = ([(k, at + take, m - take)] if take < m else []) + b[1:]
            out.append(head_part)
        out.append(b)
    return out


def pack_block(size: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of one block as lists of (item, start, length), each within all limits."""
    return _pour(_place(size, loss, limits), size, loss, limits)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    limits: Limits = Limits(),
    end_id: int = 2,
    prompt_tokens_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it was cut and where it lies.

    A document is its ids followed by ``end_id``; a null or empty text is that one id. ``prompt_tokens_col`` names a column with
    the number of leading tokens that bear no loss (instruction data); without it every token bears loss. Columns: the id,
    ``start``, ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset``, ``loss_tokens`` and, if asked for, ``ids`` (array). Repeated rows are packed each by itself; null ids are kept.
    """
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {fields}" + (", ids array<int>" if with_ids else "")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        memory = remembered(tokenizer_path, "bytes", lambda bpe: lambda ids: struct.pack(f"<{len(ids)}I", *ids))
        base = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        tokens = sequences = 0

        def flush():
            nonlocal held, tokens, sequences
            size = np.array([len(b) // 4 for _, b, _ in held])
            loss = np.array([max(0, len(b) // 4 - max(0, p)) for _, b, p in held])
            rows: list[list] = [[] for _ in names]
            for seq in pack_block(size, loss, limits):
                offset = 0
                for piece in seq:
                    k, at, n = piece
                    doc, data, _ = held[k]
                    cut = data[4 * at : 4 * (at + n)]
                    row = (doc, at, n, zlib.crc32(cut), len(data) // 4, base + sequences, offset, _loss(piece, size, loss))
                    for column, v in zip(rows, row + ((np.frombuffer(cut, "<u4").tolist(),) if with_ids else ()), strict=True):
                        column.append(v)
                    offset += n
                sequences += 1
            held, tokens = [], 0
            kinds = [id_type] + [pa.int64()] * 7 + ([pa.list_(pa.int32())] if with_ids else [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts, ids, prompts = batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in groups(texts):
                for k, got in enumerate(memory.look_up(texts[a:b]), a):
                    data = b"".join(got) + tail
                    held.append((ids[k], data, prompts[k]))
                    tokens += len(data) // 4
                    if tokens >= BLOCK_TOKENS:
                        yield flush()
        if held:
            yield flush()

    prompt = F.coalesce(F.col(prompt_tokens_col).cast("int"), F.lit(0)) if prompt_tokens_col else F.lit(0)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), prompt.alias("prompt"))
    return source.mapInArrow(run, schema)
