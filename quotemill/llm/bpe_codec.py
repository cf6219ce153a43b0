"""Encode and decode every text of a table with a word-level BPE (see ``wordbpe`` for the method).

The job is a map over the table: no shuffle, no state that grows with the input beyond a bounded memory of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.wordbpe import remembered

#: Texts of one Arrow batch are solved together, in groups of about so many characters.
GROUP_CHARS = 1_000_000


def groups(texts: list[str], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters (at least one text each)."""
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _strings(bpe):
    return lambda ids: (" ".join(map(str, ids)), " ".join(map(bpe.strings.__getitem__, ids)), len(ids))


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, ``ids`` (decimal, blank between) and ``decoded``.

    A null text counts as empty: no ids, empty decoded text. Rows with a null or repeated id are kept as they are; other
    columns, whatever their names, are not read. Texts are encoded whole, whatever their length.
    """
    schema = f"{'`' + id_col + '`'} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids string, decoded string"

    def run(batches):
        memory = remembered(tokenizer_path, "strings", _strings)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                n, ids, decoded = [], [], []
                for got in memory.look_up(texts[a:b]):
                    n.append(sum(g[2] for g in got))
                    ids.append(" ".join([g[0] for g in got]))
                    decoded.append(" ".join([g[1] for g in got]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_decode`` with the two long strings reduced to SHA-256 where they are made, so they never leave the worker."""
    schema = f"{'`' + id_col + '`'} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        memory = remembered(tokenizer_path, "strings", _strings)
        digest = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8")).hexdigest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                n, ids, decoded = [], [], []
                for got in memory.look_up(texts[a:b]):
                    n.append(sum([g[2] for g in got]))
                    ids.append(digest([g[0] for g in got]))
                    decoded.append(digest([g[1] for g in got]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, schema)
