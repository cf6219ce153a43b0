"""Drift of JSON payloads: the key paths of a body against those its source is known for.

A path joins keys by dots; ``[]`` after a path stands for the elements of a list, all alike. Bodies of a source repeat few shapes, so a
body is first reduced to its shape, the type text of its parsed form, and only distinct shapes are unfolded into paths. A list that mixes objects
with other values has no common type; such a body is its own shape. All of it is column expressions, at any depth of nesting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.core import null_safe_join
from quotemill.functions.staging import staged

#: A type text that leaves the inside of some list open.
_OPEN = r"(?:^|<|: )VARIANT(?:$|[,>])"

#: What matters in a type text (names, plain or between back quotes, before a colon; objects and lists; their ends) and in a JSON text (strings,
#: those before a colon being keys; brackets). What one of the two does not use cannot occur in it outside its quotes.
_TOKENS = r'"(?:[^"\\]++|\\.)*+"\s*+:?|`(?:[^`]++|``)*+`:|[A-Za-z0-9_]+:|OBJECT<|ARRAY<|[{}\[\]>]'


def _name(token: Column) -> Column:
    """The key that a token ending in a colon stands for."""
    bare = F.rtrim(F.substring(token, F.lit(1), F.length(token) - 1))
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    unescaped = F.get(F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>"), F.lit(0))
    return (
        F.when(bare.startswith('"'), F.when(bare.contains("\\"), unescaped).otherwise(inner))
        .when(bare.startswith("`"), F.replace(inner, F.lit("``"), F.lit("`")))
        .otherwise(bare)
    )


def _read(token: Column) -> Column:
    """What a token does, and the name of a key."""
    kind = F.when(token.isin("{", "OBJECT<"), "object").when(token.isin("[", "ARRAY<"), "list").when(token.isin("}", "]", ">"), "end").when(token.endswith(":"), "key")
    return F.struct(kind.alias("kind"), F.when(token.endswith(":"), _name(token)).alias("name"))


def key_paths(shape: Column) -> Column:
    """The sorted distinct key paths of a shape, read from left to right with a stack of the paths that lead to the open objects and lists."""
    texts, none = "array<string>", F.lit(None).cast("string")
    tokens = F.filter(F.transform(F.regexp_extract_all(shape, F.lit(_TOKENS), F.lit(0)), _read), lambda t: t["kind"].isNotNull())
    start = F.struct(F.array().cast(texts).alias("stack"), F.array().cast(texts).alias("paths"), none.alias("led"))

    def step(s: Column, token: Column) -> Column:
        kind = token["kind"]
        above = F.try_element_at(s["stack"], F.lit(-1))
        # by its key, or as an element of the list above
        led = F.coalesce(s["led"], above, F.lit(""))
        path = F.concat(F.when(above != "", F.concat(above, F.lit("."))).otherwise(""), token["name"])
        opened = F.array_append(s["stack"], F.when(kind == "list", F.concat(led, F.lit("[]"))).otherwise(led))
        return F.struct(
            F.when(kind == "key", s["stack"]).when(kind == "end", F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(opened).alias("stack"),
            F.when(kind == "key", F.array_union(s["paths"], F.array(path))).otherwise(s["paths"]).alias("paths"),
            F.when(kind == "key", path).alias("led"),
        )

    return F.array_sort(F.reduce(tokens, start, step, lambda s: s["paths"]))


def payload_shapes(payloads: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """(keys, shape) of each payload: the type text of its JSON body, or the body itself where types leave something open; null where it is not
    JSON. A body that names a key of one object twice counts as not JSON."""
    told = payloads.select(*keys, F.col(body).alias("__body"), F.schema_of_variant(F.try_parse_json(body)).alias("__told"))
    # the plain search spares nearly every type text the pattern
    opened = F.col("__told").contains("VARIANT") & F.col("__told").rlike(_OPEN)
    return told.select(*keys, F.when(opened, F.col("__body")).otherwise(F.col("__told")).alias("shape"))


def shape_difference(payloads: DataFrame, expected: DataFrame, keys: Sequence[str] = ("source_code",)) -> DataFrame:
    """(keys, key_path, change): paths ``added`` to or ``removed`` from the expected set per key.

    Bodies are parsed once, into a written table of the distinct shapes; a filter on the shape before that would parse each body again.
    """
    shapes = staged(payload_shapes(payloads, keys).distinct(), "shapes").where(F.col("shape").isNotNull())
    found = shapes.select(*keys, F.explode(key_paths(F.col("shape"))).alias("key_path")).distinct()
    known = expected.select(*keys, "key_path").distinct()
    on = [*keys, "key_path"]
    return found.join(known, on, "left_anti").withColumn("change", F.lit("added")).unionByName(
        known.join(found, on, "left_anti").withColumn("change", F.lit("removed"))
    )


def _verdicts(shapes: DataFrame, expected: DataFrame, source: str) -> DataFrame:
    """(source, shape, numbers of paths on either side of the difference) of the shapes that differ from their source's expected paths. Each distinct
    (source, shape) is judged once; the table is written, so that it is seen to be small."""
    # the expected paths of a source are configuration, a few dozen texts
    known = expected.groupBy(source).agg(F.collect_set("key_path").alias("__known"))
    empty = F.array().cast("array<string>")
    judged = shapes.select(source, "shape").distinct().join(known, source, "left").select(
        source, "shape", F.coalesce(key_paths(F.col("shape")), empty).alias("__got"), F.coalesce("__known", empty).alias("__want")
    )
    verdicts = judged.select(
        source,
        "shape",
        F.size(F.array_except("__got", "__want")).cast("long").alias("added_paths"),
        F.size(F.array_except("__want", "__got")).cast("long").alias("removed_paths"),
        F.col("shape").isNull().alias("not_json"),
    ).where((F.col("added_paths") > 0) | (F.col("removed_paths") > 0) | F.col("not_json"))
    return staged(verdicts, "verdicts")


#: What ``judged_payloads`` adds to payloads.
VERDICT = ("added_paths", "removed_paths", "not_json")


def judged_payloads(payloads: DataFrame, expected: DataFrame, source: str = "source_code") -> DataFrame:
    """Payloads with the number of paths on either side of the difference between their shape and their source's expected paths, nulls where there is none.

    The payloads are written once, with their shapes: what reads them after builds and parses no body again, and tells drifted ones without a join by id.
    """
    shaped = staged(payload_shapes(payloads, payloads.columns), "payloads", compression="zstd")
    return null_safe_join(shaped, _verdicts(shaped, expected, source), [source, "shape"], "left").drop("shape")


def drifted_payloads(
    payloads: DataFrame, expected: DataFrame, key: str = "payload_id", source: str = "source_code"
) -> DataFrame:
    """Payloads whose shape differs from their source's expected paths, with the number of paths on either side of the difference.

    Bodies are parsed once, into a written table of shapes, which repeat and take little room; those of ``judged_payloads`` not at all.
    """
    if set(VERDICT) <= set(payloads.columns):
        return payloads.where(F.col("not_json").isNotNull()).select(key, source, *VERDICT)
    shapes = staged(payload_shapes(payloads, [key, source]), "shapes")
    return null_safe_join(shapes, _verdicts(shapes, expected, source), [source, "shape"]).select(key, source, *VERDICT)


def quarantine_split(payloads: DataFrame, drifted: DataFrame, key: str = "payload_id") -> tuple[DataFrame, DataFrame]:
    """(payloads to parse, payloads set aside for inspection): set aside is what has an id among ``drifted``.

    For ``judged_payloads`` only ids are joined. Where a payload's verdict and its id disagree (payloads that share an id and differ, a list that holds other ids), the id
    is written into a table of exceptions, which is nearly always small; the bodies stay where they are.
    """
    bad = drifted.select(key)
    if not set(VERDICT) <= set(payloads.columns):
        return payloads.join(bad, key, "left_anti"), payloads.join(bad, key, "left_semi")
    own = F.col("not_json").isNotNull()
    listed = bad.distinct().withColumn("__listed", F.lit(True))
    ids = payloads.where(F.col(key).isNotNull()).select(key, own.alias("__own")).join(listed, key, "left")
    unlike = ids.where(F.col("__own") != F.coalesce("__listed", F.lit(False)))
    exceptions = staged(unlike.select(F.col(key).alias("__id"), F.coalesce("__listed", F.lit(False)).alias("__listed")).distinct(), "exceptions")
    told = payloads.join(exceptions, F.col(key) == F.col("__id"), "left")
    aside = F.col(key).isNotNull() & F.coalesce("__listed", own)
    return told.where(~aside).select(*payloads.columns), told.where(aside).select(*payloads.columns)
