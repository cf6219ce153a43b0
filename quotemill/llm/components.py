"""Connected components of links held in a table, and a filter that keeps rows from being moved for nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.staging import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that occurs in ``links`` (columns a, b); component is the smallest id reachable.

    Each round points every id at the smallest label among its own and its neighbours', then at that label's label (pointer
    jumping), so long chains shrink by doubling. Minima are combined map-side and tables are only joined, so a hub with many links is no
    hot group. Each round's labels are written to the shared folder and cut the lineage; rounds end when no label changes. Self-links
    and repeated links are harmless; rows with a null end are left out.
    """
    both = links.where("a is not null and b is not null").select("a", "b")
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        lower = labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("l"))
        # what a label's own id now points at; every id also hands its new label to the id that was its label
        hook = lower.groupBy(F.col("was").alias("id")).agg(F.min("l").alias("h"))
        hooked = lower.join(hook, "id", "left").select("id", "was", F.least("l", F.coalesce("h", F.col("l"))).alias("l"))
        up = hooked.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        new = staged(hooked.join(up, "l").select("id", "was", F.least("l", "ll").alias("component")), "labels")
        changed = new.where("was <> component").limit(1).count()
        discard(labels)
        labels = new.select("id", "component")
        if not changed:
            discard(both)
            return labels


#: Bits of the filter below; the broadcast has at most a 64th as many rows of 16 bytes, whatever the size of the data.
FILTER_BITS = 1 << 24


def _tested(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``__filter_may``: false only where ``key`` is surely not in ``wanted``."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, mask = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")
    words = wanted.select(word.alias("__filter_word"), mask.alias("__filter_mask")).groupBy("__filter_word").agg(F.bit_or("__filter_mask").alias("__filter_map"))
    tested = rows.withColumns({"__filter_at": word, "__filter_bit": mask}).join(F.broadcast(words), F.col("__filter_at") == F.col("__filter_word"), "left")
    return tested.withColumn("__filter_may", F.coalesce(F.col("__filter_map").bitwiseAND(F.col("__filter_bit")) != 0, F.lit(False)))


def narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; none that is in it is lost. A join on the key has to follow.

    The hashes of the wanted keys set bits of a map of fixed size, which is broadcast, so rows with wide columns are dropped where they are
    read. With more keys than bits the filter lets everything pass and the join alone decides.
    """
    return _tested(rows, wanted, key).where("__filter_may").select(*[f"`{c}`" for c in rows.columns])


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped`` (a null key never is). Only rows that may be dropped are moved to be looked at."""
    tested = _tested(rows, dropped, key)
    columns = [f"`{c}`" for c in rows.columns]
    maybe = tested.where("__filter_may").select(*columns).join(dropped.select(key), key, "left_anti")
    return tested.where("not __filter_may").select(*columns).unionByName(maybe.select(*columns))


def one_per_id(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with one row per id: of several the smallest v. Vectors are only moved where ids repeat."""
    again = staged(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "again")
    if again.isEmpty():
        discard(again)
        return rows
    several = narrowed(rows, again, "vec_id").join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return without(rows, again, "vec_id").unionByName(several)
