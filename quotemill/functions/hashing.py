"""Hashes, deterministic ids and the canonical form of a URL, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.core import null_safe_join
from quotemill.functions.staging import staged

# Fixed value: namespace of flight keys.
FLIGHT_KEY_NAMESPACE = "2b6c9a3d-6e0a-4a9e-8a0e-7e6c8f0a3b5e"

# Fields that identify a quote and its money, in sorted order.
QUOTE_HASH_FIELDS = (
    "base_fare",
    "carrier_iata",
    "convenience_fee",
    "fare_brand",
    "fare_class",
    "flight_number",
    "query_date",
    "route_code",
    "source_code",
    "taxes",
    "total_fare",
    "travel_date",
    "udf",
)


def sha256_text(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def packed(text: Column) -> Column:
    """A text in as few bytes as it needs where rows are moved: a SHA-256 digest in hex takes half of them. Only digests are 32 bytes long, other texts of that
    length or more get a byte more, so equal bytes mean equal texts. ``unpacked`` reads it back."""
    digest = (F.length(text) == 64) & ~text.rlike("[^0-9a-f]")
    plain = text.cast("binary")
    return F.when(digest, F.unhex(text)).when(F.octet_length(text) < 32, plain).otherwise(F.concat(plain, F.unhex(F.lit("00"))))


def unpacked(key: Column) -> Column:
    """The text behind ``packed`` bytes."""
    size = F.octet_length(key)
    return F.when(size == 32, F.lower(F.hex(key))).when(size < 32, key.cast("string")).otherwise(F.substring(key, F.lit(1), size - 1).cast("string"))


def rows_and_distinct(df: DataFrame, key: str, text: str, rows_as: str, distinct_as: str) -> DataFrame:
    """Rows and distinct non-null texts of each key. Eight-byte fingerprints move instead of the texts: one that occurs once in its key is one text, and only the texts
    of those that occur again, which are listed in a written table, are compared themselves."""
    told = df.select(key, F.col(text).alias("__text"), F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("__print"))
    once = F.col("__print").isNotNull() & (F.col("__n") == 1)
    # lists per key and slot, so that none holds a key's fingerprints alone
    slots = told.groupBy(key, "__print").agg(F.count(F.lit(1)).alias("__n")).groupBy(key, F.pmod("__print", F.lit(256)).alias("__slot"))
    sums = staged(slots.agg(F.sum("__n").alias("__rows"), F.count_if(once).alias("__once"), F.collect_list(F.when(F.col("__n") > 1, F.col("__print"))).alias("__again")), "prints")
    again = sums.select(key, F.explode("__again").alias("__print"))
    compared = null_safe_join(told, again, [key, "__print"], "left_semi").groupBy(key).agg(F.count_distinct(packed(F.col("__text"))).alias("__compared"))
    totals = sums.groupBy(key).agg(F.sum("__rows").alias(rows_as), F.sum("__once").alias("__once"))
    return null_safe_join(totals, compared, [key], "left").select(key, rows_as, (F.col("__once") + F.coalesce("__compared", F.lit(0))).alias(distinct_as))


def canonical_json(fields: Sequence[str]) -> Column:
    """Compact JSON with sorted keys, every value as text, nulls kept."""
    cols = [F.col(f).cast("string").alias(f) for f in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def quote_content_hash(fields: Sequence[str] = QUOTE_HASH_FIELDS) -> Column:
    return sha256_text(canonical_json(fields))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based (SHA-1) UUID in canonical text form."""
    ns = namespace.replace("-", "")
    digest = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        F.substr(variant, nibble + 1, F.lit(1)),
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


#: Optional scheme, authority, path and query of a URL; what follows ``#`` is left out.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _form_decode(text: Column) -> Column:
    """``+`` and escapes decoded; a per cent sign that starts no escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encode(text: Column) -> Column:
    """Form encoding that leaves letters, digits and ``_.-~`` alone; a blank becomes ``+``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalise_url(url: Column) -> Column:
    """Canonical URL: lower-case scheme and host, no default port, no user, no fragment, non-empty path,
    query parameters sorted by decoded (key, value) and encoded again. Any text has a normal form; null stays null."""
    text = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    scheme, authority, path, query = (F.regexp_extract(text, _URL, i) for i in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    place = F.regexp_extract(authority, r"([^@]*)$", 1)
    host = F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1)))
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):0*(\d+)$", 1)
    default_port = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.when((port == "") | default_port, host).otherwise(F.concat(host, F.lit(":"), port))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    decoded = F.transform(
        parts,
        lambda p: F.struct(
            _form_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
            _form_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    encoded = F.array_join(
        F.transform(F.array_sort(decoded), lambda kv: F.concat(_form_encode(kv["k"]), F.lit("="), _form_encode(kv["v"]))), "&"
    )
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        F.when(netloc == "", "").otherwise(F.concat(F.lit("//"), netloc)),
        F.when(path == "", "/").otherwise(path),
        F.when(encoded == "", "").otherwise(F.concat(F.lit("?"), encoded)),
    )


def url_hash(url: Column) -> Column:
    return sha256_text(normalise_url(url))


def content_key(digest: Column) -> Column:
    """Storage key of a payload: ``sha256/aa/bb/<digest>``."""
    return F.concat_ws(
        "/", F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest
    )


def rows_hash(df: DataFrame, row: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Order-independent fingerprint of a row set: row digests are summed in eight 32-bit lanes and
    the sums hashed. State is constant per group, so it combines map-side at any size; sorting and
    joining all rows into one text would need one task to hold the table."""
    digest = sha256_text(row)
    lanes = [
        F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"__l{i}")
        for i in range(8)
    ]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *lanes)
    text = F.concat_ws("|", F.col("row_count"), *[F.col(f"__l{i}") for i in range(8)])
    return agg.select(*keys, "row_count", sha256_text(text).alias("content_hash"))


def run_hash(content_hash: Column, config_hash: Column) -> Column:
    """Stamp of a run: the same data under the same options gives the same stamp."""
    return sha256_text(F.concat_ws("|", content_hash, config_hash))


def config_hash(options: dict) -> str:
    """SHA-256 of the options as canonical JSON (driver side, a few hundred bytes)."""
    import hashlib
    import json

    text = json.dumps(options, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()
