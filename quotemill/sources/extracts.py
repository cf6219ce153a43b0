"""Readers and parsers of published extracts.

Readers give every column as text; parsers turn such a frame into typed rows plus a frame of
violations. A load with any violation is refused as a whole (``refuse_if_any``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.core import case_chain, require

# Spellings of city names in traffic extracts -> canonical names.
CITY_ALIASES = {
    "DELHI": "NEW DELHI",
    "BANGALORE": "BENGALURU",
    "BOMBAY": "MUMBAI",
    "MADRAS": "CHENNAI",
    "CALCUTTA": "KOLKATA",
    "COCHIN": "KOCHI",
    "GOA": "VASCO DA GAMA",
    "TRIVANDRUM": "THIRUVANANTHAPURAM",
    "PONDICHERRY": "PUDUCHERRY",
    "MUMBAI (MUMBAI)": "MUMBAI",
    "GOA (DABOLIM, SOUTH GOA)": "VASCO DA GAMA",
}


class ExtractRefused(ValueError):
    """The extract breaks a rule; nothing of it is loaded."""


def read_commented_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header and ``#`` provenance lines, every column as text, in the named order."""
    raw = spark.read.option("header", True).option("comment", "#").option("inferSchema", False).csv(path)
    require(raw, columns, f"extract {path}")
    return raw.select(*columns)


def read_checked_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a CSV with a header and ``#`` provenance lines: every column as text in the named order, and the lines that do not have as
    many fields as the header. A load with any such line is refused like one with any other violation (``refuse_if_any``)."""
    reader = lambda: spark.read.option("header", True).option("comment", "#").option("escape", '"')
    names = reader().csv(path).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ExtractRefused(f"extract {path}: no column {', '.join(missing)}")
    schema = ", ".join([*[f"`{n}` string" for n in names], "__line string"])
    # without pruning every line is split whole, so that its number of fields is known; files whose headers differ are an error
    raw = reader().schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line").option("columnPruning", False).option("enforceSchema", False).csv(path)
    fits = F.col("__line").isNull()
    # Spark reads the faulty line only beside a column of the file: nothing of the first one is added to it
    line = F.concat("__line", F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0))
    return raw.where(fits).select(*columns), raw.where(~fits).select(line.alias("line"), F.lit("number of fields differs from the header").alias("violation"))


def assert_not_empty(df: DataFrame, what: str) -> None:
    """Action: refuse an extract without rows."""
    if df.isEmpty():
        raise ExtractRefused(f"{what}: no rows")


def refuse_if_any(violations: DataFrame, what: str) -> None:
    """Action: raise with up to 20 examples when there is any violation."""
    rows = violations.limit(20).collect()
    if rows:
        raise ExtractRefused(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def blank_to_null(col: str) -> Column:
    return F.nullif(F.trim(F.col(col)), F.lit(""))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to a declared schema: blanks become null, then each column is cast."""
    return df.select(
        *[
            (blank_to_null(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def canonical_city(col: Column) -> Column:
    squeezed = F.upper(F.trim(F.regexp_replace(col, r"\s+", " ")))
    alias = F.create_map(*[F.lit(x) for kv in CITY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, squeezed), squeezed)


def half_even(text: Column, places: int, precision: int) -> Column:
    """Exact decimal text rounded half-even."""
    return F.bround(text.try_cast("decimal(30,15)"), places).cast(f"decimal({precision},{places})")


def _check(df: DataFrame, tests: Sequence[tuple[Column, str]], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("violation", case_chain(tests))
    good = flagged.where(F.col("violation").isNull()).drop("violation")
    return good, flagged.where(F.col("violation").isNotNull()).select(*keys, "violation")


def _duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*keys, F.lit("duplicate key").alias("violation"))
    )


def parse_traffic(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """City-pair passengers: canonical names, thousands commas stripped. (pairs, violations)."""
    require(raw, ["origin_city", "dest_city", "passengers"], "traffic extract")
    number = F.regexp_replace(F.trim("passengers"), ",", "")
    d = raw.select(
        canonical_city(F.col("origin_city")).alias("origin_city"),
        canonical_city(F.col("dest_city")).alias("dest_city"),
        number.try_cast("bigint").alias("passengers"),
    )
    n = F.col("passengers")
    good, bad = _check(d, [(n.isNull(), "passengers is not a whole number"), (n < 0, "passengers is negative")], ["origin_city", "dest_city"])
    return good, bad.unionByName(_duplicates(d, ["origin_city", "dest_city"]))


def month_of(text: Column) -> Column:
    """First day of a strict YYYY-MM text, else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(t, F.lit("-01"))))


def parse_average_fares(raw: DataFrame, routes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Average fare per (route, month), half-even at the cent. Unknown routes are violations."""
    require(raw, ["route_code", "period", "avg_fare"], "fare extract")
    d = raw.select(
        F.trim("route_code").alias("route_code"),
        month_of(F.col("period")).alias("period"),
        half_even(F.trim("avg_fare"), 2, 12).alias("avg_fare"),
        F.trim("avg_fare").try_cast("decimal(30,15)").alias("__raw"),
    )
    tests = [
        (F.col("period").isNull(), "period is not YYYY-MM"),
        (F.col("__raw").isNull(), "avg_fare is not a number"),
        (F.col("__raw") <= 0, "avg_fare must be positive"),
    ]
    good, bad = _check(d, tests, ["route_code", "period"])
    bad = bad.unionByName(_duplicates(d, ["route_code", "period"]))
    if routes is not None:
        unknown = d.join(routes.select("route_code").distinct(), "route_code", "left_anti")
        bad = bad.unionByName(unknown.select("route_code", "period", F.lit("unknown route").alias("violation")))
    return good.drop("__raw"), bad


def parse_target_index(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Monthly index values, half-even at six places. A repeated period is a later vintage."""
    require(raw, ["period", "value", "base_year", "release_date"], "index extract")
    d = raw.select(
        month_of(F.col("period")).alias("period"),
        half_even(F.trim("value"), 6, 14).alias("value"),
        blank_to_null("base_year").alias("base_year"),
        F.try_to_date(F.trim("release_date"), "yyyy-MM-dd").alias("release_date"),
    )
    tests = [
        (F.col("period").isNull(), "period is not YYYY-MM"),
        (F.col("value").isNull(), "value is not a number"),
        (F.col("value") <= 0, "value must be positive"),
        (F.col("release_date").isNull(), "release_date is not a date"),
    ]
    return _check(d, tests, ["period", "release_date"])


def parse_fuel_prices(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fuel price per city and day, half-even at the cent."""
    require(raw, ["price_date", "city", "price_per_kl"], "fuel extract")
    d = raw.select(
        F.try_to_date(F.trim("price_date"), "yyyy-MM-dd").alias("price_date"),
        blank_to_null("city").alias("city"),
        half_even(F.trim("price_per_kl"), 2, 12).alias("price_per_kl"),
    )
    tests = [
        (F.col("price_date").isNull(), "price_date is not a date"),
        (F.col("city").isNull(), "city is empty"),
        (F.col("price_per_kl").isNull(), "price_per_kl is not a number"),
        (F.col("price_per_kl") <= 0, "price_per_kl must be positive"),
    ]
    return _check(d, tests, ["price_date", "city"])
