"""The cleaning run: quarantine, matching, split, outliers, missing cells, imputation, coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.config import CleaningOptions
from quotemill.functions.staging import staged
from quotemill.operators import cleaning, missing

CLEAN_COLUMNS = (
    "quote_id", "quote_collected_at", "snapshot_id", "route_id", "carrier_iata", "travel_date", "advance_days",
    "dep_hour_bucket", "stops", "base_fare", "taxes", "total_fare", "is_outlier", "outlier_rule", "is_imputed",
    "imputation_method", "quality_vector",
)


@dataclass(frozen=True)
class CleanResult:
    clean: DataFrame
    quarantined: DataFrame
    unresolved: DataFrame
    coverage: DataFrame
    missing: DataFrame


def observed_rows(kept: DataFrame, snapshot_id: str) -> DataFrame:
    """Observed quotes in the clean layout."""
    return kept.select(
        F.col("id").alias("quote_id"),
        F.col("collected_at").alias("quote_collected_at"),
        F.lit(snapshot_id).alias("snapshot_id"),
        *CLEAN_COLUMNS[3:7],
        F.col("dep_hour_bucket").cast("short").alias("dep_hour_bucket"),
        F.col("stops").cast("short").alias("stops"),
        "base_fare",
        "taxes",
        F.col("total_fare").cast("decimal(12,2)").alias("total_fare"),
        "is_outlier",
        "outlier_rule",
        F.lit(False).alias("is_imputed"),
        F.lit(None).cast("string").alias("imputation_method"),
        cleaning.quality_vector(kept.columns).alias("quality_vector"),
    )


def imputed_rows(imputed: DataFrame, snapshot_id: str) -> DataFrame:
    """Imputed cells in the clean layout: only the total is filled, nothing else is invented."""
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return imputed.select(
        none("string", "quote_id"),
        none("timestamp", "quote_collected_at"),
        F.lit(snapshot_id).alias("snapshot_id"),
        *CLEAN_COLUMNS[3:7],
        none("short", "dep_hour_bucket"),
        none("short", "stops"),
        none("decimal(12,2)", "base_fare"),
        none("decimal(12,2)", "taxes"),
        F.bround(F.col("total_fare").cast("decimal(20,8)"), 2).cast("decimal(12,2)").alias("total_fare"),
        F.lit(False).alias("is_outlier"),
        none("string", "outlier_rule"),
        "is_imputed",
        "imputation_method",
        cleaning.quality_vector(["carrier_type"]).alias("quality_vector"),
    )


def clean_quotes(
    quotes: DataFrame,
    expected: DataFrame,
    runs: DataFrame,
    carrier_types: DataFrame,
    airport_fee: DataFrame,
    snapshot_id: str,
    opts: CleaningOptions = CleaningOptions(),
    stage: bool = True,
) -> CleanResult:
    """Run every cleaning stage. ``carrier_types``: (carrier_iata, carrier_type); ``airport_fee``:
    (origin_iata, airport_udf). What the screens, the missing cells and the imputation read of a quote, its identity and price, is written once as a narrow table
    (``stage``); the quotes themselves are read once more, for the clean rows."""
    kept, quarantined = cleaning.quarantine_malformed(quotes)
    # identity, price and derived columns; what is not selected is not computed
    derived = cleaning.with_calendar(cleaning.with_lookup(kept, carrier_types, "carrier_iata"))
    narrow = derived.select(*dict.fromkeys([*missing.CELL, *opts.outlier_group, *opts.impute_group, *opts.coverage_group, "total_fare"]))
    if stage:
        narrow = staged(narrow, "cells")
    outliers = cleaning.outlier_values(narrow, opts.outlier_group, "total_fare", opts.mad_threshold, opts.iqr_k, opts.min_cell_size)
    flagged = lambda rows: cleaning.with_outlier_flags(rows, outliers, opts.outlier_group, "total_fare", opts.active_rule)
    kept = cleaning.assign_flight_key(flagged(kept), opts.dep_tolerance_minutes, opts.dedup_group)
    kept = cleaning.decompose_fares(kept, airport_fee, opts.tax_rate)
    kept = cleaning.with_calendar(cleaning.with_lookup(kept, carrier_types, "carrier_iata"))
    gaps = missing.classify_missing(missing.missing_cells(expected, narrow), runs)
    if stage:
        gaps = staged(gaps, "gaps")
    sold_out = cleaning.with_lookup(gaps.where(F.col("missing_reason") == "sold_out"), carrier_types, "carrier_iata")
    filled, unresolved = missing.impute_sold_out(
        sold_out, flagged(narrow).where(~F.col("is_outlier")), opts.impute_group, opts.min_impute_size
    )
    clean = observed_rows(kept, snapshot_id).unionByName(imputed_rows(filled, snapshot_id))
    cover = missing.coverage(expected, narrow, gaps, filled, opts.coverage_group)
    return CleanResult(clean, quarantined, unresolved, cover, gaps)
