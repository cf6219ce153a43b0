"""One index run: clean a window of quotes, index every cell, roll up, splice, publish with lineage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.config import CleaningOptions, GateOptions, IndexOptions
from quotemill.functions import hashing
from quotemill.functions.staging import staged
from quotemill.operators import aggregate, cleaning, gates, missing, multilateral, splice, vintages
from quotemill.plans.cleaning_run import clean_quotes
from quotemill.sources import ledger

CELLS = ("route_code", "advance_window", "carrier_iata")
PRODUCTS = ("carrier_iata", "flight_number", "source_code", "advance_days")
FLIGHT = ("source_id", "route_id", "carrier_iata", "flight_number", "advance_days")


@dataclass(frozen=True)
class RunInputs:
    """Tables a run reads. ``quotes`` also carries route_code and source_code."""

    quotes: DataFrame
    runs: DataFrame
    carrier_types: DataFrame
    airport_fee: DataFrame
    booking_weights: DataFrame
    pax_share: DataFrame
    published: DataFrame
    distances: DataFrame | None = None


def cell_hierarchies(
    cells: DataFrame, inputs: RunInputs, opts: IndexOptions
) -> tuple[DataFrame, DataFrame]:
    """(current, prior) series of one set of cells, read at the two ends of its window."""
    typed = cleaning.with_lookup(cells, inputs.carrier_types, "carrier_iata")
    cols = ["route_code", "advance_window", "carrier_type", "n_quotes", "coverage_pct"]

    def at(column: str) -> DataFrame:
        rows = typed.select(*cols, F.col(column).alias("index_value"))
        return aggregate.series_hierarchy(rows, inputs.booking_weights, inputs.pax_share, opts.series_prefix)

    return at("index_value"), at("index_value_prior")


def thin_cells(cells: DataFrame, opts: IndexOptions) -> tuple[DataFrame, DataFrame]:
    """(cells meeting the publication floors, the others with a reason)."""
    thin = F.when(F.col("n_quotes") < opts.min_quotes_per_cell, "too few quotes").when(
        F.col("coverage_pct") < opts.min_coverage_pct, "coverage below the floor"
    )
    c = cells.withColumn("skip_reason", thin)
    return c.where(F.col("skip_reason").isNull()).drop("skip_reason"), c.where(F.col("skip_reason").isNotNull())


def index_run(
    inputs: RunInputs,
    as_of,
    run_id: str,
    clean_opts: CleaningOptions = CleaningOptions(),
    opts: IndexOptions = IndexOptions(),
    gate_opts: GateOptions | None = GateOptions(),
    cells: Sequence[str] = CELLS,
    products: Sequence[str] = PRODUCTS,
    use_floors: bool = False,
) -> dict[str, DataFrame]:
    """Frames of one run keyed by table name.

    The two frames every later stage reads, clean rows and cells, are written once. ``gate_opts``
    blocks the run on failing gates (None: gates are skipped); ``use_floors`` drops thin cells.
    """
    day = F.lit(as_of).cast("date")
    start = F.date_sub(day, opts.window_days - 1)
    q = ledger.scan_window(inputs.quotes, start, day)
    runs = inputs.runs.where(F.col("query_date").between(start, day))
    expected = missing.expected_from_history(q, runs, FLIGHT)
    result = clean_quotes(q, expected, runs, inputs.carrier_types, inputs.airport_fee, run_id, clean_opts)
    placed, dropped = cleaning.drop_unplaceable(result.clean)
    codes = q.select(F.col("id").alias("quote_id"), "route_code", "source_code", "flight_number")
    clean = placed.join(codes, "quote_id", "left").withColumn(
        "query_date", F.date_sub("travel_date", F.col("advance_days").cast("int"))
    )
    clean = staged(
        clean.withColumn("clean_id", hashing.uuid5(hashing.FLIGHT_KEY_NAMESPACE, F.concat_ws("|", F.lit(run_id), "quote_id"))),
        "clean",
    )
    if gate_opts is not None:
        if inputs.distances is None:
            raise ValueError("quality gates need route distances")
        gates.assert_gates(gates.quality_report(clean, result.coverage, inputs.distances, gate_opts))

    indexed = clean.where(~F.col("is_outlier") & ~F.col("is_imputed")).withColumn("advance_window", cleaning.window_code())
    indexed = indexed.where(F.col("advance_window").isNotNull())
    good, skips = multilateral.elementary_cells(indexed, cells, products, "query_date", day, opts.window_days)
    if use_floors:
        good, thin = thin_cells(good, opts)
        skips = skips.unionByName(thin.select(*cells, "skip_reason"))
    good = staged(good, "cells")
    current, prior = cell_hierarchies(good, inputs, opts)
    current = staged(current, "series")
    rows = splice.publication_rows(current, prior, inputs.published, day, opts.reference_value, opts.splice)
    settings = {**asdict(opts), "cleaning": asdict(clean_opts)}
    digest = hashing.config_hash(settings)
    # Only quotes count: the same quotes under the same options give the same stamp.
    snapshot = hashing.rows_hash(clean.where(F.col("quote_id").isNotNull()), F.concat_ws(":", "quote_id", "total_fare"))
    snapshot = snapshot.withColumn("snapshot_id", F.lit(run_id)).withColumn(
        "run_hash", hashing.run_hash(F.col("content_hash"), F.lit(digest))
    )
    series = current.select("series_code", vintages.series_dimensions().alias("dimensions"), F.lit("MONTHLY").alias("frequency"))
    config = q.sparkSession.createDataFrame([(digest, json.dumps(settings, sort_keys=True, default=str))], "config_hash string, config string")
    return {
        "data_snapshot": snapshot,
        "method_config": config,
        "fare_quote_clean": clean,
        "quarantined": result.quarantined,
        "coverage": result.coverage,
        "elementary": good,
        "skipped_cells": skips,
        "series": series,
        "index_value": rows["index_value"],
        "revision_log": rows["revision_log"],
        "skipped_series": rows["skipped"],
        "index_value_quote": splice.lineage(clean, current, day, opts.series_prefix),
        "unplaceable": dropped,
    }


def publish_run(frames: dict[str, DataFrame], out: str, run_id: str, as_of) -> None:
    """Write a run; it becomes visible with its manifest."""
    ledger.write_run(frames, out, run_id, {"vintage_date": str(as_of)})
