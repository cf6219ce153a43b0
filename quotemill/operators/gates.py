"""Quality gates before publication and declarative row rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quotemill.config import GateOptions
from quotemill.functions.core import null_safe_join, union_all
from quotemill.operators.cleaning import distance_band

REPORT = ("gate", "success", "element_count", "null_count", "unexpected_count")


class GateFailure(ValueError):
    """Raised with every gate's result, not only the first failing one."""

    def __init__(self, rows):
        self.rows = rows
        bad = ", ".join(f"{r['gate']} ({r['unexpected_count']})" for r in rows if not r["success"])
        super().__init__(f"quality gates failed: {bad}")


def _plausible_rows(clean: DataFrame, distances: DataFrame, opts: GateOptions) -> DataFrame:
    q = clean.where(~F.col("is_outlier")).join(distances, "route_id", "left")
    return q.withColumn("band", distance_band(F.col("distance_km"), opts.bands))


def _fare_tests(opts: GateOptions) -> dict[str, tuple[Column, Column, Column]]:
    """gate -> (row belongs, value, value is unexpected)."""
    tests = {}
    for name, _, low, high in opts.bands:
        value = F.col("base_fare").cast("double")
        tests[f"base_fare_within_band__{name}"] = (F.col("band") == name, value, ~value.between(low, high))
    total = F.col("total_fare").cast("double")
    share = F.col("taxes").cast("double") / F.nullif(total, F.lit(0.0))
    tests["tax_share_within_band"] = (
        share.isNotNull(),
        share,
        ~share.between(opts.tax_share_min, opts.tax_share_max),
    )
    return tests


def quality_report(
    clean: DataFrame,
    coverage: DataFrame,
    distances: DataFrame,
    opts: GateOptions = GateOptions(),
) -> DataFrame:
    """One row per gate: name, success, element, null and unexpected counts.

    The range gates come out of one pass of conditional counts; the id gate is a partial count per
    id. Rows flagged as outliers are left out of the range gates. A route without a distance fails
    its own gate.
    """
    aggs, names = [], []
    for name, (belongs, value, bad) in _fare_tests(opts).items():
        names.append(name)
        aggs += [
            F.count_if(belongs).alias(f"{name}|e"),
            F.count_if(belongs & value.isNull()).alias(f"{name}|n"),
            F.count_if(F.coalesce(belongs & bad, F.lit(False))).alias(f"{name}|u"),
        ]
    names.append("route_distance_known")
    aggs += [
        F.count(F.lit(1)).alias("route_distance_known|e"),
        F.lit(0).cast("long").alias("route_distance_known|n"),
        F.count_if(F.col("distance_km").isNull()).alias("route_distance_known|u"),
    ]
    ranges = _plausible_rows(clean, distances, opts).agg(*aggs)
    fields = F.array(
        *[
            F.struct(
                F.lit(n).alias("gate"),
                F.col(f"`{n}|e`").alias("element_count"),
                F.col(f"`{n}|n`").alias("null_count"),
                F.col(f"`{n}|u`").alias("unexpected_count"),
            )
            for n in names
        ]
    )
    range_rows = ranges.select(F.inline(fields))

    cov = F.col("coverage_pct")
    cov_row = coverage.agg(
        F.lit("coverage_above_floor").alias("gate"),
        F.count(F.lit(1)).alias("element_count"),
        F.count_if(cov.isNull()).alias("null_count"),
        F.count_if(~cov.between(opts.coverage_floor_pct, 100.0)).alias("unexpected_count"),
    )
    per_id = clean.groupBy("quote_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("quote_id").isNotNull()
    id_row = per_id.agg(
        F.lit("no_duplicate_quote_id").alias("gate"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("element_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("unexpected_count"),
    )
    method_row = clean.agg(
        F.lit("no_imputed_row_without_method").alias("gate"),
        F.count(F.lit(1)).alias("element_count"),
        F.lit(0).cast("long").alias("null_count"),
        F.count_if(F.col("is_imputed") & F.col("imputation_method").isNull()).alias("unexpected_count"),
    )
    return union_all([range_rows, cov_row, id_row, method_row]).select(
        "gate", (F.col("unexpected_count") == 0).alias("success"), "element_count", "null_count", "unexpected_count"
    )


def gate_samples(clean: DataFrame, distances: DataFrame, opts: GateOptions = GateOptions(), k: int = 20) -> DataFrame:
    """Up to ``k`` offending values per range gate, smallest first (a bounded top-k per gate)."""
    rows = _plausible_rows(clean, distances, opts)
    parts = []
    for name, (belongs, value, bad) in _fare_tests(opts).items():
        parts.append(
            rows.where(belongs & bad)
            .select(F.lit(name).alias("gate"), value.alias("value"), "quote_id")
            .orderBy("value", "quote_id")
            .limit(k)
        )
    return union_all(parts)


def assert_gates(report: DataFrame) -> None:
    """Action: raise with the whole report when a gate failed (a handful of rows)."""
    rows = [r.asDict() for r in report.collect()]
    if not all(r["success"] for r in rows):
        raise GateFailure(rows)


# --- row rules ------------------------------------------------------------------------------


QUOTE_RULES: Mapping[str, str] = {
    "total_non_negative": "total_fare >= 0",
    "base_non_negative": "base_fare >= 0",
    "taxes_non_negative": "taxes >= 0",
    "udf_non_negative": "udf >= 0",
    "fee_non_negative": "convenience_fee >= 0",
    "stops_in_range": "stops between 0 and 4",
    "lead_in_range": "advance_days between 0 and 365",
    "travel_not_before_query": "travel_date >= query_date",
    "currency_is_three_letters": "length(currency) = 3",
    "seats_non_negative": "seats_shown >= 0",
}
CLEAN_RULES: Mapping[str, str] = {
    "traceable_or_imputed": "quote_id is not null or is_imputed",
    "outlier_has_rule": "not is_outlier or outlier_rule is not null",
    "imputed_has_method": "not is_imputed or imputation_method is not null",
    "hour_in_range": "dep_hour_bucket between 0 and 23",
    "stops_in_range": "stops between 0 and 4",
}
ROUTE_RULES: Mapping[str, str] = {
    "endpoints_differ": "origin_iata <> dest_iata",
    "share_is_fraction": "pax_share between 0 and 1",
}
VALUE_RULES: Mapping[str, str] = {
    "value_positive": "value > 0",
    "quotes_non_negative": "n_quotes >= 0",
    "coverage_is_percentage": "coverage_pct between 0 and 100",
}
RUN_RULES: Mapping[str, str] = {
    "finish_after_start": "finished_at >= started_at",
    "quotes_non_negative": "quotes_collected >= 0",
    "blocked_non_negative": "blocked_count >= 0",
    "status_known": "status in ('PENDING','RUNNING','SUCCEEDED','PARTIAL','BLOCKED','FAILED')",
}
NOWCAST_RULES: Mapping[str, str] = {"interval_ordered": "ci_low <= ci_high"}


def _counts(rules: Mapping[str, str]) -> list[Column]:
    """The number of rows and, rule by rule, of rows that break it."""
    return [F.count(F.lit(1)).alias("__rows"), *[F.count_if(~F.expr(e)).alias(f"__{i}") for i, e in enumerate(rules.values())]]


def rule_report(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows breaking each rule; as with a CHECK constraint, an unknown (null) outcome passes."""
    agg = df.agg(*_counts(rules))
    items = [
        F.struct(F.lit(name).alias("rule"), F.col("__rows").alias("row_count"), F.col(f"__{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return agg.select(F.inline(F.array(*items)))


def write_checked(df: DataFrame, rules: Mapping[str, str], write: Callable[[DataFrame], None]) -> DataFrame:
    """Write a table and report its rules from the same pass: the counts are observed while ``write`` runs its one action over the rows it is
    given. The report has the columns of ``rule_report``; a table without rows reports zeros."""
    seen = Observation()
    write(df.observe(seen, *_counts(rules)))
    found = seen.get
    rows = [(name, found["__rows"], found[f"__{i}"]) for i, name in enumerate(rules)]
    return df.sparkSession.createDataFrame(rows, "rule string, row_count long, violations long")


def rule_violations(df: DataFrame, rules: Mapping[str, str], keys) -> DataFrame:
    """Row level: the keys of every offending row with the rules it breaks."""
    broken = F.filter(
        F.array(*[F.when(~F.expr(e), F.lit(n)) for n, e in rules.items()]), lambda x: x.isNotNull()
    )
    return df.select(*keys, broken.alias("broken_rules")).where(F.size("broken_rules") > 0)


def quote_shape_ok() -> Column:
    """Canonical-quote validity: non-negative total, 0-4 stops, three-letter currency."""
    return (F.col("total_fare") >= 0) & F.col("stops").between(0, 4) & F.col("currency").rlike("^[A-Za-z]{3}$")


def detection_recall(labels: DataFrame, flagged: DataFrame, key: str = "quote_id") -> DataFrame:
    """Per anomaly kind: labelled rows, rows flagged, recall."""
    hit = flagged.select(key).distinct().withColumn("__hit", F.lit(1))
    return (
        null_safe_join(labels, hit, [key], "left")
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("labelled"), F.count("__hit").alias("flagged"))
        .withColumn("recall", F.col("flagged") / F.col("labelled"))
    )
