"""Reading published series: latest vintages, values as known on a date, status and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.core import case_chain


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per key. ``max_by`` combines map-side, so a hot key is
    reduced before the shuffle; a row_number window would sort the whole key in one task."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("__row"), F.count(F.lit(1)).alias("__versions")
    ).select(*keys, "__row.*", "__versions")


def visible_runs(runs: DataFrame, role: str = "public") -> DataFrame:
    """Public readers see released runs only."""
    return runs.where(F.col("released_at").isNotNull()) if role == "public" else runs


def latest_values(
    values: DataFrame,
    runs: DataFrame,
    revisions: DataFrame | None = None,
    role: str = "public",
    period_from=None,
    period_to=None,
) -> DataFrame:
    """Latest vintage per (series, period), with its revision count."""
    v = values
    if period_from is not None:
        v = v.where(F.col("period") >= F.lit(period_from))
    if period_to is not None:
        v = v.where(F.col("period") <= F.lit(period_to))
    r = visible_runs(runs, role).select("index_run_id", "vintage_date", "computed_at", "released_at")
    cols = [c for c in v.columns if c not in ("series_code", "period")] + ["vintage_date", "computed_at", "released_at"]
    out = newest(v.join(r, "index_run_id"), ["series_code", "period"], ["vintage_date", "computed_at", "index_run_id"], cols)
    out = out.drop("__versions")
    if revisions is not None:
        out = out.join(revision_counts(revisions), ["series_code", "period"], "left").withColumn(
            "revision_count", F.coalesce("revision_count", F.lit(0).cast("long"))
        )
    return out


def value_as_of(values: DataFrame, runs: DataFrame, requests, role: str = "public") -> DataFrame:
    """Values as they stood on given dates, many questions in one plan.

    ``requests`` is a list of dates asked of every point, or a frame (series_code, as_of[, period]).
    Vintages dated up to and including ``as_of`` count, the newest wins.
    """
    r = visible_runs(runs, role).select("index_run_id", "vintage_date", "computed_at")
    v = values.join(r, "index_run_id")
    if isinstance(requests, DataFrame):
        j = v.join(requests, [c for c in ("series_code", "period") if c in requests.columns])
        j = j.where(F.col("vintage_date") <= F.col("as_of"))
    else:
        dates = F.array(*[F.lit(d).cast("date") for d in requests])
        j = v.withColumn("as_of", F.explode(F.filter(dates, lambda d: F.col("vintage_date") <= d)))
    return newest(
        j,
        ["series_code", "period", "as_of"],
        ["vintage_date", "computed_at", "index_run_id"],
        ["value", "vintage_date", "index_run_id"],
    ).drop("__versions")


def latest_matching_revision(revisions: DataFrame, points: DataFrame) -> DataFrame:
    """Newest revision that produced each point's value; null columns where none did."""
    exact = lambda c: F.col(c).cast("decimal(14,6)").alias("__value")
    made = revisions.select("series_code", "period", exact("new_value"), "reason", "revised_at")
    j = points.select("series_code", "period", exact("value")).join(made, ["series_code", "period", "__value"], "left")
    return j.groupBy("series_code", "period").agg(
        F.max_by("reason", "revised_at").alias("reason"), F.max("revised_at").alias("revised_at")
    )


def latest_run(values: DataFrame, runs: DataFrame, keys: Sequence[str] = (), role: str = "public") -> DataFrame:
    """Latest visible run that touched the given series."""
    touched = values.select("index_run_id", *keys).distinct().join(visible_runs(runs, role), "index_run_id")
    return touched.groupBy(*keys).agg(
        F.max_by("index_run_id", F.struct("computed_at", "index_run_id")).alias("index_run_id"), F.max("computed_at").alias("computed_at")
    )


def revision_counts(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("series_code", "period").agg(F.count(F.lit(1)).alias("revision_count"))


def revision_runs(revisions: DataFrame, values: DataFrame, runs: DataFrame) -> DataFrame:
    """Which run produced each revision: matched on (series, period, value), newest run kept."""
    exact = lambda c: F.col(c).cast("decimal(14,6)")
    produced = values.select("series_code", "period", exact("value").alias("__value"), "index_run_id").join(
        runs.select("index_run_id", "computed_at", "vintage_date"), "index_run_id"
    )
    one = newest(
        produced, ["series_code", "period", "__value"], ["computed_at", "index_run_id"], ["index_run_id", "vintage_date", "computed_at"]
    ).drop("__versions")
    return revisions.withColumn("__value", exact("new_value")).join(one, ["series_code", "period", "__value"], "left").drop("__value")


def imputed_points(lineage: DataFrame, clean: DataFrame) -> DataFrame:
    """Distinct (run, period) with at least one imputed contributing row."""
    bad = clean.where(F.col("is_imputed")).select("clean_id")
    return lineage.join(bad, "clean_id", "left_semi").select("index_run_id", "period").distinct()


def point_status(latest: DataFrame) -> DataFrame:
    """PROVISIONAL until released, then REVISED once a revision is logged for the point."""
    return latest.withColumn(
        "status",
        case_chain(
            [(F.col("released_at").isNull(), "PROVISIONAL"), (F.col("revision_count") > 0, "REVISED")], "PUBLISHED"
        ),
    )


# --- series codes ---------------------------------------------------------------------------


def series_like(series: DataFrame, prefix: str) -> DataFrame:
    return series.where(F.col("series_code").startswith(prefix))


def series_dimensions(code: str = "series_code") -> Column:
    """Map of dimensions carried by a code such as ``PX.ROUTE.X.M``."""
    parts = F.split(F.col(code), r"\.")
    kind, value = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return case_chain(
        [
            (kind == "ALL", F.create_map(F.lit("scope"), F.lit("national"))),
            (kind == "ROUTE", F.create_map(F.lit("route_code"), value)),
            (kind == "CARRIERTYPE", F.create_map(F.lit("carrier_type"), value)),
            (kind == "WINDOW", F.create_map(F.lit("advance_window"), value)),
        ]
    )


def series_code_for_key(key: str = "key", prefix: str = "PX") -> Column:
    """FREQ.ROUTE.CARRIER.WINDOW -> series code; the first of route, carrier, window that is not
    ``ALL`` decides. A key without four parts gives null."""
    parts = F.split(F.col(key), r"\.")
    route, carrier, window = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    code = lambda kind, v: F.concat(F.lit(f"{prefix}.{kind}."), v, F.lit(".M"))
    return F.when(
        F.size(parts) == 4,
        case_chain(
            [(route != "ALL", code("ROUTE", route)), (carrier != "ALL", code("CARRIERTYPE", carrier)), (window != "ALL", code("WINDOW", window))],
            f"{prefix}.ALL.M",
        ),
    )


# --- knowledge time -------------------------------------------------------------------------


class LookAheadError(ValueError):
    """Rows known only after the as-of date."""


def as_of_literal(as_of) -> Column:
    """A bare date means midnight; a naive time is read in the session zone (UTC)."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, (date, datetime, str)):
        return F.lit(as_of).cast("timestamp")
    raise TypeError(f"unsupported as_of {as_of!r}")


def filter_as_of(df: DataFrame, as_of, ts: str = "collected_at") -> DataFrame:
    """Rows known at ``as_of``, inclusive."""
    return df.where(F.col(ts) <= as_of_literal(as_of))


def look_ahead_report(df: DataFrame, as_of, ts: str = "collected_at", keys: Sequence[str] = ()) -> DataFrame:
    late = F.col(ts) > as_of_literal(as_of)
    return df.groupBy(*keys).agg(F.count_if(late).alias("late_rows"), F.max(F.when(late, F.col(ts))).alias("latest"))


def assert_no_look_ahead(df: DataFrame, as_of, ts: str = "collected_at") -> None:
    """Action: one aggregate row decides."""
    r = look_ahead_report(df, as_of, ts).first()
    if r["late_rows"]:
        raise LookAheadError(f"{r['late_rows']} rows known after {as_of}; latest {r['latest']}")


def latest_known(df: DataFrame, as_of, keys: Sequence[str], value: str, ts: str = "collected_at") -> DataFrame:
    """Newest version of each key among rows known at ``as_of``."""
    return filter_as_of(df, as_of, ts).groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def share_within(df: DataFrame, keys: Sequence[str], weight: str, name: str = "share") -> DataFrame:
    """Weight over its group's total; totals are aggregated and joined back, so a hot group is
    never sorted in one task."""
    from quotemill.functions.core import null_safe_join

    total = df.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    return null_safe_join(df, total, keys).withColumn(name, F.try_divide(weight, "__total")).drop("__total")


def month_changes(series: DataFrame, keys: Sequence[str] = ("series_code",), previous_row: bool = True) -> DataFrame:
    """Month-over-month and year-over-year change. MoM uses the previous row of the series, or the exact
    previous month without ``previous_row``; YoY needs the month twelve earlier, else a reason."""
    keys = list(keys)

    def shifted(months: int, name: str) -> DataFrame:
        return series.select(*keys, F.add_months("period", months).alias("period"), F.col("value").alias(name))

    if previous_row:
        order = Window.partitionBy(*keys).orderBy("period")
        out = series.withColumn("__prev", F.lag("value").over(order))
    else:
        out = series.join(shifted(1, "__prev"), [*keys, "period"], "left")
    out = out.join(shifted(12, "__year"), [*keys, "period"], "left")
    pct = lambda base: F.try_divide(F.col("value") - F.col(base), F.col(base)) * 100
    return out.select(
        *keys,
        "period",
        "value",
        pct("__prev").alias("mom_pct"),
        pct("__year").alias("yoy_pct"),
        F.when(F.col("__prev").isNull(), "fewer than two periods" if previous_row else "no value one month earlier").alias("mom_reason"),
        F.when(F.col("__year").isNull(), "no value twelve months earlier").alias("yoy_reason"),
    )
