"""Extending published series by one period, and the rows a publication run writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.core import month_start, require

# Relative tolerance below which a recomputed value is no revision, and the reasons
# written to the revision log.
REVISION_TOLERANCE = 1e-9
RECOMPUTED = "recomputed under the same (snapshot, config) key"
FIRST_OF_PERIOD = "First publication of the period."
FIRST_OF_SERIES = "First publication of the reference period, at the configured reference value."

# k rule: given the window length L, which link periods k enter (None: all of them, geometric mean)
_SPLICES: dict[str, Callable[[Column], Column] | None] = {
    "movement": lambda n: F.lit(1),
    "window": lambda n: n - 1,
    "half": lambda n: F.ceil((n - 1) / 2),
    "fbew": lambda n: n - 1,
    "fbmw": lambda n: n - 1,
    "mean": None,
}


def register_splice(name: str, k_rule: Callable[[Column], Column] | None) -> None:
    """Add a splice: a function from the window-length column to the link distance k."""
    _SPLICES[name] = k_rule


def link_estimates(windows: DataFrame, published: DataFrame) -> DataFrame:
    """All links at once: per series and distance k >= 1, ``estimate`` = published value k periods
    back x window growth since then. ``windows``: (series_code, period, level)."""
    require(windows, ["series_code", "period", "level"], "splice")
    require(published, ["series_code", "period", "value"], "splice")
    newest_first = Window.partitionBy("series_code").orderBy(F.col("period").desc())
    whole = newest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = windows.select(
        "series_code",
        "period",
        "level",
        (F.row_number().over(newest_first) - 1).alias("k"),
        F.count(F.lit(1)).over(whole).alias("length"),
        F.first("level").over(whole).alias("newest_level"),
        F.last("level").over(whole).alias("oldest_level"),
        F.first("period").over(whole).alias("newest_period"),
        F.min("level").over(whole).alias("min_level"),
    )
    j = w.join(published.select("series_code", "period", F.col("value").cast("double").alias("pub")), ["series_code", "period"], "left")
    return j.withColumn("estimate", F.when(F.col("k") > 0, F.try_divide(F.col("pub") * F.col("newest_level"), F.col("level"))))


def chosen(method: str, k: Column, length: Column) -> Column:
    if method not in _SPLICES:
        raise ValueError(f"unknown splice {method!r}; have {sorted(_SPLICES)}")
    rule = _SPLICES[method]
    return (k >= 1) if rule is None else (k == rule(length))


def splice_all(windows: DataFrame, published: DataFrame, methods=tuple(_SPLICES)) -> DataFrame:
    """Every splice side by side, one row per series."""
    e = link_estimates(windows, published)
    ln = F.log("estimate")
    return (
        e.where(F.col("k") >= 1)
        .groupBy("series_code")
        .agg(
            F.max("newest_period").alias("period"),
            *[F.exp(F.avg(F.when(chosen(m, F.col("k"), F.col("length")), ln))).alias(m) for m in methods],
        )
    )


def publish(
    windows: DataFrame,
    published: DataFrame,
    coverage: DataFrame,
    method: str = "movement",
    on_gap: str = "ratio",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, revisions, skips) for the newest period of every series.

    Splices when every earlier window period is published; otherwise the value is the window's own
    growth (``on_gap="ratio"``) or the series is skipped (``on_gap="skip"``, unless it has no
    history at all). A period already published gets a revision row when it moves by more than
    1e-9 relative. ``coverage``: (series_code, n_quotes, coverage_pct).
    """
    e = link_estimates(windows, published)
    ln = F.when(chosen(method, F.col("k"), F.col("length")), F.log("estimate"))
    per_series = e.groupBy("series_code").agg(
        F.max("newest_period").alias("period"),
        F.max("length").alias("length"),
        F.max("newest_level").alias("__new"),
        F.max("oldest_level").alias("__old"),
        F.min("min_level").alias("__min"),
        F.count_if((F.col("k") > 0) & F.col("pub").isNull()).alias("__gaps"),
        F.max(F.when(F.col("k") == 0, F.col("pub"))).alias("old_value"),
        F.exp(F.avg(ln)).alias("__spliced"),
    )
    history = published.groupBy("series_code").agg(F.count(F.lit(1)).alias("__hist"))
    s = per_series.join(history, "series_code", "left").join(coverage, "series_code", "left")
    linked = (F.col("length") > 1) & (F.col("__gaps") == 0)
    s = s.withColumn("value", F.when(linked, F.col("__spliced")).otherwise(F.try_divide("__new", "__old")))
    reason = F.when(F.col("__min") <= 0, "window levels must be strictly positive").when(
        F.col("n_quotes").isNull(), "no coverage entry for the series"
    )
    if on_gap == "skip":
        reason = reason.when(
            ~linked & F.col("__hist").isNotNull() & (F.col("length") > 1), "an earlier window period is not published"
        )
    s = s.withColumn("skip_reason", reason)
    ok = s.where(F.col("skip_reason").isNull())
    values = ok.select("series_code", "period", "value", "n_quotes", "coverage_pct")
    scale = F.greatest(F.lit(1.0), F.abs("old_value"))
    revisions = ok.where(
        F.col("old_value").isNotNull() & (F.abs(F.col("value") - F.col("old_value")) > F.lit(REVISION_TOLERANCE) * scale)
    ).select(
        "series_code",
        "period",
        "old_value",
        F.col("value").alias("new_value"),
        F.lit(RECOMPUTED).alias("reason"),
    )
    return values, revisions, s.where(F.col("skip_reason").isNotNull()).select("series_code", "skip_reason")


def rebase_due(series: DataFrame, interval: int, keys=("series_code",)) -> DataFrame:
    """Periods since the last rebase flag per series, and whether a rebase is due."""
    order = Window.partitionBy(*keys).orderBy("period")
    pos = series.withColumn("__rn", F.row_number().over(order))
    return (
        pos.withColumn("__last", F.coalesce(F.last(F.when(F.col("is_rebase"), F.col("__rn")), True).over(order), F.lit(1)))
        .withColumn("periods_since_rebase", F.col("__rn") - F.col("__last"))
        .withColumn("rebase_due", F.col("periods_since_rebase") >= interval)
        .drop("__rn", "__last")
    )


def publication_rows(
    current: DataFrame,
    prior: DataFrame,
    published: DataFrame,
    as_of: Column,
    reference_value: float = 100.0,
    method: str = "movement",
    on_gap: str = "ratio",
) -> dict[str, DataFrame]:
    """Rows of one run over stored tables: ``index_value``, ``revision_log`` and ``skipped``.

    ``current``/``prior``: hierarchy rows (series_code, index_value, n_quotes, coverage_pct) at the
    two ends of the window. A series without any history starts at ``reference_value`` in the
    previous month; first publications are logged with a null old value.
    """
    this_month = month_start(as_of)
    last_month = F.add_months(this_month, -1)
    base = prior.select("series_code", F.col("index_value").alias("__prior"))
    cur = current.join(base, "series_code", "left")
    new_series = cur.select("series_code").join(published.select("series_code").distinct(), "series_code", "left_anti")
    boot = new_series.select("series_code", last_month.alias("period"), F.lit(float(reference_value)).alias("value"))
    known = published.select("series_code", "period", F.col("value").cast("double").alias("value")).unionByName(boot)
    windows = cur.select("series_code", last_month.alias("period"), F.coalesce("__prior", "index_value").alias("level")).unionByName(
        cur.select("series_code", this_month.alias("period"), F.col("index_value").alias("level"))
    )
    values, revisions, skips = publish(
        windows, known, current.select("series_code", "n_quotes", "coverage_pct"), method, on_gap
    )
    boot_values = boot.select(
        "series_code", "period", "value", F.lit(0).cast("long").alias("n_quotes"), F.lit(None).cast("double").alias("coverage_pct")
    )
    first = values.join(known.select("series_code", "period"), ["series_code", "period"], "left_anti")
    cols = ["series_code", "period", "old_value", "new_value", "reason"]
    null = F.lit(None).cast("double").alias("old_value")
    log = (
        revisions.select(cols)
        .unionByName(
            first.select(
                "series_code", "period", null, F.col("value").alias("new_value"),
                F.lit(FIRST_OF_PERIOD).alias("reason"),
            )
        )
        .unionByName(
            boot.select(
                "series_code", "period", null, F.col("value").alias("new_value"),
                F.lit(FIRST_OF_SERIES).alias("reason"),
            )
        )
    )
    dropped = prior.select("series_code").join(current.select("series_code"), "series_code", "left_anti").withColumn(
        "skip_reason", F.lit("present at the window start only")
    )
    return {
        "index_value": values.unionByName(boot_values),
        "revision_log": log,
        "skipped": skips.unionByName(dropped),
    }


def lineage(clean: DataFrame, current: DataFrame, as_of: Column, prefix: str = "PX") -> DataFrame:
    """(series_code, period, clean_id): rows behind the headline and each route series."""
    rows = clean.where((F.col("query_date") == as_of) & ~F.col("is_outlier"))
    codes = F.array(F.lit(f"{prefix}.ALL.M"), F.concat(F.lit(f"{prefix}.ROUTE."), F.col("route_code"), F.lit(".M")))
    edges = rows.select(F.explode(codes).alias("series_code"), month_start(as_of).alias("period"), "clean_id")
    return edges.join(current.select("series_code"), "series_code", "left_semi")
