"""Questions asked of cleaned quotes and published series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.config import ADVANCE_WINDOWS
from quotemill.functions.core import exact_avg, null_safe_join
from quotemill.functions.quantiles import grouped_quantiles, quantiles_of_counts, value_counts
from quotemill.operators.cleaning import window_code

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return grouped_quantiles(df, keys, value, {name: 0.5})


def mean_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact mean and count from a (keys, v, n) table."""
    return counts.groupBy(*keys).agg(
        (F.sum(F.col("v") * F.col("n")).cast("double") / F.sum("n")).alias("mean_fare"), F.sum("n").alias("n_quotes")
    )


def mean_and_median(df: DataFrame, keys: Sequence[str], price: str = "total_fare") -> DataFrame:
    counts = value_counts(df, keys, price)
    mid = quantiles_of_counts(counts, keys, {"median_fare": 0.5}).drop("n_values")
    return null_safe_join(mean_of_counts(counts, keys), mid, keys)


# --- lead time ------------------------------------------------------------------------------


def lead_time_curve(
    clean: DataFrame, keys: Sequence[str] = (), lead: str = "advance_days", price: str = "total_fare", windows=ADVANCE_WINDOWS
) -> DataFrame:
    """Per window: mean, quote-weighted mean of per-day medians, true quartiles, index against the
    cheapest window of the group (cheapest = 100, one decimal)."""
    keys = list(keys)
    q = clean.where(~F.col("is_outlier")).withColumn("window_code", window_code(lead, windows))
    q = q.where(F.col("window_code").isNotNull())
    group = [*keys, "window_code"]
    counts = value_counts(q, [*group, lead], price)  # every figure below comes from this table
    by_day = [*group, lead]
    median = quantiles_of_counts(counts, by_day, {"median_fare": 0.5}).drop("n_values")
    per_day = null_safe_join(mean_of_counts(counts, by_day), median, by_day)
    folded = null_safe_join(
        mean_of_counts(counts, group),
        per_day.groupBy(*group).agg(
            (F.sum(F.col("median_fare") * F.col("n_quotes")) / F.sum("n_quotes")).alias("median_fare")
        ),
        group,
    )
    whole = counts.groupBy(*group, "v").agg(F.sum("n").alias("n"))
    true = quantiles_of_counts(whole, group, {"p25_fare": 0.25, "true_median": 0.5, "p75_fare": 0.75}).drop("n_values")
    out = null_safe_join(folded, true, group)
    # a group holds one row per window, so this window is bounded by the window list
    cheapest = F.min("mean_fare").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return out.withColumn("index_vs_cheapest", F.round(F.lit(100.0) * F.col("mean_fare") / cheapest, 1))


def lead_time_inflection(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last window (furthest from departure) attaining the minimum mean fare."""
    return curve.groupBy(*keys).agg(
        F.max_by("window_code", F.struct(-F.col("mean_fare"), F.col("window_code"))).alias("window_code"),
        F.min("mean_fare").alias("mean_fare"),
    )


def route_fare_series(clean: DataFrame, keys: Sequence[str], lead: int | None = 14, price: str = "total_fare") -> DataFrame:
    """Fare series at one lead: mean, quartiles, quotes, and whether every row was imputed."""
    q = clean if lead is None else clean.where(F.col("advance_days") == lead)
    base = q.groupBy(*keys).agg(
        exact_avg(price).alias("mean_fare"), F.count(F.lit(1)).alias("n_quotes"), F.bool_and("is_imputed").alias("sold_out")
    )
    return null_safe_join(base, grouped_quantiles(q, keys, price, QUARTILES).drop("n_values"), keys, "left")


def relative_to_lead(clean: DataFrame, keys: Sequence[str], base_lead: int = 45, price: str = "total_fare") -> DataFrame:
    """Median fare by lead relative to the median at ``base_lead``."""
    m = grouped_median(clean, [*keys, "advance_days"], price, "median_fare").drop("n_values")
    base = m.where(F.col("advance_days") == base_lead).select(*keys, F.col("median_fare").alias("__base"))
    on = list(keys)
    if not on:
        m, base, on = m.withColumn("__k", F.lit(1)), base.withColumn("__k", F.lit(1)), ["__k"]
    out = null_safe_join(m, base, on).withColumn("relative", F.try_divide("median_fare", "__base"))
    return out.drop("__base", "__k")


def calendar_contrast(clean: DataFrame, day: str, spans: DataFrame, keys: Sequence[str], price: str = "total_fare") -> DataFrame:
    """Median inside and outside calendar spans (calendar_day rows, one per day)."""
    days = spans.select(F.col("calendar_day").alias("__d")).distinct().withColumn("__in", F.lit(True))
    q = clean.join(days, clean[day] == days["__d"], "left").withColumn("inside", F.coalesce("__in", F.lit(False)))
    return grouped_median(q, [*keys, "inside"], price, "median_fare")


# --- series ---------------------------------------------------------------------------------


def movers(cells: DataFrame, k: int = 4, key: str = "route_code") -> DataFrame:
    """Top ``k`` by absolute change between the two latest periods of each key."""
    return momentum(cells, key).orderBy(F.abs("momentum_pct").desc(), key).limit(k)


def momentum(cells: DataFrame, key: str = "route_code") -> DataFrame:
    """Latest against previous row of each key. One row per (key, period), so the window is bounded
    by the calendar."""
    order = Window.partitionBy(key).orderBy("period")
    last = F.max("period").over(Window.partitionBy(key))
    return (
        cells.withColumn("__prev", F.lag("value").over(order))
        .withColumn("__last", last)
        .where((F.col("period") == F.col("__last")) & F.col("__prev").isNotNull())
        .select(
            key,
            (F.try_divide(F.col("value") - F.col("__prev"), F.col("__prev")) * 100).alias("momentum_pct"),
            F.col("value").alias("latest_value"),
            F.col("period").alias("latest_period"),
        )
    )


def corridors(routes: DataFrame, cells: DataFrame) -> DataFrame:
    """Routes with both coordinates, with their momentum; no history gives 0."""
    located = routes.where(
        F.col("origin_lat").isNotNull() & F.col("origin_lon").isNotNull() & F.col("dest_lat").isNotNull() & F.col("dest_lon").isNotNull()
    )
    m = momentum(cells).select("route_code", "momentum_pct")
    return located.join(m, "route_code", "left").withColumn("momentum_pct", F.coalesce("momentum_pct", F.lit(0.0)))


def heatmap(latest: DataFrame, key: str = "route_code") -> DataFrame:
    """Deviation of each (route, period) from the route's own mean, with the largest absolute
    deviation of the whole map (at least 1) for scaling."""
    mean = latest.groupBy(key).agg(F.avg("value").alias("__mean"))
    cells = latest.join(mean, key).withColumn("deviation_pct", F.try_divide(F.col("value") - F.col("__mean"), F.col("__mean")) * 100)
    return cells.drop("__mean")


def heatmap_scale(cells: DataFrame) -> DataFrame:
    return cells.agg(F.greatest(F.lit(1.0), F.max(F.abs("deviation_pct"))).alias("max_abs_deviation"))


def contributors(latest: DataFrame, weights: DataFrame, period) -> DataFrame:
    """Route values behind the headline of one period. Where the weight is known, ``contribution``
    is the route's share times its log level, so contributions sum to the log headline."""
    rows = latest.where(F.col("period") == period).join(weights.select("route_code", "weight"), "route_code", "left")
    total = rows.agg(F.sum("weight").alias("__t")).withColumn("__k", F.lit(1))
    j = rows.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k").drop("__k")  # one-row total
    return j.withColumn("contribution", F.try_divide("weight", "__t") * F.log("value")).drop("__t")


def cleaned_quotes_view(clean: DataFrame, quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """Cleaned rows with their source code; imputed rows are labelled ``imputed``."""
    src = quotes.select(F.col("quote_id").alias("quote_id"), "source_id").join(sources, "source_id", "left")
    # imputed rows have no quote id: a number of their own spreads them over all tasks, and matches nothing
    spread = F.when(F.col("quote_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    keyed = clean.withColumn("__spread", spread)
    out = keyed.join(src.select("quote_id", F.lit(0).cast("long").alias("__spread"), "source_code"), ["quote_id", "__spread"], "left").drop("__spread")
    return out.withColumn("source_code", F.coalesce("source_code", F.lit("imputed")))


def route_with_airports(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Routes with both airports' attributes."""
    a = airports.select(*[F.col(c).alias(f"origin_{c}") for c in airports.columns])
    b = airports.select(*[F.col(c).alias(f"dest_{c}") for c in airports.columns])
    return routes.join(a, "origin_iata").join(b, "dest_iata")


def active_routes(routes: DataFrame, on: Column, basket_version: str | None = None) -> DataFrame:
    live = (F.col("active_from") <= on) & (F.col("active_to").isNull() | (F.col("active_to") > on))
    r = routes.where(live)
    return r if basket_version is None else r.where(F.col("basket_version") == basket_version)


# --- collection -----------------------------------------------------------------------------


def daily_route_coverage(runs: DataFrame, routes: DataFrame, ran=("SUCCEEDED",)) -> DataFrame:
    """Per day: routes covered by a successful run, basket size, coverage percentage."""
    basket = routes.select("route_code").distinct()
    good = runs.where(F.col("status").isin(*ran)).join(basket, "route_code", "left_semi")
    covered = good.groupBy("query_date").agg(F.count_distinct("route_code").alias("routes_covered"))
    size = basket.agg(F.count(F.lit(1)).alias("routes_expected"))  # one row
    out = runs.select("query_date").distinct().join(covered, "query_date", "left").crossJoin(F.broadcast(size))
    n = F.coalesce("routes_covered", F.lit(0).cast("long"))
    return out.select(
        "query_date", n.alias("routes_covered"), "routes_expected", F.round(F.lit(100.0) * n / F.col("routes_expected"), 1).alias("coverage_pct")
    )


def routes_missing(runs: DataFrame, routes: DataFrame, ran=("SUCCEEDED",)) -> DataFrame:
    """Basket routes without a successful run, per day that had any run."""
    good = runs.where(F.col("status").isin(*ran)).select("query_date", "route_code").distinct()
    days = runs.select("query_date").distinct()
    span = days.agg(F.min("query_date").alias("__from"), F.max("query_date").alias("__to"))  # one row
    # each route's own calendar, then the days on which anything ran
    calendar = routes.select("route_code").distinct().crossJoin(F.broadcast(span)).select("route_code", F.explode(F.sequence("__from", "__to")).alias("query_date"))
    planned = calendar.join(days, "query_date", "left_semi").select("query_date", "route_code")
    return planned.join(good, ["query_date", "route_code"], "left_anti")


def source_coverage(sources: DataFrame, runs: DataFrame, day) -> DataFrame:
    """Every source with the sums of its runs inside [day, day + 1), also sources without runs."""
    start = F.lit(day).cast("timestamp")
    inside = runs.where((F.col("started_at") >= start) & (F.col("started_at") < start + F.expr("interval 1 day")))
    per = inside.groupBy("source_code").agg(
        F.sum("quotes_collected").alias("quotes_collected"), F.sum("blocked_count").alias("blocked_count")
    )
    q = F.coalesce("quotes_collected", F.lit(0).cast("long"))
    return sources.join(per, "source_code", "left").select(
        "source_code",
        F.when(~F.col("enabled"), "DISABLED").when(q > 0, "OK").otherwise("PARTIAL").alias("status"),
        q.alias("quotes_collected"),
        F.coalesce("blocked_count", F.lit(0).cast("long")).alias("blocked_count"),
        F.when(~F.col("enabled"), "source is not enabled").alias("reason"),
    )


def sweep_summary(outcomes: DataFrame) -> DataFrame:
    """Sweep totals and per-source counts in one rollup; the grand total has ``ALL`` as source."""
    s = F.lower("status")
    out = outcomes.rollup("source_code").agg(
        F.grouping("source_code").alias("__all"),
        F.count(F.lit(1)).alias("cells"),
        *[F.count_if(s == k).alias(k) for k in ("succeeded", "blocked", "failed")],
        F.sum("quotes").alias("quotes"),
    )
    return out.withColumn("source_code", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("source_code"))).drop("__all")


def index_staleness(runs: DataFrame, now) -> DataFrame:
    """Seconds since the newest released run was computed."""
    r = runs.where(F.col("released_at").isNotNull())
    return r.agg((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("computed_at"))).alias("staleness_seconds"))


def latest_coverage(values: DataFrame, runs: DataFrame) -> DataFrame:
    """Coverage of each series in its latest released run."""
    j = values.join(runs.where(F.col("released_at").isNotNull()).select("index_run_id", "computed_at"), "index_run_id")
    return j.groupBy("series_code").agg(
        F.max_by("coverage_pct", F.struct("computed_at", "period")).alias("coverage_pct"), F.max("computed_at").alias("computed_at")
    )


def source_success_share(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_code").agg(
        (F.count_if(F.col("status") == "SUCCEEDED") / F.count(F.lit(1))).alias("success_share"), F.count(F.lit(1)).alias("runs")
    )


def runs_per_day(quotes: DataFrame, channel: str = "source_code", day: str = "query_date") -> DataFrame:
    return quotes.groupBy(channel, day).agg(F.count(F.lit(1)).alias("quotes_collected"))
