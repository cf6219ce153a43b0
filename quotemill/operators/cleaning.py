"""Row screening, cross-source matching, component split, outlier flags and quality vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.config import ADVANCE_WINDOWS
from quotemill.functions import quantiles as Q
from quotemill.functions.core import case_chain, null_safe_join, require
from quotemill.functions.staging import discard, staged
from quotemill.functions.hashing import FLIGHT_KEY_NAMESPACE, uuid5

REQUIRED_DIMENSIONS = ("route_id", "carrier_iata", "travel_date", "advance_days")


# --- malformed rows -------------------------------------------------------------------------


def flag_malformed(
    quotes: DataFrame,
    required: Sequence[str] = REQUIRED_DIMENSIONS,
    price: str = "total_fare",
) -> DataFrame:
    """Add ``quarantine_reason``: null for a good row. A missing dimension outranks a bad price."""
    require(quotes, [*required, price], "flag_malformed")
    value = F.expr(f"try_cast({price} as double)")
    if dict(quotes.dtypes)[price] == "string":  # the cast also reads type suffixes such as 12d
        value = F.when(F.col(price).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), value)
    bad_price = value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf"))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    reason = case_chain([(missing, "missing_identity_dimension"), (bad_price, "invalid_total_fare")])
    return quotes.withColumn("quarantine_reason", reason)


def quarantine_malformed(
    quotes: DataFrame,
    required: Sequence[str] = REQUIRED_DIMENSIONS,
    price: str = "total_fare",
) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined). Nothing is dropped or repaired."""
    flagged = flag_malformed(quotes, required, price)
    kept = flagged.where(F.col("quarantine_reason").isNull()).drop("quarantine_reason")
    return kept, flagged.where(F.col("quarantine_reason").isNotNull())


# --- cross-source matching ------------------------------------------------------------------


def departure_clusters(
    quotes: DataFrame, keys: Sequence[str], departure: str, tolerance: int
) -> DataFrame:
    """(keys, departure, cluster): greedy clusters measured from each cluster's first departure.

    Whether a departure opens a cluster depends only on the distinct departures of its group, so
    rows are reduced to those first (map-side), and the fold runs over clock readings of one
    flight-day, never over quotes. ``departure`` is any number (seconds, minutes).
    """
    instants = quotes.groupBy(*keys, departure).agg(F.lit(1).alias("__one"))
    grouped = instants.groupBy(*keys).agg(F.array_sort(F.collect_list(departure)).alias("__ts"))
    start = F.struct(
        F.lit(-1).alias("idx"),
        F.lit(None).cast("double").alias("open"),
        F.array().cast("array<int>").alias("ids"),
    )

    def step(acc, t):
        fresh = acc["open"].isNull() | (t.cast("double") - acc["open"] > tolerance)
        idx = F.when(fresh, acc["idx"] + 1).otherwise(acc["idx"])
        return F.struct(
            idx.alias("idx"),
            F.when(fresh, t.cast("double")).otherwise(acc["open"]).alias("open"),
            F.concat(acc["ids"], F.array(idx)).alias("ids"),
        )

    folded = grouped.withColumn("__ids", F.aggregate("__ts", start, step)["ids"])
    pairs = F.arrays_zip(F.col("__ts").alias("t"), F.col("__ids").alias("c"))
    return folded.select(*keys, F.explode(pairs).alias("__p")).select(
        *keys, F.col("__p")["t"].alias(departure), F.col("__p")["c"].alias("cluster")
    )


def flight_key(keys: Sequence[str], cluster: str = "cluster"):
    """UUIDv5 of ``key|key|...|cluster``; a null part is written as ``None``."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys]
    return uuid5(FLIGHT_KEY_NAMESPACE, F.concat_ws("|", *parts, F.col(cluster)))


def assign_flight_key(
    quotes: DataFrame,
    tolerance_minutes: int = 15,
    keys: Sequence[str] = ("carrier_iata", "flight_number", "travel_date"),
    departure: str = "dep_datetime_local",
) -> DataFrame:
    """Tag quotes of the same physical flight with one ``flight_key``; no row is dropped."""
    require(quotes, [*keys, departure], "assign_flight_key")
    if tolerance_minutes < 0:
        raise ValueError("tolerance_minutes must be >= 0")
    numeric = dict(quotes.dtypes)[departure] in ("int", "bigint", "smallint", "double")
    if numeric:
        clock, unit = F.col(departure), 1
    else:
        origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        clock, unit = F.timestamp_diff("MICROSECOND", origin, F.col(departure).cast("timestamp_ntz")), 60_000_000
    q = quotes.withColumn("__dep", clock)
    clusters = departure_clusters(q, keys, "__dep", tolerance_minutes * unit)
    tagged = null_safe_join(q, clusters, [*keys, "__dep"], "left")
    return tagged.withColumn("flight_key", flight_key(keys)).drop("__dep", "cluster")


# --- component split ------------------------------------------------------------------------


def decompose_fares(quotes: DataFrame, airport_fee: DataFrame, tax_rate: float) -> DataFrame:
    """Fill base, taxes, airport fee and convenience fee where they can be derived.

    ``airport_fee``: (origin_iata, airport_udf), one row per airport. Adds ``fare_split_source``
    and ``component_sum_consistent``. Rounding is half-even at the cent.
    """
    require(quotes, ["origin_iata", "base_fare", "taxes", "udf", "convenience_fee", "total_fare"], "decompose_fares")
    if not 0 <= tax_rate <= 1:
        raise ValueError(f"tax_rate must be within [0, 1], got {tax_rate}")
    money = "decimal(12,2)"
    rate = F.lit(str(tax_rate)).cast("decimal(6,4)")
    q = quotes.join(airport_fee.select("origin_iata", F.col("airport_udf").cast(money)), "origin_iata", "left")
    fee = F.coalesce(F.col("convenience_fee"), F.lit("0").cast(money))
    reported = F.col("base_fare").isNotNull() & F.col("taxes").isNotNull() & F.col("udf").isNotNull()
    net = (F.col("total_fare") - F.col("airport_udf") - fee).cast("decimal(14,2)")
    base = F.bround((net / (F.lit("1").cast("decimal(6,4)") + rate)).cast("decimal(28,15)"), 2).cast(money)
    tax = F.bround((base * rate).cast("decimal(20,6)"), 2).cast(money)
    derived = ~reported & F.col("airport_udf").isNotNull() & (base > 0)
    total = F.col("base_fare") + F.col("taxes") + F.col("udf") + fee
    off = F.abs(total - F.col("total_fare"))
    return q.select(
        *[c for c in quotes.columns if c not in ("base_fare", "taxes", "udf", "convenience_fee")],
        F.when(derived, base).otherwise(F.col("base_fare")).cast(money).alias("base_fare"),
        F.when(derived, tax).otherwise(F.col("taxes")).cast(money).alias("taxes"),
        F.when(derived, F.col("airport_udf")).otherwise(F.col("udf")).cast(money).alias("udf"),
        F.when(derived, fee).otherwise(F.col("convenience_fee")).cast(money).alias("convenience_fee"),
        case_chain([(reported, "reported"), (derived, "derived")], "undetermined").alias("fare_split_source"),
        F.when(reported, off <= F.lit("0.01").cast(money)).when(derived, F.lit(True)).alias(
            "component_sum_consistent"
        ),
    )


# --- outlier flags --------------------------------------------------------------------------


def _bounds(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``outlier_bounds`` from a (keys, v, n) table of prices."""
    mid = Q.quantiles_of_counts(counts, keys, {"q1": 0.25, "med": 0.5, "q3": 0.75}, F.log)
    mid = staged(mid.withColumnRenamed("n_values", "cell_n"), "bounds")
    deviations = null_safe_join(counts, mid.select(*keys, "med"), keys).withColumn(
        "v", F.abs(F.log(F.col("v").cast("double")) - F.col("med"))
    )
    spread = Q.quantiles_of_counts(deviations.select(*keys, "v", "n"), keys, {"mad": 0.5}).drop("n_values")
    return null_safe_join(mid, spread, keys)


def outlier_bounds(
    quotes: DataFrame,
    keys: Sequence[str],
    price: str = "total_fare",
) -> DataFrame:
    """Per cell: ``cell_n``, ``med``, ``mad``, ``q1``, ``q3`` of ln(price)."""
    return _bounds(Q.value_counts(quotes, keys, price), keys)


def outlier_values(
    quotes: DataFrame,
    keys: Sequence[str] = ("route_id", "advance_days", "travel_date"),
    price: str = "total_fare",
    mad_threshold: float = 3.5,
    iqr_k: float = 1.5,
    min_cell_size: int = 5,
) -> DataFrame:
    """(keys, price, is_outlier_mad, is_outlier_iqr) of the prices that either rule flags in a cell, as a written table: the modified z-score and Tukey's
    fences on ln(price). Small cells are never screened and a cell with zero MAD flags nothing.

    A verdict depends on the cell and the price alone, so it is given once per distinct price, and quotes are read for these two only.
    """
    require(quotes, [*keys, price], "outlier_values")
    if min_cell_size < 2:
        raise ValueError("min_cell_size must be >= 2")
    counts = Q.value_counts(quotes, keys, price)
    q = null_safe_join(counts, _bounds(counts, keys), keys)
    x = F.log(F.col("v").cast("double"))
    eligible = F.col("cell_n") >= min_cell_size
    z = F.lit(0.6745) * F.abs(x - F.col("med")) / F.nullif(F.col("mad"), F.lit(0.0))
    iqr = F.col("q3") - F.col("q1")
    mad_flag = F.coalesce(eligible & (z > mad_threshold), F.lit(False))
    iqr_flag = F.coalesce(
        eligible & ((x < F.col("q1") - iqr_k * iqr) | (x > F.col("q3") + iqr_k * iqr)), F.lit(False)
    )
    judged = q.select(*keys, F.col("v").alias(price), mad_flag.alias("is_outlier_mad"), iqr_flag.alias("is_outlier_iqr"))
    values = staged(judged.where("is_outlier_mad or is_outlier_iqr"), "outliers")
    discard(counts)
    return values


def with_outlier_flags(
    quotes: DataFrame, values: DataFrame, keys: Sequence[str], price: str = "total_fare", active_rule: str = "mad_log"
) -> DataFrame:
    """``quotes`` with both verdicts of ``outlier_values``; ``is_outlier``/``outlier_rule`` follow ``active_rule``."""
    if active_rule not in ("mad_log", "iqr"):
        raise ValueError(f"unknown outlier rule {active_rule!r}")
    q = null_safe_join(quotes, values, [*keys, price], "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_outlier_mad", "is_outlier_iqr")}
    active = flags["is_outlier_mad" if active_rule == "mad_log" else "is_outlier_iqr"]
    return q.withColumns(flags | {"is_outlier": active, "outlier_rule": F.when(active, F.lit(active_rule))})


def detect_outliers(
    quotes: DataFrame,
    keys: Sequence[str] = ("route_id", "advance_days", "travel_date"),
    price: str = "total_fare",
    active_rule: str = "mad_log",
    mad_threshold: float = 3.5,
    iqr_k: float = 1.5,
    min_cell_size: int = 5,
) -> DataFrame:
    """Flag rows by modified z-score and by Tukey fences on ln(price) within each cell (see ``outlier_values``). Both verdicts are kept;
    ``is_outlier``/``outlier_rule`` follow ``active_rule``."""
    if active_rule not in ("mad_log", "iqr"):
        raise ValueError(f"unknown outlier rule {active_rule!r}")
    return with_outlier_flags(quotes, outlier_values(quotes, keys, price, mad_threshold, iqr_k, min_cell_size), keys, price, active_rule)


# --- derived columns ------------------------------------------------------------------------


def window_code(lead="advance_days", windows=ADVANCE_WINDOWS):
    """Lead-time window of a lead in days; null outside every window."""
    c = F.col(lead) if isinstance(lead, str) else lead
    return case_chain([((c >= w[1]) & (c <= w[2]), w[0]) for w in windows])


def with_lookup(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left lookup on a dimension; unknown keys get null. The planner broadcasts by real size."""
    return df.join(lookup, on, "left")


def with_calendar(quotes: DataFrame) -> DataFrame:
    """Departure hour and collection day of each quote."""
    return quotes.withColumn("dep_hour_bucket", F.hour("dep_datetime_local")).withColumn(
        "query_date", F.date_sub("travel_date", F.col("advance_days").cast("int"))
    )


def quality_vector(columns: Sequence[str]):
    """Struct of the seven quality fields; a field whose column is absent is null, never guessed."""
    spec = (
        ("stops", "int"),
        ("dep_hour_bucket", "int"),
        ("refundable", "boolean"),
        ("baggage_included", "boolean"),
        ("carrier_type", "string"),
        ("aircraft", "string"),
        ("fare_split", "string"),
    )
    source = {"fare_split": "fare_split_source"}
    fields = []
    for name, typ in spec:
        col = source.get(name, name)
        fields.append((F.col(col) if col in columns else F.lit(None)).cast(typ).alias(name))
    return F.struct(*fields)


def product_id(columns: Sequence[str] = ("carrier_iata", "flight_number", "source_code", "advance_days")):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def great_circle_km(lat1, lon1, lat2, lon2):
    """Haversine distance in km, mean Earth radius 6371.0088."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2
    )
    return F.asin(F.sqrt(a)) * (2 * 6371.0088)


def distance_band(km, bands):
    """First band whose upper bound exceeds the distance; the last band is open."""
    pairs = [(km < b[1], b[0]) if b[1] is not None else (km.isNotNull(), b[0]) for b in bands]
    return case_chain(pairs)


def log_linear_knots(x, knots: Sequence[tuple[float, float]]):
    """Log-linear interpolation through (x, y > 0) knots, clamped at both ends."""
    pts = sorted(knots)
    pairs = [(x <= pts[0][0], F.lit(float(pts[0][1])))]
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        frac = (x - x0) / F.lit(float(x1 - x0))
        pairs.append((x <= x1, F.exp(F.log(F.lit(float(y0))) * (1 - frac) + F.log(F.lit(float(y1))) * frac)))
    return case_chain(pairs, F.lit(float(pts[-1][1])))


def drop_unplaceable(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a known hour and stop count, one-row count of the others)."""
    ok = F.col("dep_hour_bucket").isNotNull() & F.col("stops").isNotNull()
    return clean.where(ok), clean.agg(F.count_if(~ok).alias("dropped_rows"))
