"""One StructType per stored table."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
INDEX = T.DecimalType(14, 6)


def _t(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


S, B, D, TS, L, I, SH = (
    T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.LongType(), T.IntegerType(), T.ShortType(),
)
NTZ = T.TimestampNTZType()

AIRPORT = _t(
    ("iata", S, False), ("icao", S, True), ("name", S, True), ("city", S, True), ("state", S, True),
    ("lat", T.DecimalType(9, 6), True), ("lon", T.DecimalType(9, 6), True),
)
CARRIER = _t(("iata", S, False), ("name", S, True), ("carrier_type", S, True))
ROUTE = _t(
    ("route_id", S, False), ("route_code", S, False), ("origin_iata", S, False), ("dest_iata", S, False),
    ("pax_share", T.DecimalType(9, 8), True), ("basket_version", S, True), ("active_from", D, False), ("active_to", D, True),
)
SOURCE = _t(("source_id", S, False), ("source_code", S, False), ("enabled", B, False))
SOURCE_POLICY = _t(("source_id", S, False), ("tos_verdict", S, True), ("legal_basis", S, True), ("allowed_paths", T.ArrayType(S), True))
POLICY_DECISION = _t(("source_id", S, False), ("url_hash", S, False), ("decision", S, False), ("decided_at", TS, False))
COLLECTION_RUN = _t(
    ("collection_run_id", S, False), ("source_id", S, False), ("route_id", S, True), ("started_at", TS, False),
    ("finished_at", TS, True), ("status", S, False), ("quotes_collected", L, False), ("blocked_count", L, False), ("error_detail", S, True),
)
QUOTE = _t(
    ("id", S, False), ("collected_at", TS, False), ("collection_run_id", S, True), ("source_id", S, False), ("source_code", S, True),
    ("route_id", S, True), ("route_code", S, True), ("origin_iata", S, True), ("carrier_iata", S, True), ("flight_number", S, True),
    ("dep_datetime_local", NTZ, True), ("arr_datetime_local", NTZ, True), ("travel_date", D, True), ("query_date", D, True),
    ("advance_days", SH, True), ("stops", SH, True), ("fare_class", S, True), ("fare_brand", S, True), ("refundable", B, True),
    ("baggage_included", B, True), ("base_fare", MONEY, True), ("taxes", MONEY, True), ("udf", MONEY, True), ("convenience_fee", MONEY, True),
    ("total_fare", MONEY, True), ("currency", S, True), ("seats_shown", I, True), ("content_hash", S, False),
)
QUALITY = _t(
    ("stops", I, True), ("dep_hour_bucket", I, True), ("refundable", B, True), ("baggage_included", B, True),
    ("carrier_type", S, True), ("aircraft", S, True), ("fare_split", S, True),
)
CLEAN = _t(
    ("quote_id", S, True), ("quote_collected_at", TS, True), ("snapshot_id", S, False), ("route_id", S, False), ("carrier_iata", S, False),
    ("travel_date", D, False), ("advance_days", SH, False), ("dep_hour_bucket", SH, True), ("stops", SH, True), ("base_fare", MONEY, True),
    ("taxes", MONEY, True), ("total_fare", MONEY, False), ("is_outlier", B, False), ("outlier_rule", S, True), ("is_imputed", B, False),
    ("imputation_method", S, True), ("quality_vector", QUALITY, False),
)
DATA_SNAPSHOT = _t(("snapshot_id", S, False), ("row_count", L, False), ("content_hash", S, False), ("description", S, True))
METHOD_CONFIG = _t(("config_hash", S, False), ("config", S, False))
INDEX_RUN = _t(
    ("index_run_id", S, False), ("snapshot_id", S, False), ("config_hash", S, False), ("vintage_date", D, False),
    ("computed_at", TS, False), ("released_at", TS, True), ("status", S, False),
)
SERIES = _t(("series_code", S, False), ("description", S, True), ("dimensions", T.MapType(S, S), True), ("frequency", S, False))
INDEX_VALUE = _t(
    ("index_run_id", S, False), ("series_code", S, False), ("period", D, False), ("value", INDEX, False),
    ("n_quotes", L, False), ("coverage_pct", T.DecimalType(5, 2), True),
)
REVISION_LOG = _t(
    ("series_code", S, False), ("period", D, False), ("old_value", INDEX, True), ("new_value", INDEX, False),
    ("reason", S, False), ("revised_at", TS, False),
)
LINEAGE = _t(("index_run_id", S, False), ("series_code", S, False), ("period", D, False), ("clean_id", S, False))
NOWCAST = _t(
    ("target_series", S, False), ("target_period", D, False), ("point_estimate", T.DoubleType(), False),
    ("ci_low", T.DoubleType(), False), ("ci_high", T.DoubleType(), False), ("computed_at", TS, False),
)
RAW_PAYLOAD = _t(
    ("payload_id", S, False), ("source_code", S, False), ("route_code", S, False), ("query_date", D, False),
    ("collected_at", TS, False), ("body", S, False),
)
FARE_REFERENCE = _t(("route_code", S, False), ("period", D, False), ("avg_fare", MONEY, False), ("collected_at", TS, True))
TARGET_INDEX = _t(("period", D, False), ("value", INDEX, False), ("base_year", S, True), ("release_date", D, True), ("collected_at", TS, True))
FUEL_PRICE = _t(("price_date", D, False), ("city", S, False), ("price_per_kl", MONEY, False), ("collected_at", TS, True))
RAIL_FARE = _t(("route_code", S, False), ("period", D, False), ("rail_fare", MONEY, False))
PROBE = _t(
    ("source_code", S, False), ("flight_key", S, False), ("session_id", S, False), ("probed_at", TS, False), ("total_fare", MONEY, False),
)
DISPERSION = _t(
    ("source_code", S, False), ("flight_key", S, False), ("probed_at", TS, False), ("statistic_name", S, False),
    ("value", T.DoubleType(), False), ("n_sessions", L, False),
)
