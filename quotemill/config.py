"""Run options. Plain values a caller may override; nothing here is read from disk."""

from __future__ import annotations

from dataclasses import dataclass, field

# Lead-time windows (code, first day, last day, label) and booking weights.
ADVANCE_WINDOWS = (
    ("AP00_03", 0, 3, "0-3 days before departure"),
    ("AP04_07", 4, 7, "4-7 days before departure"),
    ("AP08_14", 8, 14, "8-14 days before departure"),
    ("AP15_21", 15, 21, "15-21 days before departure"),
    ("AP22_30", 22, 30, "22-30 days before departure"),
    ("AP31_60", 31, 60, "31-60 days before departure"),
    ("AP61_90", 61, 90, "61-90 days before departure"),
)
BOOKING_WEIGHTS = {
    "AP00_03": 0.22,
    "AP04_07": 0.16,
    "AP08_14": 0.16,
    "AP15_21": 0.14,
    "AP22_30": 0.12,
    "AP31_60": 0.12,
    "AP61_90": 0.08,
}

# Plausible base-fare range per distance band (name, upper km or None, low, high).
DISTANCE_BANDS = (
    ("short", 600.0, 500.0, 25000.0),
    ("medium", 1500.0, 800.0, 55000.0),
    ("long", None, 1200.0, 70000.0),
)

# Run outcomes that count as having looked.
RAN_STATUSES = ("SUCCEEDED", "PARTIAL")


@dataclass(frozen=True)
class CleaningOptions:
    dep_tolerance_minutes: int = 15
    tax_rate: float = 0.05
    active_rule: str = "mad_log"
    mad_threshold: float = 3.5
    iqr_k: float = 1.5
    min_cell_size: int = 5
    outlier_group: tuple[str, ...] = ("route_id", "advance_days", "travel_date")
    impute_group: tuple[str, ...] = ("route_id", "advance_days", "carrier_type")
    coverage_group: tuple[str, ...] = ("route_id", "advance_days")
    dedup_group: tuple[str, ...] = ("carrier_iata", "flight_number", "travel_date")
    min_impute_size: int = 3


@dataclass(frozen=True)
class GateOptions:
    bands: tuple = DISTANCE_BANDS
    tax_share_min: float = 0.01
    tax_share_max: float = 0.20
    coverage_floor_pct: float = 40.0


@dataclass(frozen=True)
class IndexOptions:
    elementary: str = "jevons"
    splice: str = "movement"
    reference_value: float = 100.0
    window_days: int = 21
    min_quotes_per_cell: int = 5
    min_coverage_pct: float = 60.0
    series_prefix: str = "PX"
    booking_weights: dict = field(default_factory=lambda: dict(BOOKING_WEIGHTS))


@dataclass(frozen=True)
class BridgeOptions:
    n_index_lags: int = 2
    n_target_lags: int = 1
    min_observations: int = 24
    level: float = 0.95
    covariance: str = "HAC"
    maxlags: int = 3


@dataclass(frozen=True)
class SurgeOptions:
    baseline_rows: int = 90
    k: float = 3.0
    min_history: int = 14
