"""Publication formats: CSV rows and SDMX-JSON messages."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.config import ADVANCE_WINDOWS

# Header of the CSV export.
CSV_COLUMNS = ("series", "period", "value", "n_quotes", "coverage_pct", "is_imputed", "status", "index_run_id", "data_status")


def export_rows(latest: DataFrame, imputed: DataFrame | None = None) -> DataFrame:
    """Latest values as text rows: six and two decimals, empty for null, status and imputed flag."""
    from quotemill.operators.vintages import point_status

    rows = point_status(latest)
    flag = F.lit(False)
    if imputed is not None:
        rows = rows.join(imputed.withColumn("__imp", F.lit(True)), ["index_run_id", "period"], "left")
        flag = F.coalesce("__imp", F.lit(False))
    text = lambda fmt, c: F.coalesce(F.format_string(fmt, F.col(c).cast("double")), F.lit(""))
    return rows.select(
        F.col("series_code").alias("series"),
        F.date_format("period", "yyyy-MM-dd").alias("period"),
        F.when(F.col("value").isNotNull(), text("%.6f", "value")).otherwise("").alias("value"),
        F.col("n_quotes").cast("string").alias("n_quotes"),
        F.when(F.col("coverage_pct").isNotNull(), text("%.2f", "coverage_pct")).otherwise("").alias("coverage_pct"),
        flag.cast("string").alias("is_imputed"),
        "status",
        "index_run_id",
        F.when(F.col("released_at").isNotNull(), "PUBLISHED").otherwise("PROVISIONAL").alias("data_status"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*CSV_COLUMNS).repartitionByRange("series", "period").sortWithinPartitions("series", "period").write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def sdmx_observations(latest: DataFrame) -> DataFrame:
    """Per series: number of points, observations object, time periods and quote counts as JSON.

    A series has one row per period, so its arrays are bounded by the calendar. Observation i is
    [value, 0 released / 1 provisional, i] in period order.
    """
    obs = F.struct(
        F.col("period").alias("p"),
        F.col("value").cast("double").alias("v"),
        F.when(F.col("released_at").isNotNull(), 0).otherwise(1).alias("s"),
        F.col("n_quotes").cast("string").alias("n"),
    )
    per = latest.groupBy("series_code").agg(F.sort_array(F.collect_list(obs)).alias("o"))
    number = lambda x, i: F.concat(
        F.lit('"'), i.cast("string"), F.lit('":['), F.format_string("%.6f", x["v"]), F.lit(","), x["s"].cast("string"), F.lit(","), i.cast("string"), F.lit("]")
    )
    month = lambda x: F.date_format(x["p"], "yyyy-MM")
    named = lambda v: F.struct(v.alias("id"), v.alias("name"))
    return per.select(
        "series_code",
        F.size("o").alias("n_points"),
        F.concat(F.lit("{"), F.array_join(F.transform("o", number), ","), F.lit("}")).alias("observations"),
        F.to_json(F.transform("o", lambda x: named(month(x)))).alias("time_periods"),
        F.to_json(F.transform("o", lambda x: named(x["n"]))).alias("n_quotes_values"),
    )


def _values(pairs: Sequence[tuple[str, str]]) -> list[dict]:
    return [{"id": i, "name": n} for i, n in pairs]


# Code lists of the two dimensions that do not depend on the data.
CARRIER_TYPES = (("ALL", "All carriers"), ("FSC", "Full-service carrier"), ("LCC", "Low-cost carrier"), ("REGIONAL", "Regional"))
WINDOWS = (("ALL", "All windows"), *[(w[0], w[3]) for w in ADVANCE_WINDOWS])
_HOLE = "\x00"


def message_segments(agency: str, title: str) -> list[str]:
    """The constant texts of a message; between them stand the series code, the time of preparation, the series key, the observations, the values of the
    route dimension, the time periods and the numbers of quotes."""
    # Dimension and attribute ids and names of the message structure.
    dims = [("FREQ", "Frequency", _values([("M", "Monthly")])), ("ROUTE", "Route", _HOLE), ("CARRIER_TYPE", "Carrier type", _values(CARRIER_TYPES)), ("AP_WINDOW", "Advance-purchase window", _values(WINDOWS))]
    message = {
        "meta": {"id": _HOLE, "prepared": _HOLE, "test": False, "contentLanguages": ["en"], "sender": {"id": agency, "name": title}},
        "data": {
            "dataSets": [{"action": "Information", "structure": 0, "series": {_HOLE: {"attributes": [0], "observations": _HOLE}}}],
            "structures": [
                {
                    "name": title,
                    "dimensions": {
                        "series": [{"id": i, "name": n, "keyPosition": k, "values": v} for k, (i, n, v) in enumerate(dims)],
                        "observation": [{"id": "TIME_PERIOD", "name": "Time period", "role": "time", "values": _HOLE}],
                    },
                    "attributes": {
                        "series": [{"id": "UNIT_MEASURE", "name": "Unit of measure", "values": _values([("IX", "Index, reference period = 100")])}],
                        "observation": [
                            {"id": "OBS_STATUS", "name": "Observation status", "values": _values([("A", "Normal"), ("P", "Provisional")])},
                            {"id": "N_QUOTES", "name": "Underlying cleaned quotes", "values": _HOLE},
                        ],
                    },
                }
            ],
        },
    }
    text = json.dumps(message, separators=(",", ":"))
    # holes that hold objects and lists lose their quotes
    parts = text.split(json.dumps(_HOLE)[1:-1])
    for k in (4, 5, 6, 7):
        parts[k - 1], parts[k] = parts[k - 1][:-1], parts[k][1:]
    return parts


def series_key(code: Column, routes: Column) -> Column:
    """Positions of a series' dimension values in the message's code lists; a dimension the code does not name is at ``ALL``."""
    parts = F.split(code, r"\.")
    kind, value = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    at = lambda name, codes: F.when(kind == name, F.greatest(F.array_position(codes, value) - 1, F.lit(0))).otherwise(0).cast("string")
    listed = lambda pairs: F.array(*[F.lit(i) for i, _ in pairs])
    return F.concat_ws(":", F.lit("0"), *[F.coalesce(x, F.lit("0")) for x in (at("ROUTE", routes), at("CARRIERTYPE", listed(CARRIER_TYPES)), at("WINDOW", listed(WINDOWS)))])


def sdmx_messages(latest: DataFrame, routes: Sequence[str] | DataFrame, agency: str, title: str, prepared) -> DataFrame:
    """One SDMX-JSON data message per series as text. ``routes`` are the codes of the route dimension after ``ALL``: a list in its order, or a table with
    ``route_code`` (a basket), taken in alphabetical order. A series stands in its message under the positions of its dimension values."""
    o = sdmx_observations(latest)
    if isinstance(routes, DataFrame):
        basket = routes.agg(F.sort_array(F.collect_set("route_code")).alias("__routes"))  # one row
        o = o.crossJoin(F.broadcast(basket))
    else:
        o = o.withColumn("__routes", F.array(*[F.lit(r) for r in routes]).cast("array<string>"))
    codes = F.concat(F.array(F.lit("ALL")), F.col("__routes"))
    named = F.to_json(F.transform(codes, lambda c: F.struct(c.alias("id"), F.when(c == "ALL", "All basket routes").otherwise(c).alias("name"))))
    moment = F.date_format(F.lit(prepared).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    variable = [F.col("series_code"), moment, series_key(F.col("series_code"), codes), F.col("observations"), named, F.col("time_periods"), F.col("n_quotes_values")]
    first, *rest = message_segments(agency, title)
    text = F.concat(F.lit(first), *[x for v, part in zip(variable, rest, strict=True) for x in (v, F.lit(part))])
    return o.select("series_code", text.alias("message"))


def write_sdmx(messages: DataFrame, path: str) -> None:
    """One text line per message, one folder per series."""
    messages.select("series_code", F.col("message").alias("value")).write.mode("overwrite").partitionBy("series_code").text(path)
