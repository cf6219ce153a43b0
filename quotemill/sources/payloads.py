"""Raw payload bodies to canonical quotes. A mapper is a function from payloads to quotes.

Payloads carry ``payload_id``, ``source_code``, ``route_code``, ``query_date`` and a text ``body``;
every mapper keeps the context columns and emits ``QUOTE_COLUMNS``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.core import case_chain, union_all
from quotemill.sources import cards

Mapper = Callable[[DataFrame], DataFrame]

QUOTE_COLUMNS = (
    "carrier_iata", "flight_number", "dep_datetime_local", "arr_datetime_local", "stops", "fare_class", "fare_brand",
    "base_fare", "taxes", "udf", "convenience_fee", "total_fare", "currency", "seats_shown", "refundable", "baggage_included",
)

# Lists of a body that holds quotes, by the types of its prices and times.
NESTED_LIST = """
array<struct<
  flightNumber: string, carrier: string, departure: struct<dateTime: {time}>, arrival: struct<dateTime: {time}>, stops: int,
  fareOptions: array<struct<brand: string, cabin: string, baseFare: {money}, taxes: {money}, udf: {money},
    totalFare: {money}, currency: string, seatsRemaining: int, refundable: boolean, baggageIncluded: boolean>>>>
"""
EMBEDDED_LIST = """
array<struct<
  flight_no: string, airline_code: string, dep: struct<local_time: {time}>, arr: struct<local_time: {time}>, num_stops: int,
  fares: array<struct<fare_type: string, class_of_service: string,
    fare_breakup: struct<base: {money}, tax: {money}, udf: {money}>, total: {money}, currency_code: string,
    seats_left: int, is_refundable: boolean, free_baggage: boolean>>>>
"""
# Where the second page shape keeps its data, and the markup of the third.
# the object ends at the first closing brace before a semicolon; the pattern steps from brace to brace
EMBEDDED_PATTERN = r"window\.__FARE_DATA__\s*=\s*(\{[^}]*(?:\}(?!\s*;)[^}]*)*+\})\s*;"
EMPTY_CLASS = "noFlights"


# The cabins a fare may name; any other refuses its payload.
CABINS = ("ECONOMY", "PREMIUM_ECONOMY", "BUSINESS", "FIRST")
#: Fields that only some shapes carry; every other one is required in each quote.
OPTIONAL = {"nested_json": ("convenience_fee",), "embedded_json": ("convenience_fee",), "html_cards": ("udf", "baggage_included")}


def _complete(q: Column | dict[str, Column], shape: str) -> Column:
    """Has a quote every required field and a known cabin?

    One faulty quote refuses its whole payload, which then shows up in ``unparsed_payloads``: a source that changed must not go on with half of its fares.
    """
    needed = [c for c in QUOTE_COLUMNS if c not in OPTIONAL[shape]]
    return reduce(lambda a, c: a & q[c].isNotNull(), needed, q["fare_class"].isin(*CABINS))


def _listed_quotes(payloads: DataFrame, body: Column, within: str, found: str, options: str, quote: Callable[[Column, Column], dict[str, Column]], shape: str) -> DataFrame:
    """Quotes of JSON bodies with a list ``within`` of flights, each with a list ``options`` of fares; ``found`` is the type of the list, and
    ``quote`` names the fields of a flight and a fare.

    Text of a number is costly to get, so prices are first read as numbers, which give the same cents. A payload that is not complete that way, or has a field
    of another type, is read once more with its prices as text, which also takes those in quotes. Types are cast as one nested column, and each step that reads a column twice
    has a projection of its own: so they run as generated code, with the body and the list worked out once.
    """
    ctx = [c for c in payloads.columns if c != "body"]
    kind = lambda money, time: f"struct<{within}: {found.format(money=money, time=time)}, __refused: string>"
    read_as = lambda money: F.from_json("__body", kind(money, "string"), {"columnNameOfCorruptRecord": "__refused"}).try_cast(kind("decimal(12,2)", "timestamp_ntz"))

    def whole(flights: Column) -> Column:
        return F.forall(flights, lambda f: F.forall(f[options], lambda o: _complete(quote(f, o), shape)))

    read = payloads.select(*ctx, body.alias("__body")).select(*ctx, "__body", read_as("double").alias("__read"))
    listed = F.col("__read")[within]
    again = F.get(F.filter(F.array(read_as("string")[within]), whole), F.lit(0))
    kept = read.select(*ctx, F.when(F.col("__read")["__refused"].isNull() & whole(listed), listed).otherwise(again).alias("__list"))
    # the outer form keeps the planner from testing the array, parsed once more, before it is unfolded
    flights = kept.select(*ctx, F.explode_outer("__list").alias("__flight"))
    fares = flights.select(*ctx, "__flight", F.explode(F.col("__flight")[options]).alias("__fare"))
    fields = quote(F.col("__flight"), F.col("__fare"))
    return fares.select(*ctx, *[(fields[c] if c in fields else F.lit(None).cast("decimal(12,2)")).alias(c) for c in QUOTE_COLUMNS])


def map_nested(payloads: DataFrame) -> DataFrame:
    """Itineraries x fare options of a nested JSON search response."""

    def quote(i: Column, o: Column) -> dict[str, Column]:
        return {
            "carrier_iata": i["carrier"],
            "flight_number": i["flightNumber"],
            "dep_datetime_local": i["departure"]["dateTime"],
            "arr_datetime_local": i["arrival"]["dateTime"],
            "stops": i["stops"],
            "fare_class": o["cabin"],
            "fare_brand": o["brand"],
            "base_fare": o["baseFare"],
            "taxes": o["taxes"],
            "udf": o["udf"],
            "total_fare": o["totalFare"],
            "currency": o["currency"],
            "seats_shown": o["seatsRemaining"],
            "refundable": o["refundable"],
            "baggage_included": o["baggageIncluded"],
        }

    return _listed_quotes(payloads, F.col("body"), "itineraries", NESTED_LIST, "fareOptions", quote, "nested_json")


def embedded_json(body: str = "body") -> Column:
    """The body itself when it is JSON, else the object assigned in the page script."""
    b = F.col(body)
    return F.when(F.ltrim(b).startswith("{"), b).otherwise(F.regexp_extract(b, EMBEDDED_PATTERN, 1))


def map_embedded(payloads: DataFrame) -> DataFrame:
    """JSON body or HTML page with the same JSON embedded in a script."""

    def quote(f: Column, o: Column) -> dict[str, Column]:
        return {
            "carrier_iata": f["airline_code"],
            "flight_number": f["flight_no"],
            "dep_datetime_local": f["dep"]["local_time"],
            "arr_datetime_local": f["arr"]["local_time"],
            "stops": f["num_stops"],
            "fare_class": o["class_of_service"],
            "fare_brand": o["fare_type"],
            "base_fare": o["fare_breakup"]["base"],
            "taxes": o["fare_breakup"]["tax"],
            "udf": o["fare_breakup"]["udf"],
            "total_fare": o["total"],
            "currency": o["currency_code"],
            "seats_shown": o["seats_left"],
            "refundable": o["is_refundable"],
            "baggage_included": o["free_baggage"],
        }

    return _listed_quotes(payloads, embedded_json(), "flights", EMBEDDED_LIST, "fares", quote, "embedded_json")


def map_cards(payloads: DataFrame) -> DataFrame:
    """HTML fare cards: five data attributes and eight class-tagged texts per card.

    A card reaches from its opening tag to the next card's, so elements inside may nest. Bodies are read in Arrow tasks (``cards``) and leave them as lists of texts,
    which are cast as one nested column.
    """
    ctx = [c for c in payloads.columns if c != "body"]
    absent = {"udf": "decimal(12,2)", "baggage_included": "boolean"}
    types = dict.fromkeys(cards.FIELDS, "string")
    typed = types | dict.fromkeys(("dep_datetime_local", "arr_datetime_local"), "timestamp_ntz") | dict.fromkeys(("stops", "seats_shown"), "int")
    typed |= dict.fromkeys(("base_fare", "taxes", "convenience_fee", "total_fare"), "decimal(12,2)")
    kind = lambda fields: f"array<struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>>"
    read = payloads.select(*ctx, F.arrow_udf(cards.with_cards, returnType=kind(types))("body").try_cast(kind(typed)).alias("__cards"))

    def quote(c: Column) -> dict[str, Column]:
        return {n: c[n] for n in cards.FIELDS} | {"currency": F.lit("INR"), "refundable": F.lower(c["refundable"]) == "true"}

    kept = read.select(*ctx, F.when(F.forall("__cards", lambda c: _complete(quote(c), "html_cards")), F.col("__cards")).alias("__cards"))
    # the outer form keeps the planner from testing the array, cast once more, before it is unfolded
    each = kept.select(*ctx, F.explode_outer("__cards").alias("__card")).where(F.col("__card")["carrier_iata"].isNotNull())
    found = quote(F.col("__card"))
    return each.select(*ctx, *[(found[c] if c in found else F.lit(None).cast(absent[c])).alias(c) for c in QUOTE_COLUMNS])


def empty_result(body: str = "body") -> Column:
    """Does the body say that nothing is on offer? A page with the empty-result box and no card, or an empty list."""
    b = F.col(body)
    # a plain search spares nearly every body the patterns
    box = b.contains(EMPTY_CLASS) & b.rlike(cards.with_class("div", EMPTY_CLASS)) & ~b.rlike(cards.with_class("div", cards.CARD_CLASS))
    return box | ((b.contains('"itineraries"') | b.contains('"flights"')) & b.rlike(r'"(?:itineraries|flights)"\s*:\s*\[\s*\]'))


_MAPPERS: dict[str, Mapper] = {"nested_json": map_nested, "embedded_json": map_embedded, "html_cards": map_cards}


def register_mapper(name: str, mapper: Mapper) -> None:
    """Add a payload shape: a function from payloads to quotes."""
    _MAPPERS[name] = mapper


def mapper(name: str) -> Mapper:
    if name not in _MAPPERS:
        raise ValueError(f"unknown mapper {name!r}; have {sorted(_MAPPERS)}")
    return _MAPPERS[name]


def parse_payloads(payloads: DataFrame, mapper_by_source: dict[str, str]) -> DataFrame:
    """Quotes of all sources, each parsed by its own mapper."""
    return union_all([mapper(m)(payloads.where(F.col("source_code") == s)) for s, m in mapper_by_source.items()])


def unparsed_payloads(payloads: DataFrame, quotes: DataFrame) -> DataFrame:
    """Payloads that gave no quote: a valid empty result, or drift to be quarantined."""
    silent = payloads.join(quotes.select("payload_id").distinct(), "payload_id", "left_anti")
    return silent.withColumn(
        "outcome", F.when(empty_result(), "empty_result").otherwise("shape_mismatch")
    )


def collection_outcomes(payloads: DataFrame, quotes: DataFrame) -> DataFrame:
    """One run row per attempt, also for attempts without quotes. What a body says is read where it stands, so that bodies do not move."""
    n = quotes.groupBy("payload_id").agg(F.count(F.lit(1)).alias("quotes_collected"))
    told = payloads.select("payload_id", "source_code", "route_code", "query_date", empty_result().alias("__empty"), challenge_name().alias("challenge"))
    out = told.join(n, "payload_id", "left")
    got = F.coalesce("quotes_collected", F.lit(0).cast("long"))
    status = F.when((got > 0) | F.col("__empty"), "SUCCEEDED").when(F.col("challenge").isNotNull(), "BLOCKED").otherwise("FAILED")
    return out.select(
        F.col("payload_id").alias("collection_run_id"), "source_code", "route_code", "query_date", status.alias("status"),
        got.alias("quotes_collected"), F.when(status == "BLOCKED", 1).otherwise(0).cast("long").alias("blocked_count"), "challenge",
    )


# --- bot challenges -------------------------------------------------------------------------

# Names and signatures of challenge pages, first match wins, case-insensitive.
CHALLENGES = (
    ("recaptcha", r"""www\.google\.com/recaptcha|class=["']g-recaptcha"""),
    ("hcaptcha", r"""hcaptcha\.com/1/api\.js|class=["']h-captcha"""),
    ("cloudflare_challenge", r"challenges\.cloudflare\.com|cf_chl_|cf-challenge|Checking your browser before accessing"),
    ("akamai_bot_manager", r"akam/1[0-9]/pixel|bm-verify"),
    ("perimeterx", r"px-captcha|/px/captcha|window\._pxAppId"),
    ("datadome", r"captcha-delivery\.com|geo\.captcha-delivery"),
    ("generic_captcha_page", r"<title>[^<]{0,80}captcha[^<]{0,80}</title>"),
)
#: Lower-case texts of which every signature contains one: a page without any of them is spared the patterns.
CHALLENGE_MARKS = ("captcha", "cloudflare", "cf_chl_", "cf-challenge", "checking your browser", "akam/1", "bm-verify", "_pxappid")


def _marked(bodies: pa.Array) -> pa.Array:
    """Does a body hold a mark, in letters of either case? One pass over it for all marks."""
    return pc.match_substring_regex(bodies, "(?i)" + "|".join(CHALLENGE_MARKS))


def challenge_name(body: str = "body") -> Column:
    """Name of the first challenge signature found anywhere in the body, else null."""
    marked = F.arrow_udf(_marked, returnType="boolean")(F.col(body))
    return F.when(marked, case_chain([(F.col(body).rlike("(?i)" + p), name) for name, p in CHALLENGES]))


def classify_pages(pages: DataFrame, body: str, keys: Sequence[str]) -> DataFrame:
    return pages.select(*keys, challenge_name(body).alias("challenge"))
