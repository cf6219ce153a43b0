"""HTML fare cards as texts: what stands in a body, read by plain searches in Arrow tasks.

One regular expression per element would be run by the planner's interpreted lambdas, several times for each of some twenty elements of a card. Here a body is cut at its
card tags and opening brackets, and the class of a tag, of which pages repeat few, is looked up. Types are left to the caller's casts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CARD_CLASS = "fareCard"
#: Fields of a card: attributes of its tag, and texts of its elements of class ``fareCard__<name>``.
FIELDS = {
    "carrier_iata": "data-carrier", "flight_number": "data-flight-number", "dep_datetime_local": "data-dep-time", "arr_datetime_local": "data-arr-time",
    "stops": "data-stops", "fare_class": "cabin", "fare_brand": "brand", "base_fare": "baseFare", "taxes": "taxes", "convenience_fee": "convenienceFee",
    "total_fare": "totalFare", "seats_shown": "seats", "refundable": "refundable",
}

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Bodies read at once.
_ROWS = 1000
#: Bodies that are read one by one: with character references or marks to take out, an opening bracket without its closing one, or a class that does not end in its tag.
_ODD = r"""[\x01&]|<[^<>]*(?:<|$)|class[\s\x0b]*=[\s\x0b]*["'][^"'<>]*[<>]"""


def with_class(tag: str, name: str, before: str = "*") -> str:
    """Pattern of an opening tag that has ``name`` among its classes, in any place among its attributes; ``before`` repeats what stands there before."""
    return rf"""<{tag}\b[^>]{before}\sclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>"""


_PREFIX = CARD_CLASS + "__"
_CARD = re.compile(with_class("div", CARD_CLASS, "*?"), re.ASCII)
_TAGGED = re.compile(with_class("[A-Za-z][A-Za-z0-9]*", _PREFIX + r"(\w+)"), re.ASCII)
#: Of a tag cut at its quotes, what stands before the value of a data attribute.
_BEFORE_VALUE = re.compile(r"\s(data-[a-z-]+)\s*=\s*\Z", re.ASCII)
_ATTRIBUTE = re.compile(r"""\s(data-[a-z-]+)\s*=\s*["']([^"']*)["']""", re.ASCII)


@lru_cache(maxsize=4096)
def _named(tag: str) -> str | None:
    """The name of a tagged element, from its tag without brackets."""
    found = _TAGGED.match(f"<{tag}>")
    return found and found[1]


def _decoded(text: str) -> str:
    """Character references of markup characters, quotes and blanks decoded."""
    for mark, char in _ENTITIES:
        text = text.replace(mark, char)
    return text


def read_cards(body: str) -> Iterator[list[str | None]]:
    """The fields of each card, not trimmed, None where it has none. A card reaches from its opening tag to the next card's, so elements inside may nest."""
    body = body.replace("\x01", "")  # a control character that HTML does not allow
    starts = [m.start() for m in _CARD.finditer(body)]
    for start, end in zip(starts, [*starts[1:], len(body)], strict=False):
        card = body[start:end]
        # the first of a name counts, so later ones are put in before
        found = dict(reversed(_ATTRIBUTE.findall(card[: card.index(">")])))
        for piece in reversed(card.split("<")):  # a tag and the text behind it are one piece
            if _PREFIX in piece:
                tag, _, text = piece.partition(">")
                name = _named(tag)
                if not name and ">" in text:  # a class with a closing bracket in it ends in the text
                    odd = _TAGGED.match("<" + piece)
                    name = odd and odd[1]
                if name and text:
                    found[name] = text
        fields = map(found.get, FIELDS.values())
        yield [f and _decoded(f) for f in fields] if "&" in card else [*fields]


def _lists(ends: np.ndarray, columns: list[pa.Array], nulls: pa.Array) -> pa.Array:
    texts = [pc.ascii_trim(c, " \t\n\x0b\f\r") for c in columns]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(texts, [*FIELDS]), mask=nulls)


def _one_by_one(bodies: pa.Array) -> pa.Array:
    ends, rows = [], []
    for body in bodies.to_pylist():
        if body is not None:
            rows.extend(read_cards(body))
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
    return _lists(np.array(ends, np.int32), [pa.array(c, pa.string()) for c in columns], bodies.is_null())


def _firsts(rows: int, row: np.ndarray, field: np.ndarray, values: pa.Array, at: np.ndarray) -> list[pa.Array]:
    """A column per field: of each row the first of the ``values`` at ``at``."""
    found = np.full((rows, len(FIELDS)), -1)
    _, first = np.unique(row * len(FIELDS) + field, return_index=True)
    found[row[first], field[first]] = at[first]
    return [values.take(pa.array(f, mask=f < 0)) for f in found.T]


def _together(bodies: pa.Array) -> pa.Array:
    """What ``read_cards`` says of bodies that are not odd, in which a tag is what follows an opening bracket."""
    numbers = {name: k for k, name in enumerate(FIELDS.values())}
    pieces = pc.split_pattern(bodies.fill_null(""), "<")
    starts, flat = pieces.offsets.to_numpy(), pieces.values
    wanted = pc.match_substring(flat, CARD_CLASS).to_numpy(zero_copy_only=False)
    wanted[starts[:-1]] = False  # stands before the first tag
    at = np.flatnonzero(wanted)
    body = np.searchsorted(starts, at, side="right") - 1
    halves = pc.split_pattern(flat.take(pa.array(at)), ">", max_splits=1).values
    tags, texts = halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2)))
    coded = tags.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    opens = np.array([t.startswith("div") and _CARD.match(f"<{t}>") is not None for t in distinct], bool)[code]
    named = np.array([numbers.get(_named(t), -1) if _PREFIX in t else -1 for t in distinct], int)[code]
    card, opened = np.cumsum(opens) - 1, body[opens]
    # an element belongs to the last card opened before it, in its own body
    told = (named >= 0) & (card >= 0) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    told[told] = opened[card[told]] == body[told]
    columns = _firsts(len(opened), card[told], named[told], texts, np.flatnonzero(told))

    parts = pc.split_pattern(pc.replace_substring(tags.filter(pa.array(opens)), "'", '"'), '"')
    begins, flat = parts.offsets.to_numpy(), parts.values
    at = np.flatnonzero(pc.match_substring(flat, "data-").to_numpy(zero_copy_only=False))
    coded = flat.take(pa.array(at)).dictionary_encode()
    found = [_BEFORE_VALUE.search(t) for t in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy()
    card = np.searchsorted(begins, at, side="right") - 1
    keys = np.array([m is not None for m in found], bool)[code] & (at + 2 < begins[card + 1])  # the value's closing quote is there
    if (np.diff(at[keys]) == 1).any():  # a value that looks like an attribute itself
        return _one_by_one(bodies)
    named = np.array([numbers.get(m and m[1], -1) for m in found], int)[code]
    known = keys & (named >= 0)
    values = _firsts(len(opened), card[known], named[known], flat, at[known] + 1)
    both = [v if n.startswith("data-") else c for n, v, c in zip(FIELDS.values(), values, columns, strict=True)]
    return _lists(np.searchsorted(opened, np.arange(len(bodies)), side="right"), both, bodies.is_null())


def with_cards(bodies: pa.Array) -> pa.Array:
    """The list of cards of each body, null for a null."""
    lists = [pa.array([], pa.list_(pa.struct([(n, pa.string()) for n in FIELDS])))]
    for part in (bodies.slice(at, _ROWS) for at in range(0, len(bodies), _ROWS)):
        odd = pc.match_substring_regex(part, _ODD).fill_null(False).to_numpy(zero_copy_only=False)
        order = np.argsort(odd, kind="stable")
        sides = [_together(part.filter(pa.array(~odd))), _one_by_one(part.filter(pa.array(odd)))]
        lists.append(pa.concat_arrays(sides).take(pa.array(np.argsort(order, kind="stable"))))
    return pa.concat_arrays(lists)
