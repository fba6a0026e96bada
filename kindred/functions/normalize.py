"""Header values in canonical form, as Column expressions.

``NORMALIZERS`` maps a header name to a builder (value, parsed_date) -> value; add to it to treat more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that are white space to Unicode-aware splitting.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Headers that hold addresses.
ADDRESS_HEADERS = (
    "from", "to", "cc", "bcc", "reply-to", "sender", "return-path",
    "resent-from", "resent-to", "resent-cc", "resent-bcc", "resent-reply-to", "resent-sender",
    "delivered-to", "x-original-to", "envelope-to", "x-envelope-from", "x-envelope-to",
    "disposition-notification-to", "original-recipient",
)
# What leads a subject and is no part of it. A mark of a reply or of a forward, or the tag of a list.
REPLY_MARK = r"(?:re|fwd?):"
LIST_TAG = r"\[\w[\w-]*\w?\]"
SUBJECT_PREFIXES = rf"(?iU)^(?:(?:{REPLY_MARK}|{LIST_TAG})\x20+)+"
# Fixed value: one address in angle brackets, and nothing else.
BRACKETED = "^<([^<>,]+)>$"

Normalizer = Callable[[Column, Column], Column]


def collapse(v: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(v, WHITESPACE + "+", " "))


def subject(v: Column) -> Column:
    """Without leading reply and forward marks and list tags, in any mix."""
    return F.regexp_replace(v, SUBJECT_PREFIXES, "")


def content_type(v: Column) -> Column:
    """Without parameters; a space before the first semicolon stays."""
    return F.regexp_replace(v, "(?s);.*", "")


def day(v: Column, parsed_date: Column) -> Column:
    """The UTC day of the mail's date, or the value as it is."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(parsed_date / 86400).cast("int"))
    return F.coalesce(date.cast("string"), v)


def strip_brackets(v: Column) -> Column:
    """``<x>`` becomes ``x`` if nothing within looks like another address."""
    return F.regexp_replace(v, BRACKETED, "$1")


def address(v: Column) -> Column:
    return strip_brackets(collapse(F.replace(v, F.lit('"'), F.lit(""))))


NORMALIZERS: dict[str, Normalizer] = {name: lambda v, _: address(v) for name in ADDRESS_HEADERS} | {
    "subject": lambda v, _: subject(v),
    "content-type": lambda v, _: content_type(v),
    "date": day,
    "message-id": lambda v, _: strip_brackets(v),
}


def normalize(name: str, v: Column, parsed_date: Column | None = None) -> Column:
    v = collapse(v)
    more = NORMALIZERS.get(name)
    return more(v, F.lit(None).cast("double") if parsed_date is None else parsed_date) if more else v


def canonical_headers(headers: Column, ids: tuple[str, ...], parsed_date: Column) -> Column:
    """Array of (id, value) of the key's headers that are present, even if nothing is left of their values."""

    def one(name: str) -> Column:
        values = F.transform(F.filter(headers, lambda h: h["name"] == name), lambda h: normalize(name, F.coalesce(h["value"], F.lit("")), parsed_date))
        value = F.array_join(F.filter(values, lambda v: F.trim(v) != ""), "\n")
        return F.struct(F.lit(name).alias("id"), value.alias("value"), F.exists(headers, lambda h: h["name"] == name).alias("present"))

    found = F.filter(F.array(*[one(name) for name in ids]), lambda h: h["present"])
    return F.transform(found, lambda h: F.struct(h["id"].alias("id"), h["value"].alias("value")))


def serialize(canonical: Column) -> Column:
    return F.array_join(F.transform(canonical, lambda h: F.concat(h["id"], F.lit(": "), h["value"])), "\n")
