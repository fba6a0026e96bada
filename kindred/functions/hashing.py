"""Keys of records."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.normalize import WHITESPACE, serialize

#: Changes when stored hashes would no longer be the same.
FORMAT = 1


def header_key(canonical: Column, bits: int = 224) -> Column:
    return F.sha2(serialize(canonical), bits)


def raw_body(lines: Column, bits: int = 224) -> Column:
    return F.sha2(F.array_join(lines, "\n"), bits)


def normalized_body(lines: Column, bits: int = 224) -> Column:
    return F.sha2(F.regexp_replace(F.array_join(lines, ""), WHITESPACE, ""), bits)


#: Body mode to the part of the key that it adds.
BODY_HASHERS = {"skip": lambda lines, bits=224: F.lit(""), "raw": raw_body, "normalized": normalized_body}


def composite_key(canonical: Column, lines: Column, mode: str = "skip", bits: int = 224) -> Column:
    return F.concat(header_key(canonical, bits), BODY_HASHERS[mode](lines, bits))


def body_size(lines: Column) -> Column:
    """Code points of all lines, without line ends."""
    return F.length(F.array_join(lines, "")).cast("long")


def settings_fingerprint(hash_headers: tuple[str, ...], hash_body: str, time_source: str) -> str:
    """What stored hashes depend on; the name of their folder."""
    return hashlib.sha256(repr((FORMAT, hash_headers, hash_body, time_source)).encode()).hexdigest()
