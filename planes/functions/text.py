"""Column functions over names, paths, bytes and timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# An RFC 3339 timestamp with its mandatory "T" and zone, and the zero
# instant that counts as no timestamp at all.
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"
ZERO_INSTANT = "0001-01-01T00:00:00Z"

# Fixed value: prefix of a step reference that names its formula.
FORMULA_REF = r"^mol-([^.]*)"

# A leading byte-order mark, the bytes skipped before a key block (space,
# tab, CR, LF, VT, FF, NUL) and the block's opening "-----BEGIN", all as hex.
PEM_HEAD = r"^(EFBBBF)?(20|09|0D|0A|0B|0C|00)*2D2D2D2D2D424547494E"
SNIFF_BYTES = 64

SALT_MIN_BYTES = 16
ACTOR_HASH_HEX = 16


def rfc3339(text: Column) -> Column:
    """Timestamp of RFC 3339 text; null for any other text and for the zero instant."""
    parsed = F.try_to_timestamp(F.replace(text, F.lit(","), F.lit(".")))
    zero = F.lit(ZERO_INSTANT).cast("timestamp")
    return F.when(text.rlike(RFC3339) & (parsed != zero), parsed)


def formula_of_ref(ref: Column) -> Column:
    """``mol-<formula>.<step>`` gives the formula, any other shape the empty string."""
    return F.regexp_extract(ref, FORMULA_REF, 1)


def actor_hash(actor: Column, salt: str) -> Column:
    """Salted hash of an actor, 16 hex characters; no actor has no hash."""
    if len(salt.encode()) < SALT_MIN_BYTES:
        raise ValueError(f"actor salt must be at least {SALT_MIN_BYTES} bytes")
    digest = F.sha2(F.concat(F.lit(salt), actor), 256)
    return F.when(actor == "", "").otherwise(F.substring(digest, 1, ACTOR_HASH_HEX))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def starts_with_key_block(content: Column) -> Column:
    """True for bytes that open like a PEM key block. Compared as hex, byte by byte."""
    return F.hex(F.substring(content, 1, SNIFF_BYTES)).rlike(PEM_HEAD)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """Names of the directories above a file, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def glob_regex(patterns: tuple[str, ...]) -> str:
    """One anchored regular expression for shell patterns of ``*``, ``?`` and plain text.

    Both wildcards also match "/".
    """
    wild = {"*": ".*", "?": "."}
    each = ["".join(wild.get(c, re.escape(c)) for c in p) for p in patterns]
    return rf"(?s)\A(?:{'|'.join(each)})\z"


def city_names(raw: Column) -> Column:
    """Names in a list separated by commas and blanks, each once, in first order."""
    names = F.filter(F.split(raw, "[, \t\r\n]+"), lambda x: x != "")
    return F.array_distinct(names)
