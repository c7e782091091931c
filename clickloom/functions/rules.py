"""Column rules shared by the batch and the streaming operators.

Everything here is a Column expression, so it stays inside generated code.
"Missing" always means NULL or the empty string unless a rule says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WHITESPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
CODE_PATTERN = r"\A[a-zA-Z0-9]+\z"
SCHEME_PATTERN = r"(?i)\Ahttps?://"

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def present(c: Column) -> Column:
    """True unless the value is NULL or empty."""
    return c.isNotNull() & (c != "")


def present_or_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_present(a: Column, b: Column) -> Column:
    """`a` when present, else `b`."""
    return F.coalesce(present_or_null(a), b)


def js_trim(c: Column) -> Column:
    """Strip all Unicode white space and byte-order marks at both ends."""
    return F.regexp_replace(c, rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def has_whitespace(c: Column) -> Column:
    return c.rlike(f"[{WHITESPACE}]")


def valid_code(c: Column) -> Column:
    """Letters and digits only, to the very end of the text."""
    return c.rlike(CODE_PATTERN)


def normalize_url(c: Column) -> Column:
    """Put https:// in front unless the text already has an http(s) scheme."""
    return F.when(c.rlike(SCHEME_PATTERN), c).otherwise(F.concat(F.lit("https://"), c))


def extract_code(c: Column, host: str) -> Column:
    """First code that follows `<host>/api/short/` in a text, NULL without one."""
    pattern = re.escape(host) + "/api/short/([a-zA-Z0-9]+)"
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def decode_uri_component(c: Column) -> Column:
    """Percent-decode with `+` kept; NULL when the text is malformed."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # The decoder replaces bad UTF-8 with U+FFFD; more marks than were sent are an error.
    marks = F.regexp_count(decoded, F.lit("\ufffd"))
    sent = F.regexp_count(c, F.lit("\ufffd|(?i:%EF%BF%BD)"))
    return F.when(marks <= sent, decoded)


def query_tail(c: Column, marker: str = "shorturl=") -> Column:
    """Raw text between the first and the second marker, NULL when empty or absent."""
    return F.nullif(F.split_part(c, F.lit(marker), F.lit(2)), F.lit(""))


def query_param(c: Column, name: str) -> Column:
    """Decoded value of the first query field called `name`, NULL when absent."""
    pattern = rf"\A[^?#]*\?(?:[^&#]*&)*?{re.escape(name)}=([^&#]*)"
    raw = F.regexp_extract(c, pattern, 1)
    return F.when(c.rlike(pattern), F.coalesce(F.try_url_decode(raw), raw))


def path_only(c: Column) -> Column:
    """The part of a request target before the query string or fragment."""
    return F.regexp_extract(c, r"\A[^?#]*", 0)


def last_segment(c: Column) -> Column:
    """Text after the last slash, empty after a trailing one."""
    return F.substring_index(c, "/", -1)


def utc_second_text(c: Column) -> Column:
    """`YYYY-MM-DD HH:mm:ss` of a zone-free UTC timestamp."""
    return F.substring(c.cast("string"), 1, 19)


def utc_second(c: Column) -> Column:
    """A zone-free UTC timestamp cut to the second, whatever the session zone."""
    return utc_second_text(c).cast("timestamp_ntz")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    seconds = (c - F.expr(EPOCH)).cast("interval second").cast("decimal(24,6)")
    return (seconds * 1_000_000).cast("long")


def from_micros(c: Column) -> Column:
    """Zone-free timestamp of microseconds since 1970."""
    seconds = (c.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(secs=seconds)


def instant(c: Column) -> Column:
    """A zone-free UTC timestamp as an instant, which event time needs."""
    return F.timestamp_micros(micros(c))


def generate_code(owner_id: Column, request_id: Column, salt: str = "") -> Column:
    """Owner id and four hex digits.

    The digits are a hash of the request, so a task that runs again gives the
    same code; pass a fresh `salt` per run to make them unpredictable.
    """
    digest = F.md5(F.concat(request_id.cast("string"), F.lit(salt)))
    return F.concat(owner_id.cast("string"), F.substring(digest, 1, 4))


def generate_token() -> Column:
    """128 hex digits drawn at random for each row.

    Each row draws 488 random bits of its own, so no secret is in the plan. Store the
    rows before they are read more than once: a task that runs again draws anew.
    """
    drawn = F.concat(*[F.uuid() for _ in range(4)])
    return F.sha2(drawn, 512)
