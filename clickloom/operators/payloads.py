"""Type and fields of QR payload texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload type and the prefix that tells it, tested in this order.
PREFIXES = [
    ("wifi", "WIFI:"),
    ("vcard", "BEGIN:VCARD"),
    ("event", "BEGIN:VEVENT"),
    ("email", "mailto:"),
    ("phone", "tel:"),
    ("sms", "sms:"),
    ("geo", "geo:"),
    ("bitcoin", "bitcoin:"),
    ("whatsapp", "https://wa.me/"),
    ("url", "http://"),
    ("url", "https://"),
]


def payload_type(c: Column) -> Column:
    """Payload type; NULL for an empty input, which is refused."""
    kind = F.when(F.coalesce(c, F.lit("")) == "", F.lit(None))
    for name, prefix in PREFIXES:
        kind = kind.when(c.startswith(prefix), name)
    return kind.otherwise("text")


_EMPTY = "array<struct<name:string,value:string>>"


def _field(name: Column | str, value: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), value.alias("value"))


def _cut(item: Column, separator: str, change) -> Column:
    """A `name<separator>value` text as a field, its value changed."""
    value = F.substring(item, F.instr(item, separator) + 1, F.length(item))
    return _field(F.substring_index(item, separator, 1), change(value))


def _pairs(items: Column, separator: str, change=lambda value: value) -> Column:
    """Fields of an array of texts, in their order; those without a name are left out."""
    named = F.filter(items, lambda item: F.instr(item, separator) > 1)
    return F.transform(named, lambda item: _cut(item, separator, change))


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def _unescaped(value: Column) -> Column:
    """A Wi-Fi value without the backslashes before marks."""
    return F.regexp_replace(value, r"\\(.)", "$1")


def _after(c: Column, prefix: str) -> Column:
    return F.substring(c, len(prefix) + 1, F.length(c))


def _with_query(c: Column, prefix: str, name: str) -> Column:
    """The part up to the question mark as `name`, and the decoded query fields."""
    rest = _after(c, prefix)
    query = F.split(F.regexp_extract(rest, r"(?s)\?(.*)\z", 1), "&")
    return F.concat(F.array(_field(name, F.substring_index(rest, "?", 1))), _pairs(query, "=", _decoded))


def payload_fields(c: Column) -> Column:
    """Fields of a payload, in their order, as an array of (name, value).

    A name that comes again is there again. Marks after a backslash belong to a Wi-Fi
    value. A place has a third number (altitude) if one is given.
    """
    kind = payload_type(c)
    lines = F.filter(F.split(c, r"\r?\n"), lambda line: ~line.rlike(r"\A(BEGIN|END):"))
    network = F.regexp_extract_all(_after(c, "WIFI:"), F.lit(r"(?:\\.|[^;\\])+"), F.lit(0))
    names = F.array(*map(F.lit, ("latitude", "longitude", "altitude")))
    place = F.slice(F.split(_after(c, "geo:"), ","), 1, 3)
    return (
        F.when(kind == "wifi", _pairs(network, ":", _unescaped))
        .when(kind.isin("vcard", "event"), _pairs(lines, ":"))
        .when(kind == "email", _with_query(c, "mailto:", "address"))
        .when(kind == "phone", F.array(_field("number", _after(c, "tel:"))))
        .when(kind == "sms", _with_query(c, "sms:", "number"))
        .when(kind == "geo", F.transform(place, lambda x, i: _field(F.get(names, i), x)))
        .when(kind == "bitcoin", _with_query(c, "bitcoin:", "address"))
        .when(kind == "whatsapp", _with_query(c, "https://wa.me/", "number"))
        .when(kind == "url", F.array(_field("url", c)))
        .when(kind == "text", F.array(_field("text", c)))
    ).cast(_EMPTY)


def classify_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """Add `type` and `fields`."""
    text = F.col(column)
    return df.select("*", payload_type(text).alias("type"), payload_fields(text).alias("fields"))


def payload_type_counts(df: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads per type; refused inputs are not counted."""
    kinds = df.select(payload_type(F.col(column)).alias("type")).filter(F.col("type").isNotNull())
    return kinds.groupBy("type").agg(F.count(F.lit(1)).alias("payloads"))
