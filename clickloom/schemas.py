"""Column layouts of the stored tables and of the request events."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_text, _long, _int, _time = StringType(), LongType(), IntegerType(), TimestampNTZType()

USERS = _struct(id=_long, firstname=_text, lastname=_text, username=_text, token=_text)

LINKS = _struct(id=_long, redirecturl=_text, shorturl=_text, token=_text, password=_text)

CLICKS = _struct(
    id=_long,
    shorturl=_text,
    timestamp=_time,
    ip=_text,
    useragent=_text,
    referrer=_text,
    isp=_text,
    city=_text,
    region=_text,
    country=_text,
    password_status=_text,
)

GEO = _struct(ip=_text, isp=_text, city=_text, region=_text, country=_text)

HITS = _struct(
    id=_long, ts=_time, shorturl=_text, remote_addr=_text, xff=_text, useragent=_text
)

LISTED_LINKS = _struct(id=_long, redirecturl=_text, shorturl=_text, password=BooleanType())

# JSON bodies of the requests that carry one.
ADD_LINK_BODY = _struct(redirecturl=_text, customshorturlcode=_text, password=_text)
REMOVE_LINK_BODY = _struct(shorturl=_text)
UNLOCK_BODY = _struct(password=_text, shorturl=_text)
SIGNUP_BODY = _struct(FirstName=_text, LastName=_text, Username=_text, Password=_text)

# The given base tables that the fixture views are derived from.
BASE_TABLES = {
    "customer": _struct(
        c_custkey=_long, c_name=_text, c_nationkey=_int, c_acctbal=DoubleType(), c_mktsegment=_text
    ),
    "nation": _struct(n_nationkey=_int, n_name=_text, n_regionkey=_int),
    "region": _struct(r_regionkey=_int, r_name=_text),
    "part": _struct(
        p_partkey=_long,
        p_name=_text,
        p_brand=_text,
        p_type=_text,
        p_size=_int,
        p_retailprice=DoubleType(),
    ),
    "orders": _struct(
        o_orderkey=_long,
        o_custkey=_long,
        o_orderstatus=_text,
        o_totalprice=DoubleType(),
        o_orderdate=_time,
        o_orderpriority=_text,
    ),
    "events": _struct(
        event_id=_long, ts=_time, user_id=_long, event_type=_text, value=DoubleType(), props=_text
    ),
    "pages": _struct(page_id=_long, url=_text, html=_text),
}
