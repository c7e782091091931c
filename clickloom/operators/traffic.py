"""Rate limits, route classes and link checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rules import decode_uri_component, micros, path_only, present
from clickloom.plans.chains import SLICES, greedy_intervals
from clickloom.plans.numbering import first_n
from clickloom.plans.skew import lookup_join

WINDOW_SECONDS = 60
MAX_HITS = 20

# Route name, method and path pattern (without query string).
ROUTES = [
    ("short", "GET", r"/api/short/[^/]+"),
    ("shorturlanalytics", "GET", r"/api/shorturlanalytics"),
    ("checkpassword", "POST", r"/api/short/[^/]+/checkpassword"),
    ("signup", "POST", r"/api/signup"),
    ("login", "POST", r"/api/login"),
    ("validurl", "GET", r"/api/validurl"),
    ("addshorturl", "POST", r"/api/addshorturl"),
    ("removeshorturl", "POST", r"/api/removeshorturl"),
    ("getshorturls", "GET", r"/api/getshorturls"),
]
CHAT_ROUTE = ("messagewss", "/api/messagewss")
# Methods that a route of a method serves.
_VERBS = {"GET": ["GET", "HEAD"], "POST": ["POST"]}


def reaches_limiter(target: Column) -> Column:
    """Whether a request goes through the rate limit: all under the API prefix but the
    chat upgrade; pages are served before it."""
    return F.startswith(path_only(target), F.lit("/api")) & (target != CHAT_ROUTE[1])


def _cuts(hits: DataFrame, keys: list[str], order: list[str], max_hits: int) -> DataFrame:
    """The first hit beyond the limit of each group that has one: (keys, _cut)."""
    beyond = first_n(hits.select(*keys, *order), keys, order, max_hits + 1)
    return beyond.filter(F.col("_rank") == max_hits + 1).select(*keys, F.struct(*order).alias("_cut"))


def _group_key(key: str) -> Column:
    """A key that can be joined on: a missing one is a group too, and not an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def rate_limit_tumbling(
    requests: DataFrame,
    key: str = "ip",
    ts: str = "ts",
    order: str = "request_id",
    window_seconds: int = WINDOW_SECONDS,
    max_hits: int = MAX_HITS,
) -> DataFrame:
    """Add `limited` under clock-aligned windows.

    A group over the limit is known by one row, its first hit beyond it. Requests meet
    those rows only, by key and window; no request is shuffled where they are few.
    """
    hits = requests.select(
        "*",
        _group_key(key).alias("_key"),
        F.floor(micros(F.col(ts)) / F.lit(window_seconds * 1_000_000)).alias("_window"),
        micros(F.col(ts)).alias("_at"),
        F.col(order).alias("_id"),
    )
    cuts = _cuts(hits, ["_key", "_window"], ["_at", "_id"], max_hits)
    return _flagged(lookup_join(hits, cuts, ["_key", "_window"]), requests)


def _flagged(hits: DataFrame, requests: DataFrame) -> DataFrame:
    beyond = F.col("_cut").isNotNull() & (F.struct("_at", "_id") >= F.col("_cut"))
    return hits.select(*requests.columns, F.coalesce(beyond, F.lit(False)).alias("limited"))


def window_counts(
    requests: DataFrame,
    key: str = "ip",
    ts: str = "ts",
    window_seconds: int = WINDOW_SECONDS,
    max_hits: int = MAX_HITS,
) -> DataFrame:
    """Hits and limited hits per key and clock-aligned window."""
    counted = requests.groupBy(key, F.window(ts, f"{window_seconds} seconds")).agg(
        F.count(F.lit(1)).alias("hits")
    )
    return counted.select(
        key,
        F.col("window.start").alias("window_start"),
        "hits",
        F.greatest(F.col("hits") - max_hits, F.lit(0)).alias("limited_hits"),
    )


def rate_limit_anchored(
    requests: DataFrame,
    key: str = "ip",
    ts: str = "ts",
    order: str = "request_id",
    window_seconds: int = WINDOW_SECONDS,
    max_hits: int = MAX_HITS,
    slices: int = SLICES,
) -> DataFrame:
    """Add `limited` under windows that open at a key's first hit after the last one ended.

    As in `rate_limit_tumbling`, requests meet one row per window over the limit. Windows
    of a key do not overlap, and each touches two clock-aligned ones at most, by
    which it is found.
    """
    width = window_seconds * 1_000_000
    hits = requests.select(
        "*",
        _group_key(key).alias("_key"),
        F.floor(micros(F.col(ts)) / F.lit(width)).alias("_window"),
        micros(F.col(ts)).alias("_at"),
        F.col(order).alias("_id"),
    )
    assigned = assign_anchored(hits, slices, width)
    windows = F.array_distinct(
        F.array(F.floor(F.col("_start") / F.lit(width)), F.floor((F.col("_start") + width - 1) / F.lit(width)))
    )
    cuts = _cuts(assigned, ["_key", "_start"], ["_at", "_id"], max_hits).withColumn(
        "_window", F.explode(windows)
    )
    inside = f"d._start <= f._at AND f._at < d._start + {width}"
    return _flagged(lookup_join(hits, cuts, ["_key", "_window"], "left", inside), requests)


def assign_anchored(hits: DataFrame, slices: int, width: int) -> DataFrame:
    """The window of each hit: (_key, _at, _id, _start), in microseconds."""
    at = F.col("_at")
    assigned = greedy_intervals(hits, F.col("_key"), at, at + width, F.col("_id"), slices)
    return assigned.select(
        F.col("grp").alias("_key"),
        F.col("start").alias("_at"),
        F.col("id").alias("_id"),
        (F.col("until") - width).alias("_start"),
    )


def route_of(method: Column, target: Column) -> Column:
    """Name of the route that serves a request.

    The chat endpoint is met by its exact target only; targets under the API
    prefix that no route serves are `not_found`, everything else is `static`.
    Routes ignore letter case and one trailing slash. HEAD is served as GET is, and
    an OPTIONS request under the prefix is a `preflight`.
    """
    path = path_only(target)
    route = F.when(target == CHAT_ROUTE[1], CHAT_ROUTE[0]).when(
        ~F.startswith(path, F.lit("/api")), "static"
    ).when(method == "OPTIONS", "preflight")
    for name, verb, pattern in ROUTES:
        route = route.when(method.isin(_VERBS[verb]) & path.rlike(rf"(?i)\A{pattern}/?\z"), name)
    return route.otherwise("not_found")


def classify_route(requests: DataFrame) -> DataFrame:
    return requests.withColumn("route", route_of(F.col("method"), F.col("path")))


def classify_probe(probes: DataFrame) -> DataFrame:
    """Outcome of each link check from its recorded fetch result; NULL is "no reply"."""
    url = F.coalesce("url_param", F.lit(""))
    refused = F.col("http_status").isNotNull() & ~F.col("http_status").between(200, 299)
    failed = F.col("error").isNotNull() | refused
    outcome = (
        F.when(~present(url), 400)
        .when(decode_uri_component(url).isNull(), F.lit(None))
        .when(F.coalesce(F.col("error").contains("ENOTFOUND"), F.lit(False)), 404)
        .when(failed | (F.col("http_status") == 200), 200)
    )
    return probes.withColumn("outcome", outcome)
