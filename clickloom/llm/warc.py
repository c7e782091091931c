"""WARC revisits: not-modified captures resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import stored, table

# Headers that a 304 response may change in a stored one (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query fields that name where a visitor came from, not the resource.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)(=.*)?$"

RESOLVED, NO_RESPONSE = "resolved", "no_response"
MISMATCH, UNCHECKED = "validator_mismatch", "no_validator"


def canonical_url(url: Column) -> Column:
    """The form under which captures of one resource are filed.

    Scheme, `www.`, default port, user, fragment and a slash at the end are left out,
    the host is in lower case, and query fields are sorted without tracking ones.
    Null stays null.
    """
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(plain, r"^(?i:https?)://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.array_sort(
        F.filter(
            F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
            lambda f: (f != "") & ~F.lower(f).rlike(TRACKING),
        )
    )
    query = F.array_join(fields, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header_fields(block: Column) -> Column:
    """Header lines of an HTTP block as an array of (name in lower case, value)."""
    lines = F.filter(
        F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda s: s.rlike(r"^[^\s:]+:")
    )
    return F.transform(
        lines,
        lambda s: F.struct(
            F.lower(F.substring_index(s, ":", 1)).alias("name"),
            F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("value"),
        ),
    )


def _first(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]


def _strong(tag: Column) -> Column:
    """An entity tag without its mark of weakness: validators are compared weakly."""
    return F.regexp_replace(tag, r"^W/", "")


def merged_headers(old: Column, new: Column) -> Column:
    """Headers of the response with what the revisit may change, one per line, sorted."""
    allowed = F.filter(new, lambda f: f["name"].isin(*PERMITTED))
    kept = F.filter(old, lambda f: ~F.exists(allowed, lambda a: a["name"] == f["name"]))
    lines = F.transform(
        F.concat(kept, allowed), lambda f: F.concat(f["name"], F.lit(": "), f["value"])
    )
    return F.array_join(F.array_sort(lines), "\n")


def latest_earlier(events: DataFrame) -> DataFrame:
    """Each revisit with the latest response of its url that is strictly earlier.

    events: url, at, rid, response (a struct for full responses, null for revisits),
    and other columns, which stay. Rows are dealt by ranges of (url, at), so one url
    with very many captures lies in many parts. Each part is read in order on its
    own; what an earlier part ends with comes as one row per part of the urls that
    span several, at most two for each part, which is why that table is broadcast.
    """
    full = F.col("response").isNotNull().alias("full")
    parts = stored(
        events.select("*", full)
        .repartitionByRange("url", "at", "full", "rid")
        .withColumn("part", F.spark_partition_id()),
        "captures",
    )
    order = Window.partitionBy("url", "part").orderBy("at", "full", "rid")
    inside = F.last("response", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = parts.groupBy("url", "part").agg(
        F.max(F.when(F.col("full"), F.struct("at", "rid", "response"))).alias("end")
    )
    by_url = Window.partitionBy("url")
    spanning = (
        ends.withColumn("parts", F.count(F.lit(1)).over(by_url))
        .where("parts > 1")
        .withColumn(
            "carried",
            F.last("end", ignorenulls=True).over(
                by_url.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("url", "part", F.col("carried.response").alias("carried"))
    )
    seen = parts.withColumn("inside", inside).where(~F.col("full"))
    return (
        seen.join(F.broadcast(stored(spanning, "carried")), ["url", "part"], "left")
        .withColumn("found", F.coalesce("inside", "carried"))
        .drop("response", "full", "part", "inside", "carried")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit record with the response it stands for.

    records: record_id, warc_type, target_uri, warc_date, http_headers (status line
    and header lines), payload_digest. A full response is one with status 200. A
    revisit is filed under its canonical url and meets the latest full response that
    is strictly earlier; of those at one instant, the one with the largest record_id.

    outcome: `no_response` without such a response; by entity tag (weak comparison)
    if both have one, else by Last-Modified if both have it, `resolved` or
    `validator_mismatch`; `no_validator` if neither can be compared. Only resolved
    rows have headers (merged) and the response's payload_digest.

    Revisits with a null target_uri or warc_date have no response; such responses
    stand for nothing. Null headers are an empty block. Repeated rows stay, each with
    its result; other record types and columns are left out; an empty table gives no
    rows.
    """
    plain = records.where("warc_type in ('response', 'revisit')").select(
        F.col("record_id").cast("string").alias("rid"),
        F.col("warc_type").alias("warc_type"),
        canonical_url(F.col("target_uri").cast("string")).alias("url"),
        F.unix_micros(F.col("warc_date").cast("timestamp")).alias("at"),
        F.col("http_headers").cast("string").alias("block"),
        F.col("payload_digest").cast("string").alias("digest"),
    )
    is_full = F.coalesce(
        (F.col("warc_type") == "response")
        & F.col("block").rlike(r"^HTTP/\S+ 200(\s|$)")
        & F.col("url").isNotNull()
        & F.col("at").isNotNull(),
        F.lit(False),
    )
    response = F.struct("rid", "at", "block", "digest")
    events = (
        plain.select("*", is_full.alias("is_full"))
        .where("is_full or warc_type = 'revisit'")
        .select(
            "rid",
            "url",
            "at",
            F.when(~F.col("is_full"), F.col("block")).alias("block"),
            F.when(F.col("is_full"), response).alias("response"),
        )
    )
    old, new = header_fields(F.col("found.block")), header_fields(F.col("block"))
    judged = latest_earlier(events).select(
        "rid", "url", "found", old.alias("old"), new.alias("new")
    )
    tags = [_strong(_first(F.col(c), "etag")) for c in ("old", "new")]
    dates = [_first(F.col(c), "last-modified") for c in ("old", "new")]
    comparable = tags[0].isNotNull() & tags[1].isNotNull()
    same = F.when(comparable, tags[0] == tags[1]).otherwise(dates[0] == dates[1])
    outcome = (
        F.when(F.col("url").isNull() | F.col("found").isNull(), NO_RESPONSE)
        .when(same.isNull(), UNCHECKED)
        .when(same, RESOLVED)
        .otherwise(MISMATCH)
    )
    resolved = F.col("outcome") == RESOLVED
    return judged.withColumn("outcome", outcome).select(
        F.col("rid").alias("revisit_id"),
        "url",
        "outcome",
        F.when(F.col("outcome") != NO_RESPONSE, F.col("found.rid")).alias("response_id"),
        F.when(resolved, merged_headers(F.col("old"), F.col("new"))).alias("headers"),
        F.when(resolved, F.col("found.digest")).alias("payload_digest"),
    )


#: Captures of the given pages over a few days, in SQL that both engines read. Of each
#: page: full responses, one of them later and changed for every third page, an error
#: page, and revisits before, between and after them, by other spellings of the url
#: and with right, weak, wrong and missing validators.
CAPTURES = """
SELECT concat(c.n, '-', p.page_id) AS record_id,
  CASE WHEN c.n IN (1, 3, 5) THEN 'response' ELSE 'revisit' END AS warc_type,
  CASE WHEN c.n = 2 THEN concat(split_part(p.url, '#', 1), '#part')
       WHEN c.n = 4 THEN concat(split_part(p.url, '#', 1),
                                CASE WHEN p.url LIKE '%?%' THEN '&' ELSE '?' END, 'utm_medium=mail')
       WHEN c.n = 6 THEN replace(p.url, 'https://', 'HTTP://')
       ELSE p.url END AS target_uri,
  {instant}(1700000000 + p.page_id * 60 + c.n * 86400
            - CASE WHEN c.n = 0 THEN 3600 ELSE 0 END) AS warc_date,
  concat(
    CASE WHEN c.n IN (1, 5) THEN 'HTTP/1.1 200 OK'
         WHEN c.n = 3 THEN 'HTTP/1.1 404 Not Found' ELSE 'HTTP/1.1 304 Not Modified' END,
    CASE WHEN c.n = 6 AND p.page_id % 7 = 0 THEN ''
         WHEN c.n = 6 AND p.page_id % 2 = 0 THEN ''
         WHEN c.n = 4 AND p.page_id % 5 = 0 THEN concat({line}, 'ETag: "other"')
         WHEN c.n = 4 THEN concat({line}, 'ETag: W/"', p.page_id, '"')
         WHEN c.n >= 5 THEN concat({line}, 'ETag: "', p.page_id, 'b"')
         ELSE concat({line}, 'ETag: "', p.page_id, '"') END,
    CASE WHEN c.n = 6 AND p.page_id % 7 = 0 THEN ''
         ELSE concat({line}, 'Last-Modified: day ', CASE WHEN c.n >= 5 THEN 5 ELSE 1 END) END,
    {line}, 'Cache-Control: max-age=', c.n * 60,
    {line}, 'Content-Type: text/', CASE WHEN c.n IN (1, 3, 5) THEN 'html' ELSE 'plain' END,
    CASE WHEN c.n IN (2, 4) THEN concat({line}, 'Expires: day ', c.n) ELSE '' END,
    CASE WHEN c.n = 1 THEN concat({line}, 'Server: mill') ELSE '' END
  ) AS http_headers,
  CASE WHEN c.n IN (1, 3, 5) THEN sha1(concat(p.html, CASE WHEN c.n = 5 THEN 'b' ELSE '' END)) END
    AS payload_digest
FROM pages p, numbers c
WHERE c.n <> 5 OR p.page_id % 3 = 0
"""


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("op1_pages")
    every = "op1_pages p LATERAL VIEW explode(sequence(0, 6)) c AS n"
    text = CAPTURES.format(instant="timestamp_seconds", line="chr(10)")
    return resolve_revisits(stored(spark.sql(text.replace("pages p, numbers c", every)), "warc"))


_LINE = "chr(10)"
_FIELDS = """[[lower(split_part(s, ':', 1)), trim(regexp_replace(s, '^[^:]*:', ''))]
    for s in string_split({0}, chr(10)) if regexp_matches(s, '^[^\\s:]+:')]"""

OP1_SQL = f"""
WITH numbers AS (SELECT unnest(range(0, 7)) AS n),
captures AS ({CAPTURES.format(instant="to_timestamp", line=_LINE)}),
plain AS (
  SELECT record_id AS rid, warc_type, http_headers AS block, payload_digest AS digest, warc_date AS moment,
    regexp_replace(regexp_replace(trim(target_uri), '#.*$', ''), '^(?i:https?)://([^/?@]*@)?', '') AS bare
  FROM captures
), filed AS (
  SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www\\d*\\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    array_to_string(list_sort([f for f in string_split(regexp_extract(bare, '\\?(.*)$', 1), '&')
      if f <> '' AND NOT regexp_matches(lower(f), '^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)(=.*)?$')]), '&') AS query
  FROM plain
), events AS (
  SELECT rid, warc_type, block, digest, moment, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url
  FROM filed
), responses AS (
  SELECT url, moment, max(rid) AS rid, max_by(block, rid) AS block, max_by(digest, rid) AS digest
  FROM events WHERE warc_type = 'response' AND regexp_matches(block, '^HTTP/\\S+ 200(\\s|$)') GROUP BY url, moment
), met AS (
  SELECT v.rid, v.url, r.rid AS response_id, r.digest, {_FIELDS.format("r.block")} AS old, {_FIELDS.format("v.block")} AS new
  FROM (SELECT * FROM events WHERE warc_type = 'revisit') v
  ASOF LEFT JOIN responses r ON v.url = r.url AND v.moment > r.moment
), tagged AS (
  SELECT *,
    regexp_replace([f[2] for f in old if f[1] = 'etag'][1], '^W/', '') AS old_tag,
    regexp_replace([f[2] for f in new if f[1] = 'etag'][1], '^W/', '') AS new_tag,
    [f[2] for f in old if f[1] = 'last-modified'][1] AS old_day,
    [f[2] for f in new if f[1] = 'last-modified'][1] AS new_day,
    [f for f in new if f[1] IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'vary')] AS allowed
  FROM met
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
    WHEN old_tag IS NOT NULL AND new_tag IS NOT NULL
      THEN CASE WHEN old_tag = new_tag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN old_day = new_day THEN 'resolved' WHEN old_day <> new_day THEN 'validator_mismatch'
    ELSE 'no_validator' END AS outcome
  FROM tagged
)
SELECT rid AS revisit_id, url, outcome, response_id,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_concat(
    [f[1] || ': ' || f[2] for f in old if NOT list_contains([a[1] for a in allowed], f[1])],
    [f[1] || ': ' || f[2] for f in allowed])), chr(10)) END AS headers,
  CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest
FROM judged
"""
