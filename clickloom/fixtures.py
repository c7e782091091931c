"""Fixture views: each is one SQL text over the given tables that runs unchanged
in Spark and in the checking engine (see FIXTURES.md)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from clickloom.schemas import BASE_TABLES
from clickloom.sources.tables import read_table

VIEWS = {
    "users": r"""
SELECT c_custkey AS id, split_part(c_name,'#',1) AS firstname, split_part(c_name,'#',2) AS lastname, c_name AS username,
 md5('a'||CAST(c_custkey AS STRING))||md5('b'||CAST(c_custkey AS STRING))||md5('c'||CAST(c_custkey AS STRING))||md5('d'||CAST(c_custkey AS STRING)) AS token FROM customer
""",
    "shorturls": r"""
SELECT p.page_id AS id, CASE WHEN p.page_id % 3 = 0 THEN regexp_replace(p.url,'^https?://','') ELSE p.url END AS redirecturl,
 CAST(u.id AS STRING)||substr(md5(p.url),1,4) AS shorturl, u.token AS token,
 CASE WHEN p.page_id % 4 = 0 THEN 'pw'||CAST(p.page_id AS STRING) WHEN p.page_id % 20 = 1 THEN '' END AS password
 FROM (SELECT page_id, url, page_id % (SELECT CAST(floor(COUNT(*) / 3) AS BIGINT) + 1 FROM pages) AS owner FROM pages) p JOIN users u ON u.id = p.owner
""",
    "geo": r"""
SELECT '10.0.'||CAST(c_custkey % 16 AS STRING)||'.'||CAST(c_custkey AS STRING) AS ip, 'AS'||CAST(c_nationkey AS STRING) AS isp, c_mktsegment AS city, r_name AS region, n_name AS country
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 11 <> 3
""",
    "link_hits": r"""
SELECT h.event_id AS id, h.ts AS ts, COALESCE(s.shorturl,'missing'||CAST(h.k AS STRING)) AS shorturl, h.ip AS remote_addr,
 CASE h.event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN h.ip||', 172.16.0.1' ELSE h.ip END AS xff, 'agent/'||h.event_type AS useragent
 FROM (SELECT event_id, ts, event_type, (event_id * 7) % ((SELECT COUNT(*) FROM pages) + 5) AS k,
   '10.0.'||CAST(user_id % 16 AS STRING)||'.'||CAST(user_id AS STRING) AS ip FROM events) h
 LEFT JOIN shorturls s ON s.id = h.k WHERE h.k % 10 <> 9
""",
    "clicks": r"""
SELECT h.id AS id, h.shorturl AS shorturl, CAST(date_trunc('second',h.ts) AS TIMESTAMP) AS timestamp, COALESCE(NULLIF(h.xff,''),h.remote_addr) AS ip, h.useragent AS useragent, s.redirecturl AS referrer,
 g.isp AS isp, g.city AS city, g.region AS region, g.country AS country, CASE WHEN s.password <> '' THEN 'No' ELSE 'N/A' END AS password_status
 FROM link_hits h JOIN (SELECT *, row_number() OVER (PARTITION BY shorturl ORDER BY id) AS rn FROM shorturls) s ON s.shorturl = h.shorturl AND s.rn = 1 LEFT JOIN geo g ON g.ip = COALESCE(NULLIF(h.xff,''),h.remote_addr)
""",
    "unlock_attempts": r"""
SELECT CASE WHEN c.id % 8 = 7 THEN c.id - 1 ELSE c.id END AS click_id, c.shorturl AS shorturl, CASE c.id % 4 WHEN 0 THEN s.password WHEN 1 THEN 'wrong' WHEN 2 THEN '' ELSE s.password END AS password
 FROM clicks c JOIN shorturls s ON s.shorturl = c.shorturl WHERE s.password <> '' AND c.id % 3 <> 0
 UNION ALL SELECT -id, shorturl, password FROM shorturls WHERE password <> '' AND id > 0
 UNION ALL SELECT id, 'missing'||CAST(id AS STRING), 'x' FROM shorturls WHERE id % 10 = 9
""",
    "add_requests": r"""
SELECT p_partkey AS request_id, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'bad' ELSE u.token END AS token,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'example.com/'||CAST(p_partkey AS STRING) END AS redirecturl,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN replace(p_name,' ','') WHEN 3 THEN COALESCE(s.shorturl,'zz')
  ELSE CASE WHEN p_partkey % 10 = 9 THEN CAST(o.id AS STRING)||substr(md5(CAST(p_partkey - 4 AS STRING)||'salt'),1,4) ELSE 'c'||CAST(p_partkey AS STRING) END END AS customshorturlcode,
 CASE WHEN p_partkey % 3 = 0 THEN 'pw' WHEN p_partkey % 3 = 1 THEN '' END AS password
 FROM (SELECT p_partkey, p_name, p_partkey % (SELECT CAST(floor(COUNT(*) / 5) AS BIGINT) + 1 FROM part) AS owner,
   (p_partkey - 4) % (SELECT CAST(floor(COUNT(*) / 5) AS BIGINT) + 1 FROM part) AS earlier FROM part)
 JOIN users u ON u.id = owner LEFT JOIN users o ON o.id = earlier LEFT JOIN shorturls s ON s.id = p_partkey
""",
    "filter_lines": r"""
SELECT * FROM (VALUES (' ring '),(''),('WIDGET'),('  ')) AS t(value)
""",
    "remove_requests": r"""
SELECT id AS request_id, CASE id % 6 WHEN 2 THEN '' WHEN 1 THEN 'bad' ELSE token END AS token, CASE id % 6 WHEN 3 THEN NULL ELSE shorturl END AS shorturl FROM shorturls WHERE id % 2 = 0 OR id % 6 IN (1,3)
""",
    "list_requests": r"""
SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'unknown'||CAST(c_custkey AS STRING) ELSE u.token END AS token FROM customer JOIN users u ON u.id = c_custkey
""",
    "click_requests": r"""
SELECT o_orderkey AS request_id, COALESCE(s.shorturl, 'missing'||CAST(o_orderkey AS STRING)) AS shorturl FROM orders LEFT JOIN shorturls s ON s.id = o_custkey
""",
    "signup_requests": r"""
SELECT o_orderkey AS request_id, 'F' AS firstname, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'L' END AS lastname, 
 CASE WHEN o_orderkey % 2 = 0 THEN 'Customer#'||lpad(CAST(o_custkey AS STRING),9,'0') ELSE 'new'||CAST(o_custkey AS STRING) END AS username,
 CASE WHEN o_orderkey % 17 = 0 THEN 'a b' ELSE 'secret' END AS password, CASE WHEN o_orderkey % 19 = 0 THEN 'other' WHEN o_orderkey % 17 = 0 THEN 'a b' ELSE 'secret' END AS password_again FROM orders
""",
    "chat_conns": r"""
SELECT event_id AS conn_id, ts AS open_ts, ts + CAST(floor(value) AS INT) * INTERVAL '1' MINUTE AS close_ts,
 CASE event_id % 200 WHEN 0 THEN 'not json' WHEN 10 THEN 'null' WHEN 20 THEN '{"username":5}' WHEN 30 THEN '{"username":"  "}' WHEN 40 THEN NULL WHEN 50 THEN '{"username":"x","username":"twice"}' ELSE '{"username":" user'||CAST(user_id % 8 AS STRING)||' "}' END AS first_frame FROM events
""",
    "chat_frames": r"""
SELECT event_id AS frame_id, event_id - event_id % 40 AS conn_id, ts, CASE event_id % 7 WHEN 0 THEN '{"type":"message","message":""}' WHEN 1 THEN 'not json' WHEN 2 THEN '{"type":"ping"}' WHEN 3 THEN 'null' WHEN 5 THEN '{"type":"message","message":{"a":'||CAST(event_id AS STRING)||',"a":2}}' ELSE '{"type":"message","message":"m'||CAST(event_id AS STRING)||'"}' END AS frame FROM events
""",
    "http_requests": r"""
SELECT event_id AS request_id, ts, '10.0.0.'||CAST(user_id AS STRING) AS ip,
 CASE event_id % 13 WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'HEAD' ELSE 'GET' END WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'OPTIONS' ELSE 'GET' END WHEN 5 THEN 'POST' WHEN 6 THEN 'POST' WHEN 7 THEN 'POST' WHEN 8 THEN 'POST' WHEN 9 THEN 'POST' ELSE 'GET' END AS method,
 CASE event_id % 13 WHEN 0 THEN '/api/short/'||CAST(user_id AS STRING)||'abcd' WHEN 1 THEN '/api/shorturlanalytics' WHEN 2 THEN '/api/validurl?url=http%3A%2F%2Fa.example%2Fx%2By' WHEN 3 THEN '/api/getshorturls' WHEN 4 THEN '/api/messagewss'
  WHEN 5 THEN '/api/short/'||CAST(event_id AS STRING)||'/checkpassword' WHEN 6 THEN '/api/signup' WHEN 7 THEN '/api/login' WHEN 8 THEN '/api/addshorturl' WHEN 9 THEN '/api/removeshorturl'
  WHEN 10 THEN '/api/nosuch' WHEN 11 THEN '/shorturlanalytics/?shorturl='||CAST(user_id AS STRING)||'abcd&x=1' ELSE '/api/short/'||CAST(user_id AS STRING)||'abcd?aid='||CAST(event_id AS STRING) END AS path,
 CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events
""",
    "api_requests": r"""
SELECT request_id, ts, ip FROM http_requests WHERE path LIKE '/api%' AND path <> '/api/messagewss'
""",
    "busy_requests": r"""
SELECT request_id, CAST(date_trunc('day', ts) AS TIMESTAMP) + CAST(request_id % 60 AS INT) * INTERVAL '1' SECOND AS ts, '10.1.0.'||CAST(request_id % 4 AS STRING) AS ip, path FROM http_requests
""",
    "url_probes": r"""
SELECT page_id AS probe_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN replace(replace(url,':','%3A'),'/','%2F') WHEN 3 THEN url||'?q=a+b%2Bc' WHEN 4 THEN url||'%zz' ELSE url END AS url_param,
 CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 404 END AS http_status, CASE page_id % 4 WHEN 2 THEN 'Request failed with status code 404' WHEN 3 THEN CASE WHEN page_id % 8 = 3 THEN 'getaddrinfo ENOTFOUND host' ELSE 'connect ECONNREFUSED' END END AS error FROM pages
""",
    "qr_payloads": r"""
SELECT page_id AS payload_id, CASE page_id % 11 WHEN 0 THEN 'Hello '||CAST(page_id AS STRING) WHEN 1 THEN url WHEN 2 THEN 'mailto:u'||CAST(page_id AS STRING)||'@example.com?subject=S&body=M' WHEN 3 THEN 'tel:+1234567'||CAST(page_id AS STRING)
 WHEN 4 THEN 'sms:+1234567?body=Hi '||CAST(page_id AS STRING) WHEN 5 THEN 'https://wa.me/123456?text=Hello+World' WHEN 6 THEN 'WIFI:T:WPA;S:net'||CAST(page_id AS STRING)||';P:p'||CASE WHEN page_id % 2 = 0 THEN chr(92)||';' ELSE '' END||'w;;' WHEN 7 THEN 'geo:37.5,-122.'||CAST(page_id AS STRING)||CASE WHEN page_id % 2 = 0 THEN ',8' ELSE '' END
 WHEN 8 THEN 'BEGIN:VCARD'||chr(10)||'VERSION:3.0'||chr(10)||'N:L'||CAST(page_id AS STRING)||';F'||chr(10)||'TEL:1'||chr(10)||'TEL:2'||chr(10)||'END:VCARD' WHEN 9 THEN 'BEGIN:VEVENT'||chr(10)||'SUMMARY:M'||CAST(page_id AS STRING)||chr(10)||'DTSTART:20250120T090000'||chr(10)||'DTEND:20250120T100000'||chr(10)||'END:VEVENT'
 ELSE 'bitcoin:1A1zP1?amount=0.'||CAST(page_id AS STRING)||'&label=D' END AS payload FROM pages
""",
}


def reads(text: str, name: str) -> bool:
    """Whether a query text reads from `name`."""
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None


def direct_views(name: str) -> list[str]:
    return [v for v in VIEWS if reads(VIEWS[name], v)]


def with_views(
    query: str, views: dict[str, str] | None = None, given: frozenset[str] = frozenset()
) -> str:
    """`query` behind a WITH list of the views it needs, directly or through others,
    except the `given` ones."""
    known = {name: text for name, text in {**VIEWS, **(views or {})}.items() if name not in given}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and reads(text, name):
                visit(known[name])
                needed.append(name)

    visit(query)
    clauses = [f"{name} AS (\n{known[name].strip()}\n)" for name in needed]
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + query.strip()


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", BASE_TABLES[name])


def run(
    spark: SparkSession, sf_dir: str, query: str, tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Result of a query over the views; `tables` gives tables or views that stand in
    for those of the same name, e.g. a stream or a stored copy."""
    tables = tables or {}
    text = with_views(query, given=frozenset(tables))
    heads = []
    for name in [*BASE_TABLES, *tables]:
        if not reads(text, name) or any(h.startswith(f"{name} AS") for h in heads):
            continue
        table = tables[name] if name in tables else base_table(spark, sf_dir, name)
        registered = f"clickloom_{uuid.uuid4().hex}"
        table.createOrReplaceTempView(registered)
        heads.append(f"{name} AS (SELECT * FROM {registered})")
    body = text.removeprefix("WITH ")
    joint = ",\n" if body != text else "\n"
    found = spark.sql("WITH " + ",\n".join(heads) + joint + body if heads else text)
    for head in heads:
        spark.catalog.dropTempView(head.split()[-1].rstrip(")"))
    return found


def view(
    spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    """One fixture view as a DataFrame."""
    found = run(spark, sf_dir, VIEWS[name], tables)
    if name == "clicks":
        found = found.withColumn("timestamp", found["timestamp"].cast("timestamp_ntz"))
    return found
