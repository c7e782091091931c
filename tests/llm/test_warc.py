import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.llm import warc

RECORDS = (
    "record_id string, warc_type string, target_uri string, warc_date timestamp, http_headers string, "
    "payload_digest string, part int, found string"
)
T0 = datetime(2024, 1, 1)


def response(name, uri, at, fields, status="200 OK", digest="d"):
    return (name, "response", uri, at, f"HTTP/1.1 {status}\r\n" + "\r\n".join(fields), digest, 1, "x")


def revisit(name, uri, at, fields):
    return (name, "revisit", uri, at, "HTTP/1.1 304 Not Modified\n" + "\n".join(fields), None, 1, "x")


def resolved(spark, rows):
    return {r.revisit_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}


@pytest.mark.parametrize(
    "url, out",
    [
        ("HTTP://www.Example.com:80/a/b/?b=2&a=1&utm_source=x#part", "example.com/a/b?a=1&b=2"),
        ("https://user:p@example.com", "example.com"),
        ("https://example.com/?", "example.com"),
        ("https://example.com:8080/A?PHPSESSID=1&q", "example.com:8080/A?q"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, out):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(F.col("u"))).first()[0] == out


def test_outcomes_and_merged_headers(spark):
    at = lambda n: T0 + timedelta(hours=n)
    rows = [
        response("r1", "http://a.example/x", at(1), ['ETag: "1"', "Server: s", "Cache-Control: max-age=1", "Vary: a"]),
        response("r2", "http://a.example/x", at(5), ["Last-Modified: day 2", "X: y"]),
        response("r3", "http://a.example/x", at(7), ['ETag: "7"'], status="404 Not Found"),
        response("r4", None, at(0), ['ETag: "1"']),
        revisit("early", "http://a.example/x", at(1), ['ETag: "1"']),
        revisit("weak", "https://www.a.example/x/#f", at(2), ['etag: W/"1"', "Cache-Control: no-store", "Server: other"]),
        revisit("wrong", "http://a.example/x", at(3), ['ETag: "2"']),
        revisit("day", "http://a.example/x", at(8), ["Last-Modified: day 2", "Expires: later"]),
        revisit("other day", "http://a.example/x", at(8), ["Last-Modified: day 3"]),
        revisit("nothing", "http://a.example/x", at(8), []),
        revisit("no url", None, at(8), ['ETag: "1"']),
        revisit("no date", "http://a.example/x", None, ['ETag: "1"']),
        ("no headers", "revisit", "http://a.example/x", at(9), None, None, 1, "x"),
        ("other", "request", "http://a.example/x", at(9), None, None, 1, "x"),
    ]
    got = resolved(spark, rows)
    assert {k: r.outcome for k, r in got.items()} == {
        "early": "no_response", "weak": "resolved", "wrong": "validator_mismatch", "day": "resolved",
        "other day": "validator_mismatch", "nothing": "no_validator", "no url": "no_response",
        "no date": "no_response", "no headers": "no_validator",
    }
    assert got["weak"].response_id == "r1" and got["weak"].payload_digest == "d"
    assert got["weak"].headers.split("\n") == ["cache-control: no-store", 'etag: W/"1"', "server: s", "vary: a"]
    assert got["day"].response_id == "r2" and got["day"].headers == "expires: later\nlast-modified: day 2\nx: y"
    assert got["wrong"].headers is None and got["wrong"].payload_digest is None


def test_one_url_over_many_parts(spark, settings):
    """A url with most of the captures, so that it spans several parts, with ties in time."""
    settings(spark__sql__shuffle__partitions=16, spark__sql__adaptive__coalescePartitions__enabled="false")
    draw = random.Random(2)
    rows = []
    for k in range(900):
        uri = "http://hot.example/" if k % 4 else f"http://cold.example/{draw.randrange(40)}"
        at = T0 + timedelta(seconds=draw.randrange(300))
        if draw.random() < 0.1:
            rows.append(response(f"r{k:04}", uri, at, [f'ETag: "{k}"']))
        else:
            rows.append(revisit(f"v{k:04}", uri, at, ['ETag: "0"']))
    got = resolved(spark, rows)
    for r in rows:
        if r[1] == "revisit":
            earlier = [(q[3], q[0]) for q in rows if q[1] == "response" and q[2] == r[2] and q[3] < r[3]]
            assert got[r[0]].response_id == (max(earlier)[1] if earlier else None)


def test_repeated_rows_and_empty_table(spark):
    assert resolved(spark, []) == {}
    rows = [response("r", "http://a", T0, ['ETag: "1"'])] * 2 + [
        revisit("v", "http://a", T0 + timedelta(1), ['ETag: "1"'])
    ] * 3
    out = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert [(r.outcome, r.response_id) for r in out] == [("resolved", "r")] * 3
