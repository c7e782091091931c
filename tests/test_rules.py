"""Edge rows of the column rules."""

import re

import pytest
from pyspark.sql import functions as F

from clickloom.functions import rules
from clickloom.operators.chat import check_frame, check_join
from clickloom.operators.payloads import classify_payloads, payload_type_counts
from clickloom.operators.traffic import classify_probe, route_of
from clickloom.sources import text


def one(spark, rule, value):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(rule(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "code, ok", [("abc1", True), ("abc\n", False), ("a b", False), ("", False), ("\u00e9", False)]
)
def test_valid_code(spark, code, ok):
    assert one(spark, rules.valid_code, code) is ok


@pytest.mark.parametrize(
    "url, out",
    [
        ("HTTP://x", "HTTP://x"),
        ("https://x", "https://x"),
        ("ftp://x", "https://ftp://x"),
        ("x", "https://x"),
        ("a\nhttp://x", "https://a\nhttp://x"),
    ],
)
def test_normalize_url(spark, url, out):
    assert one(spark, rules.normalize_url, url) == out


def test_js_trim(spark):
    assert one(spark, rules.js_trim, "\u00a0bob\u2003x\ufeff\n") == "bob\u2003x"
    assert one(spark, rules.js_trim, "\u3000\t \u2029") == ""
    assert one(spark, rules.has_whitespace, "a\u00a0b") is True
    assert one(spark, rules.has_whitespace, "ab") is False


@pytest.mark.parametrize(
    "raw, out",
    [("a+b%2Bc", "a+b+c"), ("%zz", None), ("%", None), ("%E2%82%AC", "\u20ac"), ("%ff", None), ("%EF%BF%BD", "\ufffd")],
)
def test_decode_uri_component(spark, raw, out):
    assert one(spark, rules.decode_uri_component, raw) == out


def test_query_rules(spark):
    assert one(spark, rules.query_tail, "?shorturl=abc&x=1") == "abc&x=1"
    assert one(spark, rules.query_tail, "?shorturl=a&shorturl=b") == "a&"
    assert one(spark, rules.query_tail, "?x=1") is None

    def aid(c):
        return rules.query_param(c, "aid")

    assert one(spark, aid, "/p?xaid=1&aid=a%20b+c&aid=2") == "a b c"
    assert one(spark, aid, "/p?aid=") == ""
    assert one(spark, aid, "/p?x=1#?aid=3") is None
    assert one(spark, aid, "/p?aid=%zz") == "%zz"


def test_last_segment(spark):
    assert one(spark, rules.last_segment, "/a/b") == "b"
    assert one(spark, rules.last_segment, "/a/b/") == ""


def test_extract_code(spark):
    def code(c):
        return rules.extract_code(c, "links.example")

    assert one(spark, code, "x links.example/api/short/ab1&y links.example/api/short/c") == "ab1"
    assert one(spark, code, "linksXexample/api/short/ab1") is None


def test_first_present(spark):
    def pick(c):
        return rules.first_present(c, F.lit("remote"))

    assert one(spark, pick, "") == "remote"
    assert one(spark, pick, None) == "remote"
    assert one(spark, pick, "x") == "x"


def test_tokens(spark):
    df = spark.range(300).select(rules.generate_token().alias("t"))
    drawn = [r.t for r in df.collect()]
    assert len(set(drawn)) == 300 and all(re.fullmatch("[0-9a-f]{128}", t) for t in drawn)


@pytest.mark.parametrize(
    "frame, name, error",
    [
        ('{"username":"\u00a0bob\ufeff"}', "bob", None),
        ("{}", None, "First message must include a username."),
        ('{"username":""}', None, "First message must include a username."),
        ('{"username":5}', None, "First message must include a username."),
        ("5", None, "First message must include a username."),
        ('["username"]', None, "First message must include a username."),
        ('{"username":null}', None, "First message must include a username."),
        ("null", None, "Invalid username format."),
        (" null ", None, "Invalid username format."),
        ("not json", None, "Invalid username format."),
        ('{"username":', None, "Invalid username format."),
        ('{"username":"  "}', None, "Username cannot be empty."),
        ('\n {"username":"a"}', "a", None),
        ('{"username":"a","username":"b"}', "b", None),
        ('{"username":" a ","x":{"k":1,"k":2}}', "a", None),
        ('{"username":{"k":1,"k":2}}', None, "First message must include a username."),
        ('{"username":"a","message":{"k":1,"k":2}}', "a", None),
        ('{"username":"a","message":{"k":1,"k":}}', None, "Invalid username format."),
        ('{"username":"a","username":5}', None, "First message must include a username."),
        (None, None, None),
    ],
)
def test_first_frame(spark, frame, name, error):
    df = spark.createDataFrame([(frame,)], "first_frame string")
    assert tuple(check_join(df).select("username", "error").first()) == (name, error)


@pytest.mark.parametrize(
    "frame, status, message",
    [
        ('{"type":"message","message":{"a":1}}', "accepted", '{"a":1}'),
        ('{"type":"message","message":[]}', "accepted", "[]"),
        ('{"type":"message","message":{"a":1,"a":2}}', "accepted", '{"a":1,"a":2}'),
        ('{"type":"message","message":[{"a":1,"a":2}]}', "accepted", '[{"a":1,"a":2}]'),
        ('{"type":"message","message":"m","x":{"a":1,"a":2}}', "accepted", "m"),
        ('{"type":{"a":1,"a":2},"message":"m"}', "ignored", None),
        ('{"type":"x","message":{"a":1,"a":2}}', "ignored", None),
        ('{"username":{"a":1,"a":2},"type":"message","message":0}', "ignored", None),
        ('{"type":"message","message":{"a":1,"a":2}', "error", "Invalid message format."),
        ('{"type":"message","message":true}', "accepted", "true"),
        ('{"type":"message","message":1.5}', "accepted", "1.5"),
        ('{"type":"message","message":" "}', "accepted", " "),
        ('{"type":"message","message":0}', "ignored", None),
        ('{"type":"message","message":0.0}', "ignored", None),
        ('{"type":"message","message":false}', "ignored", None),
        ('{"type":"message","message":null}', "ignored", None),
        ('{"type":"message","message":""}', "ignored", None),
        ('{"type":"message"}', "ignored", None),
        ('{"type":"x","message":"m"}', "ignored", None),
        ('{"type":5,"message":"m"}', "ignored", None),
        ("5", "ignored", None),
        ('"message"', "ignored", None),
        ("null", "error", "Invalid message format."),
        ("not json", "error", "Invalid message format."),
    ],
)
def test_later_frame(spark, frame, status, message):
    df = spark.createDataFrame([(frame,)], "frame string")
    assert tuple(check_frame(df).select("status", "message").first()) == (status, message)


def test_message_frames_keep_the_json_type(spark):
    for message in ('{"a":[1,"x"]}', '{"a":1,"a":{"b":2}}', "5", '"t"'):
        sent = spark.createDataFrame(
            [(1, 'u"', f'{{"type":"message","message":{message}}}')],
            "frame_id long, username string, frame string",
        )
        assert text.message_frames(sent).first().json == (
            f'{{"type":"message","message":{{"username":"u\\"","message":{message}}}}}'
        )


@pytest.mark.parametrize(
    "method, target, route",
    [
        ("GET", "/api/short/ab?x=1", "short"),
        ("GET", "/api/short/ab/", "short"),
        ("POST", "/api/short/ab", "not_found"),
        ("GET", "/api/short/", "not_found"),
        ("POST", "/api/short/1/checkpassword", "checkpassword"),
        ("GET", "/api/messagewss", "messagewss"),
        ("GET", "/api/messagewss?x", "not_found"),
        ("GET", "/API/login", "static"),
        ("POST", "/api/LOGIN", "login"),
        ("GET", "/apix", "not_found"),
        ("GET", "/", "static"),
    ],
)
def test_routes(spark, method, target, route):
    df = spark.createDataFrame([(method, target)], "m string, t string")
    assert df.select(route_of(F.col("m"), F.col("t"))).first()[0] == route


@pytest.mark.parametrize(
    "url, status, error, outcome",
    [
        (None, 200, None, 400),
        ("", 200, None, 400),
        ("%zz", 200, None, None),
        ("u", 200, None, 200),
        ("u", 204, None, None),
        ("u", 404, "failed", 200),
        ("u", 500, None, 200),
        ("u", None, "getaddrinfo ENOTFOUND u", 404),
        ("u", None, "refused", 200),
        ("u", None, None, None),
    ],
)
def test_probe(spark, url, status, error, outcome):
    df = spark.createDataFrame([(url, status, error)], "url_param string, http_status int, error string")
    assert classify_probe(df).first().outcome == outcome


@pytest.mark.parametrize(
    "payload, kind, fields",
    [
        ("", None, None),
        (None, None, None),
        ("Hello, World!", "text", {"text": "Hello, World!"}),
        ("http://a.example", "url", {"url": "http://a.example"}),
        ("mailto:a@b.example", "email", {"address": "a@b.example"}),
        (
            "mailto:a@b.example?subject=S%20x&body=M&subject=T",
            "email",
            [("address", "a@b.example"), ("subject", "S x"), ("body", "M"), ("subject", "T")],
        ),
        ("tel:+1", "phone", {"number": "+1"}),
        ("sms:+1?body=Hi you", "sms", {"number": "+1", "body": "Hi you"}),
        ("https://wa.me/12?text=Hello+World", "whatsapp", {"number": "12", "text": "Hello World"}),
        ("https://wa.me/12", "whatsapp", {"number": "12"}),
        ("WIFI:T:;S:net:5;P:a=b;;", "wifi", {"T": "", "S": "net:5", "P": "a=b"}),
        ("WIFI:T:a;T:b;S:x\\;y\\\\;;", "wifi", [("T", "a"), ("T", "b"), ("S", "x;y\\")]),
        ("geo:37.7,-122.4", "geo", {"latitude": "37.7", "longitude": "-122.4"}),
        ("geo:1,2,3", "geo", {"latitude": "1", "longitude": "2", "altitude": "3"}),
        (
            "BEGIN:VCARD\r\nVERSION:3.0\r\nN:L;F\r\nTEL:+1\r\nTEL:+2\r\nEND:VCARD",
            "vcard",
            [("VERSION", "3.0"), ("N", "L;F"), ("TEL", "+1"), ("TEL", "+2")],
        ),
        (
            "BEGIN:VEVENT\nSUMMARY:M\nLOCATION:Office: 2\nEND:VEVENT",
            "event",
            {"SUMMARY": "M", "LOCATION": "Office: 2"},
        ),
        (
            "bitcoin:1A?amount=0.01&label=D",
            "bitcoin",
            {"address": "1A", "amount": "0.01", "label": "D"},
        ),
    ],
)
def test_payload(spark, payload, kind, fields):
    df = spark.createDataFrame([(payload,)], "payload string")
    row = classify_payloads(df).first()
    expected = list(fields.items()) if isinstance(fields, dict) else fields
    found = None if row.fields is None else [tuple(f) for f in row.fields]
    assert (row.type, found) == (kind, expected)
    assert payload_type_counts(df).count() == (kind is not None)
