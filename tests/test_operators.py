"""Rule order, edge rows and properties of the batch operators."""

from datetime import datetime, timedelta

import pytest

from clickloom import schemas
from clickloom.operators import accounts, chat, clicks, links, traffic
from clickloom.sources import tables, text

T0 = datetime(2024, 1, 1, 12, 0)


@pytest.fixture(scope="module")
def data(spark):
    users = spark.createDataFrame(
        [(1, "A", "B", "ann", "t1"), (2, "C", "D", "bob", "t2")], schemas.USERS
    )
    stored = spark.createDataFrame(
        [
            (1, "a.example", "aaa", "t1", None),
            (2, "http://b.example", "bbb", "t1", "pw"),
            (3, "c.example", "ccc", "t2", ""),
            (4, "late.example", "aaa", "t2", "other"),
        ],
        schemas.LINKS,
    )
    words = spark.createDataFrame([("Bad",)], "word string")
    return users, stored, words


def add(spark, data, rows, **options):
    requests = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "request_id long, token string, redirecturl string, customshorturlcode string, password string",
    )
    users, stored, words = data
    outcomes, new = links.add_links(requests, users, stored, words, **options)
    return {r.request_id: r.status for r in outcomes.collect()}, new


@pytest.mark.parametrize(
    "row, status",
    [
        ((None, "u", "x", None), 400),
        (("", None, "x", None), 400),
        (("t1", None, "bad bad", None), 402),
        (("t1", "", "x", None), 402),
        (("nope", "u", "bad", None), 401),
        (("t1", "u", "xBADx !", None), 403),
        (("t1", "u", "a b", None), 405),
        (("t1", "u", "abc\n", None), 405),
        (("t1", "u", "aaa", None), 404),
        (("t1", "u", "new1", None), 200),
        (("t1", "u", "", None), 200),
        (("t1", "u", None, None), 200),
    ],
)
def test_add_link_rules(spark, data, row, status):
    assert add(spark, data, [row])[0] == {0: status}


def test_add_link_batch(spark, data):
    rows = [
        ("", "u", "free", None),
        ("t2", "u", "free", "p"),
        ("t1", "u", "free", ""),
        ("t1", "u", "Free", ""),
        ("t1", "u", None, ""),
    ]
    statuses, new = add(spark, data, rows)
    assert statuses == {0: 400, 1: 200, 2: 404, 3: 200, 4: 200}
    made = {r.request_id: r for r in new.collect()}
    assert (made[1].shorturl, made[1].password, made[3].password) == ("free", "p", None)
    assert made[4].shorturl.startswith("1") and len(made[4].shorturl) == 5
    grown = tables.append_rows(data[1], new, "request_id")
    assert sorted(r.id for r in grown.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_filter_switch(spark, data):
    assert add(spark, data, [("t1", "u", "bad", None)], filter_on=False)[0] == {0: 200}


def test_remove_links(spark, data):
    requests = spark.createDataFrame(
        [(0, "", ""), (1, "", "aaa"), (2, "t2", "bbb"), (3, "t1", "aaa"), (4, "t2", "aaa"), (5, "t1", "zz")],
        "request_id long, token string, shorturl string",
    )
    hits = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "aaa")], "id long, shorturl string")
    outcomes, kept, kept_clicks = links.remove_links(requests, data[1], hits)
    found = {r.request_id: (r.status, r.reason) for r in outcomes.collect()}
    assert found == {
        0: (400, "code missing"),
        1: (400, "token missing"),
        2: (404, "not found"),
        3: (200, None),
        4: (404, "not found"),
        5: (404, "not found"),
    }
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    assert [r.id for r in kept_clicks.collect()] == [2]
    listed = links.list_links(kept, data[0].select("token"))
    assert {r.shorturl for r in listed.collect()} == {"bbb", "ccc"}


def test_empty_password_is_listed_but_open(spark, data):
    tokens = spark.createDataFrame([("t2",), ("t2",), ("x",)], "token string")
    listed = links.list_links(data[1], tokens)
    assert {r.id: r.password for r in listed.collect()} == {3: True, 4: True}
    hits = spark.createDataFrame([(1, "ccc"), (2, "bbb"), (3, "no"), (4, "aaa")], "id long, shorturl string")
    got = {r.id: (r.outcome, r.location) for r in clicks.resolve_hits(hits, data[1]).collect()}
    assert got == {
        1: (302, "https://c.example"),
        2: (200, None),
        3: (404, None),
        4: (302, "https://a.example"),
    }


def test_list_outcomes(spark, data):
    asked = spark.createDataFrame(
        [(1, "t1"), (2, "t2"), (3, "none"), (4, ""), (5, None), (6, "t1")], "request_id long, token string"
    )
    found = {tuple(r) for r in links.list_outcomes(asked, data[1]).collect()}
    assert found == {(1, 200, 2), (2, 200, 2), (3, 200, 0), (4, 400, 0), (5, 400, 0), (6, 200, 2)}


def test_limits_of_requests_without_a_key(spark):
    """A missing key is a group of its own, apart from an empty one; ties go by id."""
    rows = [(i, key, T0 + timedelta(seconds=i // 2)) for i, key in enumerate([None, "", "a"] * 4)]
    df = spark.createDataFrame(rows, "request_id long, ip string, ts timestamp_ntz")
    for rule in (traffic.rate_limit_tumbling, traffic.rate_limit_anchored):
        for most in (0, 3):
            found = rule(df, max_hits=most).filter("limited").collect()
            assert sorted(r.request_id for r in found) == list(range(12))[3 * most :]


def test_analytics_outcome(spark, data):
    requests = spark.createDataFrame(
        [(0, None), (1, ""), (2, "aaa"), (3, "bbb"), (4, "gone"), (5, "zz")],
        "request_id long, shorturl string",
    )
    seen = spark.createDataFrame([("aaa",), ("gone",), ("gone",)], "shorturl string")
    got = clicks.analytics_outcome(requests, seen, data[1])
    assert {r.request_id: r.status for r in got.collect()} == {0: 400, 1: 400, 2: 200, 3: 201, 4: 200, 5: 404}


def test_unlocks(spark, data):
    stored = spark.createDataFrame(
        [(10, "bbb", "No"), (11, "bbb", "No"), (12, "aaa", "N/A")],
        "id long, shorturl string, password_status string",
    )
    attempts = spark.createDataFrame(
        [
            (10, "bbb", "pw"),
            (10, "bbb", "pw"),
            (11, "bbb", "PW"),
            (12, "bbb", "pw"),
            (99, "bbb", "pw"),
            (11, "zz", "pw"),
            (11, "aaa", "x"),
            (11, "ccc", ""),
            (None, "bbb", "pw"),
        ],
        "click_id long, shorturl string, password string",
    )
    outcomes = clicks.unlock_outcomes(attempts, data[1], stored)
    assert sorted((r.status, r.matched or 0) for r in outcomes.collect()) == [
        (200, 1), (200, 1), (200, 1), (400, 0), (400, 0), (401, 0), (401, 0), (404, 0), (404, 0),
    ]
    assert {r.location for r in outcomes.collect()} == {None, "http://b.example"}
    opened = clicks.apply_unlocks(stored, outcomes)
    assert {r.id: r.password_status for r in opened.collect()} == {10: "Yes", 11: "No", 12: "Yes"}
    strict = clicks.apply_unlocks(stored, outcomes, strict=True)
    assert {r.id: r.password_status for r in strict.collect()} == {10: "Yes", 11: "No", 12: "N/A"}
    assert clicks.unlock_effect(outcomes).count() == 4


def test_totals_add_up(spark, data):
    seen = spark.createDataFrame([("aaa",), ("aaa",), ("gone",)], "shorturl string")
    got = clicks.click_totals(data[1], seen)
    assert {r.shorturl: r.clicks for r in got.collect()} == {"aaa": 2, "bbb": 0, "ccc": 0}


@pytest.mark.parametrize(
    "form, problem",
    [
        (("", "L", "u", "a b", "a"), accounts.MISMATCH),
        (("F", "", "u", "a b", "a b"), accounts.UNFILLED),
        (("F", "L", "u", "", None), accounts.UNFILLED),
        (("F", "L", "u", "a\u00a0b", "a\u00a0b"), accounts.WHITESPACE_IN_PASSWORD),
        (("F", "L", "u", "ab", "ab"), None),
    ],
)
def test_signup_form(spark, form, problem):
    df = spark.createDataFrame(
        [form],
        "firstname string, lastname string, username string, password string, password_again string",
    )
    assert accounts.check_signup_form(df).first().problem == problem


def test_register(spark, data):
    requests = spark.createDataFrame(
        [
            (5, "F", "L", "new", "p"),
            (3, "F", "", "new", "p"),
            (4, "F", "L", "new", "p"),
            (6, "F", "L", "ann", "p"),
            (7, "F", "L", "Ann", "p"),
        ],
        "request_id long, firstname string, lastname string, username string, password string",
    )
    outcomes, new = accounts.register(requests, data[0])
    assert {r.request_id: (r.status, r.reason) for r in outcomes.collect()} == {
        3: (400, "field missing"),
        4: (200, None),
        5: (400, "name taken"),
        6: (400, "name taken"),
        7: (200, None),
    }
    made = {r.username: r for r in new.collect()}
    assert (made["new"].id, made["Ann"].id) == (3, 4)
    assert len(made["new"].token) == 128 and made["new"].token != made["Ann"].token


def test_tumbling_limit_lets_at_most_max_through(spark):
    hits = [(i, "a", T0 + timedelta(seconds=i)) for i in range(150)]
    df = spark.createDataFrame(hits, "request_id long, ip string, ts timestamp_ntz")
    got = traffic.rate_limit_tumbling(df)
    passed = sorted(r.request_id for r in got.filter("NOT limited").collect())
    assert passed == [*range(20), *range(60, 80), *range(120, 140)]


def conns(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + timedelta(minutes=a), T0 + timedelta(minutes=b), f) for i, a, b, f in rows],
        "conn_id long, open_ts timestamp_ntz, close_ts timestamp_ntz, first_frame string",
    )


def test_chat(spark):
    named = '{"username":"%s"}'
    admissions = chat.admit(
        conns(
            spark,
            [
                (1, 0, 10, named % "x"),
                (2, 5, 30, named % " x "),
                (3, 10, 20, named % "x"),
                (4, 12, 14, named % "y"),
                (5, 13, 13, named % "z"),
                (6, 13, 18, "junk"),
            ],
        )
    )
    assert {r.conn_id: (r.admitted, r.error) for r in admissions.collect()} == {
        1: (True, None),
        2: (False, chat.TAKEN_USERNAME),
        3: (True, None),
        4: (True, None),
        5: (True, None),
        6: (False, chat.BAD_USERNAME_FRAME),
    }
    lists = chat.presence(admissions).orderBy("ts", "conn_id", "kind").collect()
    assert [(r.conn_id, r.kind, r.users) for r in lists] == [
        (1, "join", ["x"]),
        (2, "close", ["x"]),
        (1, "close", ["x"]),
        (3, "join", ["x"]),
        (4, "join", ["x", "y"]),
        (5, "close", ["x", "y"]),
        (5, "join", ["x", "y"]),
        (6, "close", ["x", "y"]),
        (4, "close", ["x"]),
        (3, "close", []),
    ]
    frames = spark.createDataFrame(
        [
            (1, 4, T0 + timedelta(minutes=13), '{"type":"message","message":"m"}'),
            (2, 4, T0 + timedelta(minutes=14), '{"type":"message","message":"late"}'),
            (3, 2, T0 + timedelta(minutes=6), '{"type":"message","message":"refused"}'),
            (4, 3, T0 + timedelta(minutes=13), '{"type":"ping"}'),
        ],
        "frame_id long, conn_id long, ts timestamp_ntz, frame string",
    )
    got = chat.fan_out(frames, admissions).collect()
    assert sorted((r.frame_id, r.recipient_conn) for r in got) == [(1, 3), (1, 4)]
    assert [tuple(r) for r in chat.delivery_counts(frames, admissions).collect()] == [(1, 2)]


def test_read_filter_words(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text(" ring \r\n\n\u00a0WIDGET\n  \n", encoding="utf8")
    assert sorted(r.word for r in text.read_filter_words(spark, str(path)).collect()) == ["WIDGET", "ring"]
    absent = text.read_filter_words(spark, str(tmp_path / "none.txt"))
    assert [r.word for r in absent.collect()] == text.DEFAULT_WORDS


def test_parse_requests(spark):
    raw = spark.createDataFrame(
        [(1, '{"redirecturl":"u","password":"p","more":1}'), (2, "{oops"), (3, None)],
        "request_id long, body string",
    )
    got = {r.request_id: r for r in text.parse_requests(raw, schemas.ADD_LINK_BODY).collect()}
    assert (got[1].redirecturl, got[1].customshorturlcode, got[1].malformed) == ("u", None, None)
    assert (got[2].redirecturl, got[2].malformed) == (None, "{oops")
    assert got[3].malformed is None


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_access_log(spark, settings, zone):
    settings(spark__sql__session__timeZone=zone)
    lines = spark.createDataFrame(
        [
            ('1.2.3.4 - - [02/Jan/2024:03:04:05 +0200] "GET /a?b HTTP/1.1" 200 12 "http://r" "ua \\"x\\""',),
            ('1.2.3.4 - bob [02/Jan/2024:03:04:05 +0000] "POST /a HTTP/1.1" 404 - "-" "-"',),
            ('1.2.3.4 - - [99/Foo/2024:03:04:05 +0000] "GET /a HTTP/1.1" 200 5 "-" "-"',),
            ("junk",),
            (None,),
        ],
        "value string",
    )
    rows, rejects = text.parse_access_log(lines)
    assert rows.count() == 2
    got = rows.orderBy("ts").collect()
    assert got[0].ts == datetime(2024, 1, 2, 1, 4, 5) and got[0].referer == "http://r"
    assert (got[1].method, got[1].status, got[1].bytes, got[1].useragent) == ("POST", 404, 0, None)
    assert rejects.count() == 3


def test_write_clicks_by_day(spark, tmp_path):
    rows = [(i, "c", T0 + timedelta(hours=8 * i)) + (None,) * 8 for i in range(6)]
    df = spark.createDataFrame(rows, schemas.CLICKS)
    tables.write_clicks(df, str(tmp_path / "clicks"))
    tables.write_clicks(df.filter("id = 0"), str(tmp_path / "clicks"))
    back = tables.read_table(spark, str(tmp_path / "clicks"), schemas.CLICKS)
    assert back.count() == 7
    assert {p.name for p in (tmp_path / "clicks").glob("date=*")} == {
        "date=2024-01-01", "date=2024-01-02", "date=2024-01-03",
    }
