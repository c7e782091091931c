import re

import pytest
from pyspark.sql import functions as F

from clickloom.llm import pii

DOCS = "doc_id long, text string, n_entities string, kind string, known_map int"
CLEAN = "Years 2018 2019 2020 2021 and 1990-1991-1992-1993. In 2024 some 1,200 people (of 35) saw version 3.11.2 at 10:45; a@b is no address, 12-34 no number."
ROWS = [
    (1, "Mail Ann.Lee99@Mail.example.com or ann.lee99@mail.example.com; call +1 (017) 555-7713."),
    (2, "ANN.LEE99@MAIL.EXAMPLE.COM +1 017 555 7713 and 4111 1111 1111 1111, 4111111111111111 9915762804490123"),
    (3, "Hosts 10.1.2.3, 192.168.7.9 and 97.51.17.173. SSN 123-45-6789. IBAN DE89 3704 0044 0532 0130 00."),
    (4, "Mrs. Anna Smith met Mr Smith and Dr Петрова; Frau Müller, Herr Öz, MRS. ANNA SMITH"),
    (5, CLEAN),
    (6, None),
    (7, ""),
    (None, "from x.y@z.example.org"),
    (1, "Mail Ann.Lee99@Mail.example.com or ann.lee99@mail.example.com; call +1 (017) 555-7713."),
    (8, "a1@b.example.com " * 3000 + "word " * 30_000),
    (9, "a" * 100_000 + " " + "a." * 50_000 + " " + "1 " * 50_000 + "@" * 1000),
]


@pytest.fixture(scope="module")
def texts(spark):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in ROWS], DOCS)
    out = pii.replace_personal(df, "key")
    assert sorted(out.columns) == sorted(df.columns)
    rows = out.collect()
    assert len(rows) == len(ROWS) and {r.kind for r in rows} == {"y"}
    return rows


def test_nothing_personal_is_left(texts):
    by_id = {r.doc_id: r.text for r in texts}
    assert by_id[5] == CLEAN and by_id[6] is None and by_id[7] == ""
    for gone in ("lee99", "7713", "4111", "97.51", "192.168.7.9", "123-45", "0532", "Smith", "Anna", "Müller"):
        assert not any(gone.lower() in (t or "").lower() for t in by_id.values())
    assert [r.n_entities for r in texts if r.doc_id == 5] == [0]
    assert [r.n_entities for r in texts if r.doc_id == 1] == [3, 3]


def test_one_thing_has_one_surrogate(texts):
    one, other = [r.text for r in texts if r.doc_id == 1]
    assert one == other
    first, second = re.findall(r"\S+@[\w.]+\w", one)
    assert first.lower() == second.lower() and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d\d@[a-z]{4}\.[a-z]{7}\.com", second)
    two = next(r.text for r in texts if r.doc_id == 2)
    assert two.split()[0] == second.upper()
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", re.match(r"\S+ (\+1 \d{3} \d{3} \d{4})", two)[1])
    spaced, plain, bad = re.search(r"and (\d{4} \d{4} \d{4} \d{4}), (\d{16}) (\d{16})", two).groups()
    assert spaced.replace(" ", "") == plain
    luhn = lambda n: sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(reversed(n))) % 10 == 0
    assert luhn(plain) and not luhn(bad)


def test_types_and_formats_are_kept(texts):
    three = next(r.text for r in texts if r.doc_id == 3)
    assert re.fullmatch(
        r"Hosts 10\.[\d.]+, 10\.[\d.]+ and (?!10\.)[\d.]+\. SSN \d{3}-\d{2}-\d{4}\. IBAN DE\d\d( \d{4}){4} \d\d\.", three
    )
    four = next(r.text for r in texts if r.doc_id == 4)
    m = re.fullmatch(
        r"Mrs\. (\w+lina) (\w+) met Mr (\w+) and Dr ([А-я]+); Frau (\w+), Herr (\w+), MRS\. (\w+) (\w+)", four
    )
    assert m and m[2] == m[3] and m[7] == m[1].upper() and m[8] == m[2].upper()
    assert len({m[2], m[5], m[6]}) == 3


def rewritten(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_personal(df, "key").orderBy("doc_id").collect()]


def test_a_person_is_one_whatever_the_title(spark):
    one, two, three = rewritten(
        spark, "Mrs Anna Smith came. Dr Anna Smith left.", "Prof. Anna Smith", "Mr Jean-Luc O'Neil, MR JEAN-LUC O'NEIL"
    )
    m = re.fullmatch(r"Mrs (\w+lina \w+) came\. Dr (.+) left\.", one)
    assert m and m[1] == m[2] and two == f"Prof. {m[1]}"
    m = re.fullmatch(r"Mr (\w+ldo) (\w+), MR (\w+) (\w+)", three)
    assert m and (m[3], m[4]) == (m[1].upper(), m[2].upper())


def test_names_without_a_title_follow(spark):
    one, other = rewritten(
        spark,
        "Mrs Anna Smith said hello; Smith left. SMITH's car, Anna-Lena, smith, Smithson, x@Smith.example.org",
        "Smith stands here without a title.",
    )
    m = re.fullmatch(
        r"Mrs (\w+) (\w+) said hello; (\w+) left\. (\w+)'s car, Anna-Lena, smith, Smithson, \S+", one
    )
    assert m and m[3] == m[2] and m[4] == m[2].upper() and "Smith" not in m[2]
    assert other == "Smith stands here without a title."


def test_possessives_stay(spark):
    one, two = rewritten(spark, "Mr Lee's car and Mr Lee", "Mr Lee’s")
    m = re.fullmatch(r"Mr (\w+)'s car and Mr (\w+)", one)
    assert m and m[1] == m[2] and two == f"Mr {m[1]}’s"


def test_country_codes_and_times(spark):
    found = rewritten(
        spark, "+49 30 1234567", "+1 (555) 123-4567", "+420 222 333 444", "1700000000000 at 17000000000000001", "4111111111111111"
    )
    patterns = [r"\+49 \d\d \d{7}", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\+420 \d{3} \d{3} \d{3}"]
    for text, pattern in zip(found, patterns):
        assert re.fullmatch(pattern, text)
    assert "1234567" not in found[0] and "222 333" not in found[2]
    assert found[3] == "1700000000000 at 17000000000000001" and found[4] != "4111111111111111"


def test_session_key(spark, settings):
    assert pii.session_key(spark) != pii.session_key(spark)
    settings(clickloom__personalDataKey="mine")
    assert pii.session_key(spark) == "mine"


def test_few_surrogates_collide_and_stay_distinct(spark):
    """Things with room for few surrogates: collisions are drawn again until none is left."""
    things = [("email", f"{a}@{b}.example") for a in "abcdefghijklmnop" for b in "abcdefghij"]
    things += [("ssn", f"{k:09d}") for k in range(300)]
    df = spark.createDataFrame(things, "kind string, norm string")
    rows = pii.registry(df, "k").collect()
    assert {(r.kind, r.norm) for r in rows} == set(things)
    assert len({(r.kind, r.surrogate.lower()) for r in rows}) == len(things)
    assert not {(r.kind, r.surrogate.lower()) for r in rows} & set(things)


def test_other_keys_give_other_surrogates(spark):
    df = spark.createDataFrame([("ssn", "123456789")], "kind string, norm string")
    drawn = {pii.registry(df, key).first().surrogate for key in ("a", "b", "a")}
    assert len(drawn) == 2


def test_empty_table(spark):
    assert pii.replace_personal(spark.createDataFrame([], DOCS), "k").count() == 0


def test_no_python_in_the_main_path(spark):
    df = spark.read.schema(DOCS).parquet(_stored(spark))
    plan = pii.replace_personal(df, "hidden-key")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|hidden-key", plan)


def _stored(spark):
    from clickloom.storage import new_folder

    path = new_folder(spark, "pii-test")
    spark.createDataFrame([(i, t, "x", "y", 1) for i, t in ROWS], DOCS).write.parquet(path)
    return path


def test_patterns_find_whole_things(spark):
    texts = ["x+y.z@a-b.co.uk,", "(555) 123-4567", "255.255.255.255", "1.2.3.4.5", "256.1.1.1", "123456789012",
             "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "4111-1111-1111-1111", "3782 822463 10005"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(pii.ANY), F.lit(0))).collect()]
    assert got == [["x+y.z@a-b.co.uk"], ["(555) 123-4567"], ["255.255.255.255"], [], [], [], [],
                   ["4111-1111-1111-1111"], ["3782 822463 10005"]]
