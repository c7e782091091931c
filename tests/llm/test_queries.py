"""Every numbered query over its whole small table, against SQL where there is some."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from clickloom.llm.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def lines(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    assert lines(QUERIES[name](spark, SF_DIR).toPandas()) == lines(con.sql(ORACLE_SQL[name]).df())


def test_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage works on all that the one before it kept; its decisions take effect."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [
            (10_001, None, "en", None, None),
            (10_002, "12 34", None, "s", 5),
            (10_003, "mail a.b@c.example.com for more of the words", None, "s", 1),
            (10_004, "Mail  a.b@c.example.com for more of the words", "en", "s", 1),
        ],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs = docs.select(*corpus_pipeline.COLUMNS).union(odd)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        kept[name] = out.toPandas()
        docs = out
    ids = {n: set(f.doc_id) for n, f in kept.items()}
    assert {10_001, 10_002}.isdisjoint(ids["language"]) and 10_003 in ids["language"]
    assert {10_003, 10_004} & ids["near_copies"] == {10_003}
    assert kept["near_copies"].doc_id.is_unique
    assert ids["benchmark"] <= ids["near_copies"] and ids["personal_data"] == ids["benchmark"]
    text = kept["personal_data"].set_index("doc_id").text
    assert "a.b@c.example.com" not in text[10_003]
    assert ids["packing"] == ids["personal_data"]
    assert (kept["personal_data"].n_chars == kept["personal_data"].text.str.len()).all()
    assert isinstance(kept["packing"], pd.DataFrame) and kept["packing"].length.min() > 0


def test_pipeline_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0


def test_stages_with_further_columns(spark):
    """Columns with the names that stages use inside, null cells and repeated rows."""
    rows = [
        (k % 5 if k else None, f"Some words of text number {k // 2} by Mr Miller, a b c.", "en", None, 1, k, "x", None)
        for k in range(12)
    ]
    df = spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, own int, row string, key string",
    )
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language", "near_copies", "benchmark", "personal_data"):
        out = stages[name](spark, df, SF_DIR)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
        assert out.count() == len(rows) if name != "near_copies" else 0 < out.count() < len(rows)
    assert stages["packing"](spark, df, SF_DIR).count() >= len(rows)


def test_near_copies_keep_columns(spark):
    rows = [(1, "a b c d e f", 7, "r"), (2, "a b c d e  F", 8, "s"), (3, "quite another text", 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own int, row string")
    kept = corpus_pipeline.copies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_near_copies_by_simhash(spark):
    """Texts whose fingerprints are near, though few of their five-word shingles are shared, link."""
    from clickloom.llm.copies import shingles
    from clickloom.llm.simhash import fingerprint

    words = [f"w{k % 7}" for k in range(400)]
    other = [w if k % 30 else f"n{k}" for k, w in enumerate(words)]
    a, b = " ".join(words), " ".join(other)
    assert (fingerprint(a) ^ fingerprint(b)).bit_count() <= 3
    x, y = set(shingles(a).tolist()), set(shingles(b).tolist())
    assert len(x & y) < 0.8 * len(x | y)
    rows = [(5, b, "en", "s", 1), (3, a, "en", "s", 1), (None, b, "en", "t", 1), (4, "quite another text", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, df, SF_DIR)
    assert sorted(tuple(r) for r in kept.collect()) == [rows[1], rows[3]]
