"""What Python workers the stages of the pipeline take, and what they keep."""

import pyarrow as pa
import pytest

from clickloom.llm import common, decontaminate, language, packing, pii, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k}" for k in range(12))


def python_nodes(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("PythonUDF")


@pytest.mark.parametrize("part", [10**6, 6])
def test_leaks_are_found_and_cut_by_one_worker(spark, monkeypatch, part):
    """However many automata there are: nodes in a row would each take a worker."""
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", part)
    text = "clean text goes on and on. " * 5
    docs = spark.createDataFrame([(1, text + LONG, "en", None, 0), (2, text, "en", None, 0)], DOCS)
    items = spark.createDataFrame([("a", LONG), ("b", "two plus three")], "item_id string, text string")
    for found in (decontaminate.remove_leaks(docs, items), decontaminate.leak_report(docs, items)):
        assert python_nodes(found) == 1 and found.count() == 2
    assert {r.doc_id: r.text for r in decontaminate.remove_leaks(docs, items).collect()} == {1: text.rstrip(), 2: text}


def test_small_tables_of_the_driver_need_no_worker(spark, monkeypatch):
    """Lists given to Spark become RDDs, read by a second kind of workers."""
    made = spark.createDataFrame([(k, "plain words", "en", None, 0) for k in range(1, 30)], DOCS)
    docs = spark.createDataFrame(made.toArrow())
    things = docs.selectExpr("'email' kind", "'ann@example.org' norm").distinct()
    fingerprints = docs.selectExpr("doc_id * 7 as fp")
    given = []
    original = type(spark).createDataFrame

    def noted(session, data, *more, **named):
        given.append(type(data))
        return original(session, data, *more, **named)

    monkeypatch.setattr(type(spark), "createDataFrame", noted)
    language.train(docs, language.default_vocabulary())
    pii.registry(things, "key").count()
    simhash.tile_links(fingerprints).count()
    assert len(given) >= 3 and set(given) == {pa.Table}


def test_few_rows(spark):
    schema = pa.schema([("part", pa.int32()), ("name", pa.string())])
    found = common.few_rows(spark, [(1, "a"), (None, None)], schema)
    assert found.dtypes == [("part", "int"), ("name", "string")]
    assert [tuple(r) for r in found.collect()] == [(1, "a"), (None, None)]
    assert common.few_rows(spark, [], schema).collect() == []


def test_batches_are_cut_to_bytes():
    texts = ["a" * 10, "b" * 5000, "c" * 10, None, "d" * 10, "e" * 400] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(common.small_batches(iter([batch]), 50, 1000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts)


def test_words_kept_while_packing_are_bounded():
    """A batch of many rows and words is learnt in parts: kept are cached_bytes, and one part's words more."""
    tokenizer = packing.public_tokenizer(packing.default_tokenizer())
    texts = [" ".join(f"{chr(97 + k % 26)}{k:x}q{n}" for n in range(60)) for k in range(1500)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(1500), pa.int64()), pa.array(texts), pa.array([0] * 1500, pa.int64())],
        names=["doc_id", "text", "prompt"],
    )
    most = 0
    for _ in packing.pack_partition([batch], tokenizer, packing.Limits(), 0, 100_000):
        most = max(most, common.worker_cache("packing")["bytes"])
    assert most < 100_000 + 100 * 60 * (packing.WORD_BYTES + 60)
