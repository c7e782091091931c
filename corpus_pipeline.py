"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import copies, language, packing, pii, simhash
from clickloom.llm.common import stored, table
from clickloom.llm.decontaminate import remove_leaks

#: A stage's Python workers live on into the next stages, so they keep little: scores of so
#: many words in the first stage, and so many bytes of words' ids, twice, in the last.
CACHED_WORDS, CACHED_BYTES = 60_000, 4_000_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as `lang`.

    Null, empty and letterless texts go; repeated rows are each judged; an empty table
    stays empty; columns other than COLUMNS go.
    """
    model = language.train(docs, language.default_vocabulary())
    return language.keep_known(docs, model, CACHED_WORDS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Texts link by SimHash, as in `op6_simhash`, or if their sets of shingles are alike, which
    finds near copies with fingerprints far apart; a group is all that links reach. Of equal rows one stays; different texts with one doc_id are told apart; a text without
    words is a copy of others without; an empty table stays empty.
    """
    return copies.keep_one(docs.select(*COLUMNS), simhash.near_duplicates)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark's items.

    A null text has none; repeated rows are cut alike; an empty table stays empty.
    """
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data.

    The key is that of the session setting, else a fresh one for this run. Null and empty
    texts stay; repeated rows are changed alike; an empty table stays empty.
    """
    changed = pii.replace_personal(docs.select(*COLUMNS), pii.session_key(spark))
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, laid out in sequences.

    A null or empty text has the end id alone; repeated rows are packed each on its own; an
    empty table gives no rows.
    """
    return packing.pack(docs, packing.default_tokenizer(), cached_bytes=CACHED_BYTES)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", clean_benchmark),
    ("personal_data", replace_personal),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows stored and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
