"""Secret scan: fixed patterns, and character Markov models of random strings and names."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import table, text_or_empty

# The patterns of the base kinds, in the order in which spans at one
# place are listed, with the group that is measured and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of access or hex characters that is too short holds no other match, so their
# least lengths are part of the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

MARKOV = "markov"
#: Strings the models judge: runs of these characters, of this length at least.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
#: Mean log-likelihood ratio per character pair (nats) from which a string is random.
THRESHOLD = 0.75
#: Labelled samples: words of at most so many documents, and so many random strings.
SAMPLE_DOCUMENTS = 500
SAMPLE_STRINGS = 2000

#: Character classes of the models: the characters themselves, and one class for others.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches of a pattern: array of (start, end, found), in code points.

    The pieces between the matches and the matches themselves, laid in a row, give
    each match its place.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        F.split(text, pattern, -1),
        found,
        lambda piece, hit: F.struct(
            F.coalesce(F.char_length(piece), F.lit(0)).alias("gap"), hit.alias("hit")
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.when(
            s["hit"].isNull(), F.struct((acc["at"] + s["gap"]).alias("at"), acc["out"].alias("out"))
        ).otherwise(
            F.struct(
                (acc["at"] + s["gap"] + F.char_length(s["hit"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + s["gap"]).alias("start"),
                            (acc["at"] + s["gap"] + F.char_length(s["hit"])).alias("end"),
                            s["hit"].alias("found"),
                        )
                    ),
                ).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans (start, end, kind number) of the base kinds that are long enough."""
    parts = [_long_enough(text, number, *rest) for number, (_, *rest) in enumerate(BASE)]
    return F.concat(*parts)


def _long_enough(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one base kind whose measured group has the least length."""

    def measured(m: Column) -> Column:
        return F.regexp_extract(m["found"], pattern, group) if group else m["found"]

    return F.transform(
        F.filter(matches(text, pattern), lambda m: F.char_length(measured(m)) >= least),
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")
        ),
    )


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring character classes in a table of strings (column s)."""

    def code(c: str) -> Column:
        place = F.instr(F.lit(ALPHABET), F.col(c))
        return F.when(place > 0, place - 1).otherwise(SIZE - 1).alias(c)

    letters = strings.select(F.split("s", "").alias("c")).where("size(c) > 1")
    pairs = F.zip_with(
        F.expr("slice(c, 1, size(c) - 1)"),
        F.expr("slice(c, 2, size(c) - 1)"),
        lambda x, y: F.struct(x.alias("a"), y.alias("b")),
    )
    seen = letters.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").count()
    return seen.groupBy(code("a"), code("b")).agg(F.sum("count").alias("n"))


def labelled_strings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled samples (column s): random strings, and ordinary words and identifiers.

    Random strings are digests of running numbers, written in hexadecimal (either
    case) and base 64. Ordinary ones are the words of documents (those with the
    smallest hashes of their ids, SAMPLE_DOCUMENTS about) and the names of Spark's own
    functions, joined in the ways identifiers are: in a row, with capitals, with
    underscores and hyphens.
    """
    spark = docs.sparkSession
    digest = spark.range(SAMPLE_STRINGS).select(
        F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h")
    )
    drawn = digest.select(
        F.explode(
            F.array(
                F.col("h"),
                F.upper("h"),
                F.base64(F.unhex("h")),
                F.translate(F.base64(F.unhex("h")), "+/", "-_"),
            )
        ).alias("s")
    )
    total = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, total))
    chosen = docs.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))
    )
    words = F.filter(
        F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z]{2,19}(?![A-Za-z0-9+/_=-])"), F.lit(0)),
        lambda w: F.char_length(w) >= 2,
    )
    lower = F.transform("w", F.lower)
    joined = [
        F.array_join("w", ""),
        F.array_join(F.transform("w", F.initcap), ""),
        F.array_join(lower, "_"),
        F.array_join(lower, "-"),
        F.array_join(F.transform("w", F.upper), "_"),
        F.concat(F.array_join(lower, "_"), F.lit("_"), F.size("w").cast("string")),
    ]
    ordinary = chosen.select(words.alias("w")).where(F.size("w") > 0)
    named = spark.sql("SHOW SYSTEM FUNCTIONS").select(F.col("function").alias("s"))
    plain = named.withColumn("w", F.split("s", "_")).where(F.col("s").rlike("^[a-z_0-9]+$"))
    ordinary = ordinary.union(plain.select("w"))
    return drawn, ordinary.select(F.explode(F.array(*joined)).alias("s")).where("char_length(s) > 1")


def pair_scores(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each character following each.

    Both are first-order Markov models with half a count added everywhere. The two
    tables have SIZE x SIZE entries, whatever the data.
    """
    logs = []
    for strings in labelled_strings(docs):
        counts = [[0.5] * SIZE for _ in range(SIZE)]
        for a, b, n in _pairs(strings).collect():
            counts[a][b] += n
        logs.append([[math.log(x / sum(row)) for x in row] for row in counts])
    return [r - o for random, ordinary in zip(*logs, strict=True) for r, o in zip(random, ordinary, strict=True)]


def mean_ratio(found: Column, scores: list[float]) -> Column:
    """Mean score of the character pairs of a string."""
    table = F.lit(np.array(scores))
    codes = F.transform(
        F.split(found, ""),
        lambda c: F.coalesce(
            F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(SIZE)
        ),
    )
    summed = F.aggregate(
        codes,
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(
            c.alias("last"),
            F.when(acc["last"] == 0, acc["sum"])
            .otherwise(acc["sum"] + F.get(table, (acc["last"] - 1) * SIZE + c - 1))
            .alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return summed / F.greatest(F.char_length(found) - 1, F.lit(1))


def markov_spans(text: Column, scores: list[float]) -> Column:
    """Spans of strings that the models take for random."""
    random = F.filter(
        matches(text, CANDIDATE), lambda m: mean_ratio(m["found"], scores) >= THRESHOLD
    )
    return F.transform(
        random,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(len(BASE)).alias("kind"), m["end"].alias("end")
        ),
    )


def _listed(spans: Column) -> Column:
    """kind:start:end of spans, by start, then kind, comma-joined."""
    names = F.array(*[F.lit(n) for n, *_ in BASE], F.lit(MARKOV))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) with arrays base and random of its secret spans.

    A span is (start, kind, end): code points, end exclusive, kind a number in BASE or
    its length for random strings. Spans of the models that touch a base span are not
    repeated. DataFrame functions only; the models are SIZE x SIZE numbers trained
    here from labelled samples.

    A null or empty text has no spans. Repeated rows are scanned each on its own, a
    null doc_id stays null, other columns are ignored, and an empty table gives no
    rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scores = pair_scores(plain)
    found = plain.select(
        "doc_id",
        base_spans(F.col("text")).alias("base"),
        markov_spans(F.col("text"), scores).alias("added"),
    )
    apart = F.filter(
        "added",
        lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])),
    )
    return found.select("doc_id", "base", apart.alias("random"))


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, a digest and the list of the spans of each document."""
    counts = [
        F.size(F.filter("base", _of_kind(number))).cast("long").alias(f"n_{name}")
        for number, (name, *_) in enumerate(BASE)
    ]
    return scan(docs).select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "random")).alias("spans"),
        F.size("random").cast("long").alias("n_markov"),
    )


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
