import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import language as l

DOCS = "doc_id long, text string, lang string, score string, held_out int"
PIECES = ["a", "b", "ab", "aba", "▁", "▁a", "ba"]


def segmentations(word, pieces):
    """All ways to write a word in pieces; a character that is no piece stands alone as None."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [head if head in pieces else None, *rest]


def brute(word, probs):
    return math.log(sum(math.prod(probs[p] for p in s) for s in segmentations(word, set(PIECES))))


@pytest.fixture(scope="module")
def lattice():
    return l.Lattice(PIECES)


def matrix(seed):
    rng = np.random.default_rng(seed)
    probs = rng.random((len(PIECES) + 1, 3))
    return probs / probs.sum(axis=0)


@pytest.mark.parametrize("width", [48, 3])
def test_all_segmentations_are_summed(lattice, monkeypatch, width):
    monkeypatch.setattr(l, "WIDTH", width)
    probs = matrix(1)
    words = ["▁a", "▁ab", "▁abab", "▁xabax", "▁", "b", "▁ababababa", "aé😀b"]
    got = lattice.scores(words, probs)
    for k in range(3):
        own = dict(zip([*PIECES, None], probs[:, k]))
        assert got[:, k] == pytest.approx([brute(w, own) for w in words])


def test_expected_uses(lattice):
    probs = matrix(2)[:, [0]]
    own = dict(zip([*PIECES, None], probs[:, 0]))
    words, counts = ["▁abab", "ab", "▁xab"], np.array([2.0, 1.0, 3.0])
    expected = dict.fromkeys(PIECES, 0.0)
    for word, n in zip(words, counts):
        ways = list(segmentations(word, set(PIECES)))
        weights = [math.prod(own[p] for p in s) for s in ways]
        for s, w in zip(ways, weights):
            for p in s:
                if p:
                    expected[p] += n * w / sum(weights)
    got = lattice.expected(words, counts, probs)
    assert got[:-1] == pytest.approx([expected[p] for p in PIECES])


def test_a_very_long_word_does_not_underflow(lattice):
    assert np.isfinite(lattice.scores(["▁" + "ab" * 20_000], matrix(3))).all()


WORDS = {"en": "the and of water house with people".split(), "de": "und der die haus wasser mit leute".split()}


def documents(n=200):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        lang = "en" if k % 3 else "de"
        rows.append((k, " ".join(rng.choice(WORDS[lang], 12)), lang))
    return rows


def test_held_out_documents(spark):
    odd = [
        (900, None, "en"), (901, "", "de"), (902, "123 !?", "en"), (903, "the and", None),
        (None, "und der", "de"), (3, documents()[3][1], "en"), (904, "the " * 30_000, None),
    ]
    rows = documents() + odd
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    model = l.train(df, l.default_vocabulary())
    got = l.identify(df, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in documents()}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id]
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    odd_pred = {r.doc_id: r.lang_pred for r in got}
    assert [odd_pred[k] for k in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "en", "en", "de"]


def test_held_out_rows_teach_nothing(spark):
    """A language that only held-out rows have is not learned."""
    rows = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 5 == 0 else g) for k, t, g in documents()]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    assert l.train(df, l.default_vocabulary()).languages == ["de", "en"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    model = l.train(none, l.default_vocabulary())
    assert l.identify(none, model).count() == 0
    df = spark.createDataFrame([(1, "some words", None, "x", 1)], DOCS)
    assert l.identify(df, l.train(df, l.default_vocabulary())).first().lang_pred == "und"


def test_known_languages_stay(spark):
    rows = [*documents(30), (900, None, "en"), (901, "77", "de")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("long")}
    )
    kept = l.keep_known(df, l.train(df, l.default_vocabulary()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_long_words_are_counted_like_short_ones(lattice):
    """Uses in a word of hundreds of characters, against sums in exact fractions."""
    probs = matrix(5)[:, [0]]
    own = {p: Fraction(float(x)) for p, x in zip([*PIECES, None], probs[:, 0])}
    word = "▁" + "abxaba" * 60
    share = lambda a, b: own.get(word[a:b], own[None] if b - a == 1 else 0)
    n = len(word)
    fore, back = [Fraction(1)], {n: Fraction(1)}
    for e in range(1, n + 1):
        fore.append(sum(fore[a] * share(a, e) for a in range(max(0, e - 3), e)))
    for a in range(n - 1, -1, -1):
        back[a] = sum(share(a, e) * back[e] for e in range(a + 1, min(n, a + 3) + 1))
    expected = dict.fromkeys(PIECES, 0.0)
    for a in range(n):
        for e in range(a + 1, min(n, a + 3) + 1):
            if word[a:e] in expected:
                expected[word[a:e]] += 2 * float(fore[a] * share(a, e) * back[e] / fore[n])
    got = lattice.expected([word], np.array([2.0]), probs)
    assert got[:-1] == pytest.approx([expected[p] for p in PIECES])


def test_languages_without_spaces_are_learned(spark):
    rows = [(k, t.replace(" ", ""), g) for k, t, g in documents(60)]
    rows = [(k, t + t, g) for k, t, g in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = {r.doc_id: r.lang_pred for r in l.identify(df, l.train(df, l.default_vocabulary())).collect()}
    assert got == {k: g for k, _, g in rows}


@pytest.mark.parametrize("size", [40, 45, 47, 49, 60, 500])
def test_unseen_runs_do_not_underflow(size):
    """A run that no language has seen leaves the decision to the other words."""
    lattice = l.Lattice(["▁", "▁a", "▁b", "水", "火"])
    probs = np.full((6, 2), 8e-8)
    probs[1], probs[2], probs[-1] = (0.1, 0.9), (0.9, 0.1), l.UNSEEN
    run = "水火" * (size // 2) + "水" * (size % 2)
    langs, scores = l.Model(["de", "en"], lattice, probs).judge([f"a a a {run}", f"b b b {run}", run])
    assert langs == ["en", "de", "de"]
    assert scores == pytest.approx([729 / 730, 729 / 730, 0.5])
