import random

import numpy as np
import pytest

from clickloom.llm import copies as c

DOCS = "doc_id long, text string, lang string"


def brute_sets(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_kept(rows):
    """Rows that stay, by comparing all pairs."""
    rows = list(dict.fromkeys(rows))
    sets = [brute_sets(r[1]) for r in rows]
    root = list(range(len(rows)))
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])]
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for r, k in zip(rows, root):
        groups.setdefault(k, []).append(r)
    return groups.values()


def varied(draw, words, changes):
    out = list(words)
    for at in draw.sample(range(len(out)), changes):
        out[at] = f"new{draw.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("chunk", [c.CHUNK, 300])
def test_against_all_pairs(spark, monkeypatch, chunk):
    """Copies with a few changed words, whose fingerprints are often far apart."""
    monkeypatch.setattr(c, "CHUNK", chunk)
    draw = random.Random(6)
    rows = []
    for k in range(40):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(60, 140))]
        for n in range(4):
            rows.append((len(rows), varied(draw, words, n), "en"))
    rows += [(None, "Only  HERE", "en"), (None, "only here", "en"), (500, None, "en"), (501, " ", "en")]
    got = [tuple(r) for r in c.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    groups = brute_kept(rows)
    assert len(got) == len(groups)
    for group in groups:
        ids = [r[0] for r in group if r[0] is not None]
        stay = [r for r in got if r in group]
        assert len(stay) == 1 and stay[0][0] == (min(ids) if ids else None)


def test_one_doc_id_with_different_texts(spark):
    rows = [
        (1, "a clean text that nobody else has at all", "en"),
        (1, "another text with other words in each of its places", "en"),
        (1, "another text with other words in each of its places", "en"),
        (None, "a row without a name", "en"),
        (None, "a row  without a NAME", "en"),
        (None, "some other row that has none", "en"),
    ]
    got = [tuple(r) for r in c.keep_one(spark.createDataFrame(rows, DOCS).repartition(5)).collect()]
    assert len(got) == 4 and {rows[0], rows[1], rows[5]} < set(got)


def test_empty_table(spark):
    assert c.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_a_set_of_shingles():
    text = "one two THREE four  five six one two three four five"
    assert len(c.shingles(text)) == len(brute_sets(text)) == 6
    assert len(c.shingles("")) == 0 and c.bands(c.shingles("")) == []
    assert len(c.shingles("a b")) == 1
    assert np.array_equal(c.shingles("a B"), c.shingles("A\tb"))
