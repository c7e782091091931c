import numpy as np
import pytest

from clickloom.llm import licenses as c
from clickloom.llm.license_texts import NOTICES

DOCS = "doc_id long, text string, license_id string, start int"


def brute(text, notices):
    """Notices with CONTAINED of their shingles in some stretch as long as themselves."""
    split = text.encode().lower().translate(c.SEPARATED).split()
    shingles, out = c.shingles_of(split), set()
    for k, (_, notice) in enumerate(notices):
        own = set(c.shingles_of(notice.encode().lower().translate(c.SEPARATED).split()))
        for p in range(len(shingles)):
            if len(own & set(shingles[p : p + len(own)])) >= c.CONTAINED * len(own):
                out.add(k)
                break
    return out


def found(spark, rows, **options):
    return c.find_notices(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS), **options).collect()


def filler(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 500, n))


def test_every_notice_at_every_place(spark):
    rows = []
    for k, (_, notice) in enumerate(NOTICES):
        for at in (0, 1, 7, 33):
            rows.append((100 * k + at, f"{filler(at, at)} {notice.upper()} {filler(k, 50 + at)}"))
    got = {}
    for r in found(spark, rows):
        got.setdefault(r.doc_id, set()).add(r.notice)
    for doc_id, text in rows:
        assert got[doc_id] == brute(text, NOTICES) and doc_id // 100 in got[doc_id]


def test_changed_notices(spark):
    long = next(t for n, t in NOTICES if n == "MPL-2.0").split()
    one = " ".join([*long[:20], "changed", *long[21:]])
    many = " ".join(w if k % 4 else "changed" for k, w in enumerate(long))
    got = {r.doc_id: r for r in found(spark, [(1, f"x {one} y"), (2, many), (3, filler(1, 4000))])}
    assert set(got) == {1} and c.CONTAINED <= got[1].share < 1
    assert got[1].license_id == "MPL-2.0"


def test_spans_and_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [
        (1, f"é😀 one\n{line} two {line}"),
        (2, None), (3, ""), (4, "under the"), (None, line), (1, f"é😀 one\n{line} two {line}"),
        (5, filler(2, 30_000) + " " + line),
        (6, " ".join([line] * 300)),
    ]
    got = found(spark, rows)
    text = {i: t for i, t in rows}
    assert {text[r.doc_id][r.start : r.end] for r in got} == {line[:-1]}
    counts = {i: sum(r.doc_id == i for r in got) for i in text}
    assert counts == {1: 4, 2: 0, 3: 0, 4: 0, None: 1, 5: 1, 6: 300}


def test_short_notice_of_fewer_words(spark):
    got = found(spark, [(1, "all rights reserved"), (2, "All rights reserved now")], notices=[("X", "All Rights Reserved")])
    assert [r.doc_id for r in got] == [1]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_bands_that_would_miss_are_refused():
    with pytest.raises(ValueError):
        c.Notices(NOTICES, 8, 1)
    assert all(
        c.collision_probability(c.least_similarity(s)) >= c.LEAST_PROBABILITY for s in range(1, 400)
    )


def test_word_hashes_depend_on_the_word_only():
    starts, hashes = c.word_hashes(b"ab  cd ab")
    assert starts.tolist() == [0, 4, 7] and hashes[0] == hashes[2] != hashes[1]
    assert len(c.word_hashes(b"")[0]) == len(c.word_hashes(b"   ")[1]) == 0
