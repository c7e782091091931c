import hashlib
import random
import re
from collections import defaultdict

import pytest

from clickloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(name or "")
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for span in {len(x) for x in windows}:
            for k in range(len(w) - span + 1):
                names = windows.get(tuple(w[k : k + span]))
                if names:
                    found |= names
                    hit.update(range(k, k + span))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def reported(spark, docs, items, window):
    rows = d.leak_report(
        spark.createDataFrame([(i, t, "en", "s", 1, 5) for i, t in docs], DOCS),
        spark.createDataFrame(items, "item_id string, text string"),
        window,
    ).collect()
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("window, seed", [(1, 1), (3, 2), (4, 3), (10, 4)])
@pytest.mark.parametrize("part", [10**6, 12])
def test_against_all_windows(spark, monkeypatch, window, seed, part):
    """Few different words, so that items overlap in every way; also over several automata."""
    monkeypatch.setattr(d, "AUTOMATON_WORDS", part)
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    items = [(str(k), text(draw.randrange(0, 3 * window))) for k in range(12)]
    items += [("0", "A, b; C"), (None, "c c c c"), ("9", None), ("8", "...")]
    docs = [(k, text(draw.randrange(0, 60))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "!?"), (103, "xyzzy " * 3000)]
    assert reported(spark, docs, items, window) == brute(docs, items, window)


def test_empty_tables(spark):
    assert reported(spark, [], [("a", "b")], 10) == {}
    assert reported(spark, [(1, "a b c")], [], 10)[1][:3] == (3, 0, 0)


def test_hit_spans_are_cut(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = [
        (1, "Before this, there is a lot of clean text. " * 2 + item.upper() + " and after it."),
        (2, "clean as it is"),
        (3, item),
        (4, None),
        (5, ""),
        (2, "clean as it is"),
    ]
    rows = d.remove_leaks(
        spark.createDataFrame([(i, t, "en", None, len(t or ""), 5) for i, t in docs], DOCS),
        spark.createDataFrame([("a", item)], "item_id string, text string"),
    ).collect()
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in rows)
    left = "Before this, there is a lot of clean text. " * 2
    assert got == [
        (1, left.rstrip() + " and after it.", len(left.rstrip()) + 14),
        (2, "clean as it is", 14),
        (2, "clean as it is", 14),
        (4, "", 0),
        (5, "", 0),
    ]


def test_short_spans_and_coverage():
    rule = d.CutRule(min_words=3, max_coverage=0.5)
    assert d.cut("a b c d e f g", [(1, 3)], rule) == "a b c d e f g"
    assert d.cut("a b c d e f g", [(1, 4)], rule) == "a e f g"
    assert d.cut("a b c d e f g", [(1, 5)], rule) is None


@pytest.mark.parametrize("part", [10**6, 6])
def test_whole_short_items_are_cut(spark, monkeypatch, part):
    """An item shorter than the window goes, part of it stays; also next to other hits."""
    monkeypatch.setattr(d, "AUTOMATON_WORDS", part)
    clean = "There is a lot of clean text here, and it goes on and on. " * 3
    long = " ".join(f"w{k}" for k in range(12))
    docs = [
        (1, clean + "What is two plus three? " + clean),
        (2, clean + "what is two plus four? " + clean),
        (3, clean + long + " what is two plus three " + clean),
    ]
    items = [("a", "What is two plus three?"), ("b", long)]
    for rule in (None, d.CutRule(min_words=15)):
        rows = d.remove_leaks(
            spark.createDataFrame([(i, t, "en", None, len(t), 5) for i, t in docs], DOCS),
            spark.createDataFrame(items, "item_id string, text string"),
            rule=rule,
        ).collect()
        got = {r.doc_id: r.text for r in rows}
        assert got == {
            1: clean.rstrip() + "? " + clean,
            2: docs[1][1],
            3: clean.rstrip() + " " + clean,
        }
