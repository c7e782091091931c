import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from clickloom.llm import simhash as s
from clickloom.llm.components import components

DOCS = "doc_id long, text string, fp string, component_id int"


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute_components(prints, radius):
    n = len(prints)
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a in range(n):
            for b in range(n):
                if (prints[a] ^ prints[b]).bit_count() <= radius:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


TEXTS = [
    "One two three four five six seven.",
    "one TWO  three\tfour five\nsix seven.",
    "a", "", None, " \n", "a b", "É É é", "one two", "zero " * 9000, "zero " * 9001,
]


def test_fingerprints_and_edge_rows(spark):
    docs = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", 1), (None, "a", "x", 1)]
    rows = s.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    prints = [brute_print(t) for t in TEXTS]
    root = brute_components(prints, 3)
    for k in range(len(TEXTS)):
        assert got[k].fingerprint == f"{prints[k]:016x}"
        assert got[k].component_id == root[k]
    assert next(r for r in rows if r.doc_id is None).component_id == 2


def test_empty_table(spark):
    assert s.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("radius, tile", [(3, 5), (3, 2000), (1, 3), (0, 4), (5, 7)])
def test_all_close_pairs_are_linked(spark, radius, tile):
    """Chains of values that differ by few bits, in tiles so small that many pairs of them meet."""
    rng = np.random.default_rng(radius)
    values = []
    for _ in range(25):
        v = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(rng.integers(1, 8)):
            values.append(v)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                v ^= 1 << int(b)
    values = sorted({*values, 0, 2**64 - 1, 1})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = s.tile_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, tile)
    found = {r.node: r.root for r in components(links).collect()}
    groups = [found.get(v, v) for v in signed]
    root = brute_components(values, radius)
    assert len(set(zip(groups, root))) == len(set(groups)) == len(set(root))


def test_near_lists_each_difference_once():
    steps = s.near(3)
    assert len(steps) == len(set(steps))
    assert not any(tuple(-x for x in d) in set(steps) for d in steps if any(d))
    assert s.part_counts(np.array([2**64 - 1, 1], np.uint64)).tolist() == [[16] * 4, [1, 0, 0, 0]]


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1001), (1001, 1000), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[1001] == 1000


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d e"), (1, "A B c d  e"), (2, "other words are here"), (2, "other words are here"), (None, "q")],
        "doc_id long, text string",
    )
    rows = s.keep_first(docs, s.near_duplicates(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [
        (0, "q"), (1, "A B c d  e"), (2, "other words are here"),
    ]
