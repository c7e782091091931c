import math

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import neighbours as w

ROWS = "vec_id long, embedding array<float>, n long, links string"


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS)
    return w.near_duplicates(df).collect()


def cosine(a, b):
    size = max(len(a), len(b))
    x, y = (np.array(list(map(np.float32, v)) + [0.0] * (size - len(v)), float) for v in (a, b))
    return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute(rows):
    n = len(rows)
    near = [[] for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if usable(rows[a][1]) and usable(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= w.LEAST:
                near[a].append(b)
                near[b].append(a)
    out, root = [], {}
    for start in range(n):
        if start in root:
            continue
        reached, todo = {start}, [start]
        while todo:
            for b in near[todo.pop()]:
                if b not in reached:
                    reached.add(b)
                    todo.append(b)
        ids = [rows[a][0] for a in reached if rows[a][0] is not None]
        root |= {a: min(ids, default=None) for a in reached}
    for a, (vec_id, _) in enumerate(rows):
        out.append((vec_id, len(near[a]), root[a], vec_id is not None and vec_id == root[a]))
    return sorted(out, key=repr)


def groups(draw, sizes, noise):
    rows = []
    for size in sizes:
        centre = draw.normal(size=24)
        rows += [centre + noise * draw.normal(size=24) for _ in range(size)]
    return rows


@pytest.mark.parametrize("tile", [7, 1024])
def test_against_all_pairs(spark, monkeypatch, tile):
    """Dense groups beyond the longest list, pairs, chains, copies and strangers."""
    monkeypatch.setattr(w, "BLOCK", 32)
    monkeypatch.setattr(w, "LIST", 6)
    monkeypatch.setattr(w, "LONGEST", 12)
    monkeypatch.setattr(w, "TILE", tile)
    draw = np.random.default_rng(tile)
    vectors = groups(draw, [40, 9, 2, 2, 3] + [1] * 150, 0.1)
    start = draw.normal(size=24)
    vectors += [start + k * 0.25 * np.eye(24)[3] * np.linalg.norm(start) for k in range(12)]  # a chain
    vectors += [vectors[0]] * 30 + [vectors[60] * 2.0]
    rows = [(int(k), v.tolist()) for k, v in zip(draw.permutation(len(vectors)), vectors)]
    out = found(spark, rows)
    assert sorted([tuple(r)[:4] for r in out], key=repr) == brute(rows)
    assert {r.audited_recall for r in out} == {1.0}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(None, [1.0, 2.0]), (8, [1.0, 2.0, 0.0]), (8, [1.0, 2.1]), (9, [-1.0, 0.5]), (None, None)]
    rows += [(10, [1e30, 1e30]), (11, [1e-30, 1e-30]), (12, [3.0, -1.0]), (12, [3.0, -1.0])]
    assert sorted([tuple(r)[:4] for r in found(spark, rows)], key=repr) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert [tuple(r) for r in found(spark, [(3, [1.0])])] == [(3, 0, 3, True, 1.0)]
    assert [tuple(r) for r in found(spark, [(3, None)])] == [(3, 0, 3, True, 1.0)]


def test_audit_asks_for_longer_lists(spark, monkeypatch):
    """Where first lists cannot reach the recall, lists grow until they do."""
    turns, true_audit = [], w.audit

    def low_at_first(graph, counts, least):
        turns.append(graph.limits.first().k)
        return 0.5 if len(turns) == 1 else true_audit(graph, counts, least)

    monkeypatch.setattr(w, "audit", low_at_first)
    draw = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(groups(draw, [3, 2] + [1] * 40, 0.05))]
    assert sorted([tuple(r)[:4] for r in found(spark, rows)], key=repr) == brute(rows)
    assert len(turns) == 2 and turns[1] == 2 * turns[0]


def test_runs_cross_batches():
    keys = np.sort(np.random.default_rng(2).integers(0, 9, 100))
    batches = [pa.record_batch({"u": keys[a : a + 7]}) for a in range(0, 100, 7)]
    parts = [t["u"].to_pylist() for t in w.runs(batches, "u")]
    assert sum(parts, []) == keys.tolist()
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
