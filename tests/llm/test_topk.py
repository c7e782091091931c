import math
import random

import numpy as np
import pytest

from clickloom.llm import topk as t

ROWS = "vec_id long, embedding array<float>, score int, label int"


def brute(rows, k, every):
    whole = []
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.append((vec_id, [math.floor(64 * float(np.float32(x))) for x in vector]))
    asked = {}
    for vec_id, w in whole:
        if vec_id % every == 0:
            asked[vec_id] = min(asked.get(vec_id, w), w)
    out = []
    for q, w in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(w, x)), v) for v, x in whole if v != q)
        out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], ROWS)
    return sorted(tuple(r) for r in t.top_k(df, **options).collect())


@pytest.mark.parametrize("sparse", [0.0, 0.8])
@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 7)])
def test_against_all_pairs(spark, monkeypatch, sparse, blocks):
    monkeypatch.setattr(t, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(t, "CANDIDATE_BLOCK", blocks[1])
    draw = random.Random(5)
    component = lambda: 0.0 if draw.random() < sparse else draw.choice([-0.5, 0.25, draw.gauss(0, 0.2)])
    rows = [(k, [component() for _ in range(6)]) for k in range(120)]
    rows += [(k, rows[1][1]) for k in range(200, 240)]  # many copies: ties by vec_id
    rows += [(300, None), (301, [1.0, None]), (320, [float("nan")]), (340, [float("inf")] * 6)]
    rows += [(None, [0.1] * 6), (360, []), (361, [0.5, 0.5]), (1, rows[1][1]), (20, [0.9] * 6)]
    assert found(spark, rows, k=20, every=20) == brute(rows, 20, 20)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 64 * 32)]


def test_large_components(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [-1e17, 0.0])]
    top = found(spark, rows)
    assert [r[2] for r in top] == [1, 2] and top[0][3] == 2**63 - 1 and top[1][3] == -(2**63)
