import math

import numpy as np
import pytest

from clickloom.llm import whitening as w

ROWS = "vec_id long, embedding array<float>, n long, component int"


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], ROWS)
    return w.whiten(df, **options).toPandas().sort_values(["vec_id", "component"])


def brute(rows):
    whole = [
        (i, [math.floor(64 * float(np.float32(c))) + w.SHIFT for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    n, x = len(whole), np.array([v for _, v in whole])
    sums = x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    deviation = [sum((n * c - int(s)) ** 2 for c, s in zip(v.tolist(), sums.tolist())) for v in x]
    z = centred @ axes[:, order] / np.sqrt(values[order])
    return [i for i, _ in whole], n, deviation, z, values[order] / values.sum()


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(w, "BLOCK_NUMBERS", block)
    monkeypatch.setattr(w, "MIN_BLOCK_ROWS", 16)
    draw = np.random.default_rng(3)
    rows = [(k, (draw.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for k in range(300)]
    rows += [(k, [9.0, -7.0, 5.0, 0.5, 0.25]) for k in range(300, 500)]  # copies
    rows += [(600, None), (601, [1.0, None, 1.0, 1.0, 1.0]), (602, [float("inf")] * 5)]
    out = found(spark, rows)
    ids, n, deviation, z, shares = brute(rows)
    assert out.groupby("vec_id").component.apply(list).tolist() == [[1, 2, 3, 4, 5]] * n
    assert out.vec_id.unique().tolist() == ids and set(out.n) == {n}
    assert out.deviation.tolist() == np.repeat(deviation, 5).tolist()
    got = out.whitened.to_numpy().reshape(n, 5)
    assert np.abs(got * np.sign(got[0]) - z * np.sign(z[0])).max() < 1e-9
    assert np.abs(out.explained.to_numpy().reshape(n, 5) - shares).max() < 1e-12
    error = np.abs(got.T @ got / n - np.eye(5)).max()
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9 and error < 1e-9


def test_components_asked(spark):
    rows = [(k, [float(k % 7), float(k * k % 11), float(k * 3 % 5), 1.0]) for k in range(50)]
    assert set(found(spark, rows, components=2).component) == {1, 2}
    assert set(found(spark, rows).component) == {1, 2, 3}  # the last entry is constant


def test_tables_without_variance(spark):
    assert len(found(spark, [])) == 0
    assert len(found(spark, [(1, None), (2, [float("nan")])])) == 0
    assert len(found(spark, [(1, [0.5, 0.1])] * 3)) == 0
    assert len(found(spark, [(1, []), (2, [])])) == 0


def test_odd_rows(spark):
    out = found(spark, [(None, [1.0, 2.0]), (4, [2.0]), (4, [2.0]), (5, [3.0, 7.0])])
    assert len(out) == 8 and out.vec_id.isna().sum() == 2  # repeated rows come out each
    assert out.deviation.notna().all()
    far = found(spark, [(1, [1e30, 2.0]), (2, [3.0, 4.0])])
    assert far.deviation.isna().all() and np.isfinite(far.whitened).all()
