"""Whitening against eigenvectors of the exact covariance."""

import math

import numpy as np
import pytest

from lodestar.llm import whitening


def plain(vectors):
    """(n, sums, eigenvalues, eigenvectors as rows, x) with Python's whole numbers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n = len(x)
    s = [sum(col) for col in zip(*x)]
    centred = np.array([[(n * c - t) / n for c, t in zip(row, s)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, s, e[::-1], v.T[::-1], x, centred


def table(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component string, __vector string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    good = (rng.normal(size=(700, 12)) @ mix * 0.2 + 5).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x", "y") for i, v in enumerate(good)]
    rows += [(5, good[5].tolist(), 1, "x", "y"), (None, good[6].tolist(), 1, "x", "y")]
    odd = [None, [None] + [0.0] * 11, [float("nan")] + [0.0] * 11, [float("inf")] + [1.0] * 11, [-float("inf")] + [1.0] * 11, [], [1.0, 2.0]]
    rows += [(1000 + i, v, 1, "x", "y") for i, v in enumerate(odd)]
    out = whitening.op11_jacobi_whitening(spark, table(spark, rows, str(tmp_path))).toPandas()
    used = [r[1] for r in rows[:702]]
    n, s, e, v, x, centred = plain(used)
    assert len(out) == 8 * 702 and set(out["component"]) == set(range(1, 9)) and set(out["n"]) == {702}
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    ids = [r[0] for r in rows[:702]]
    for k in range(8):
        got = out[out["component"] == k + 1].set_index("vec_id")
        want = centred @ v[k] / math.sqrt(e[k])
        sign = np.sign(want[0]) * np.sign(got["whitened"][0])
        for i in range(0, 700, 7):
            value = got.loc[[i], "whitened"].iloc[0]
            assert sign * value == pytest.approx(want[i], rel=1e-8, abs=1e-8)
        assert got["explained"].iloc[0] == pytest.approx(e[k] / e.sum(), rel=1e-9)
    one = out[out["component"] == 1].set_index("vec_id")
    for i in range(0, 700, 50):
        assert one.loc[[i], "deviation"].iloc[0] == sum((n * c - t) ** 2 for c, t in zip(x[i], s))
    assert one.index.isna().sum() == 1 and len(one.loc[[5]]) == 2
    assert sorted(map(str, ids)) == sorted(str(None) if i != i else str(int(i)) for i in one.index)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0, 3.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_nothing_to_whiten(spark, tmp_path, vectors):
    rows = [(i, v, 0, "", "") for i, v in enumerate(vectors)]
    assert whitening.op11_jacobi_whitening(spark, table(spark, rows, str(tmp_path))).count() == 0


def test_few_rows_give_few_components(spark, tmp_path):
    rows = [(i, [float(i == k) for k in range(20)], 0, "", "") for i in range(4)]
    out = whitening.op11_jacobi_whitening(spark, table(spark, rows, str(tmp_path))).toPandas()
    assert set(out["component"]) == {1, 2, 3} and out["identity_error"].iloc[0] < 1e-9


def test_rotations_agree_with_the_library():
    rng = np.random.default_rng(8)
    for d in (1, 2, 5, 64):
        a = rng.normal(size=(d, d)) * 10.0 ** rng.uniform(-6, 2, size=d)
        lengths, turns = whitening.jacobi(a)
        assert np.allclose(turns.T @ turns, np.eye(d), atol=1e-13)
        assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-10)
        b = a @ turns
        g = b.T @ b / np.outer(lengths, lengths)
        assert np.allclose(g, np.eye(d), atol=1e-13)


def test_many_triangles_fold(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>").repartition(11)
    assert whitening.whiten(df).select("identity_error").first()[0] < 1e-9
