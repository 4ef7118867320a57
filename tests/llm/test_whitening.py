"""Whitening against numpy on whole arrays."""

import numpy as np
import pytest

from funclab.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit - s / n).astype(np.longdouble)
    cov = (centred.T @ centred / n).astype(float)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(cov)


@pytest.mark.parametrize("values", [1 << 18, 40])
def test_against_numpy(spark, monkeypatch, values):
    """Also with blocks of a few rows each, more than a task's part of the scatter holds."""
    monkeypatch.setattr(whitening, "VALUES", values)
    monkeypatch.setattr(whitening, "BLOCKS", 3)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(150, 6)) * [3, 2, 1, 0.5, 0.3, 0.1] @ rng.normal(size=(6, 6))).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:40], np.repeat(vectors[:1], 60, axis=0)])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, share = plain(vectors)
    seen = out["whitened"].to_numpy().reshape(-1, 4)
    signs = np.sign((seen * whitened[:, :4]).sum(axis=0))
    np.testing.assert_allclose(seen * signs, whitened[:, :4], atol=1e-9)
    assert (out["n"] == n).all() and (out["deviation"].to_numpy().reshape(-1, 4) == deviation[:, None]).all()
    np.testing.assert_allclose(out["explained"].to_numpy().reshape(-1, 4), np.tile(share[:4], (len(rows), 1)), rtol=1e-9)
    fit = np.unique(np.floor(256 * vectors.astype(float)), axis=0, return_index=True)[1]
    own = np.abs(np.cov(seen[fit].T, bias=True) - np.eye(4)).max()
    assert out["identity_error"].nunique() == 1 and abs(out["identity_error"].iloc[0] - own) < 1e-9 and own < 1e-9


def test_left_out_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [-inf, 0.0]), (6, [1.0]), (7, [])]
    source = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", n long")
    out = whitening.whiten(source).toPandas()
    assert sorted(out["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 1, 1] and set(out["n"]) == {2}
    first, second = (out[out["component"] == k] for k in (1, 2))
    assert first["whitened"].abs().round(9).eq(1).all() and second["whitened"].isna().all()
    assert first["explained"].round(9).eq(1).all() and second["explained"].abs().lt(1e-9).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])]])
def test_nothing(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_one_vector(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], SCHEMA)).collect()
    assert len(out) == 4 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in out)
