"""Factorisations of one tall matrix by blocks of rows, against NumPy's."""

import numpy as np
import pytest

import loomarray as la
from loomarray.cells import local

LA = la.linalg


@pytest.fixture
def small(spark, monkeypatch):
    """Blocks of a few rows, so that the tree has several levels."""
    from loomarray.operators import tall

    monkeypatch.setattr(tall, "TALL", 0)
    monkeypatch.setattr(tall, "BLOCK", 8)


def matrix(m: int, n: int, dtype="float64", seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(m, n)).astype(dtype)


#: Last blocks that are whole, of fewer rows than columns, or the only one.
SHAPES = [(6, 3), (48, 3), (50, 4), (41, 4), (7, 1), (130, 5)]


@pytest.mark.parametrize("dtype", ["float64", "float32"])
@pytest.mark.parametrize(("m", "n"), SHAPES)
def test_qr(small, m, n, dtype):
    x = matrix(m, n, dtype)
    q, r = LA.qr(local(x))
    want_q, want_r = np.linalg.qr(x)
    close = {"rtol": 1e-4, "atol": 1e-5} if dtype == "float32" else {"rtol": 1e-9, "atol": 1e-12}
    assert q.dtype == want_q.dtype and q.shape == want_q.shape and r.shape == want_r.shape
    assert np.allclose(q.numpy(), want_q, **close) and np.allclose(r.numpy(), want_r, **close)  # signs, too
    assert np.allclose(LA.qr(local(x), "r").numpy(), want_r, **close)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize(("m", "n"), SHAPES)
def test_singular_values(small, m, n, wide):
    x = matrix(m, n)
    x = x.T.copy() if wide else x
    u, s, v = (y.numpy() for y in LA.svd(local(x), full_matrices=False))
    want = np.linalg.svd(x, full_matrices=False)
    assert [y.shape for y in (u, s, v)] == [y.shape for y in want]
    assert np.allclose(s, want[1]) and np.allclose(u * s @ v, x)
    assert np.allclose(np.abs(u), np.abs(want[0])) and np.allclose(np.abs(v), np.abs(want[2]))
    assert np.allclose(LA.svdvals(local(x)).numpy(), want[1])
    assert np.allclose(LA.pinv(local(x)).numpy(), np.linalg.pinv(x))
    assert np.isclose(LA.cond(local(x)).item(), np.linalg.cond(x)) and np.isclose(LA.cond(local(x), -2).item(), np.linalg.cond(x, -2))
    assert LA.matrix_rank(local(x)).item() == np.linalg.matrix_rank(x)


@pytest.mark.parametrize("columns", [None, 1, 3])
@pytest.mark.parametrize("dependent", [False, True])
def test_least_squares(small, columns, dependent):
    x, y = matrix(60, 4), matrix(60, columns or 1, seed=1)
    if dependent:
        x[:, 3] = x[:, 0] - x[:, 1]
    y = y if columns else y[:, 0]
    for got, want in zip(LA.lstsq(local(x), local(y)), np.linalg.lstsq(x, y), strict=True):
        got = got.numpy() if isinstance(got, la.Array) else got
        assert np.shape(got) == np.shape(want) and np.allclose(got, want, atol=1e-9)


def test_badly_conditioned(small):
    """Q stays orthogonal where a product with an inverse would not."""
    x = matrix(64, 4) @ np.diag([1.0, 1e-5, 1e-10, 1e-13])
    q, r = (y.numpy() for y in LA.qr(local(x)))
    assert np.abs(q.T @ q - np.eye(4)).max() < 1e-13 and np.allclose(q @ r, x, rtol=0, atol=1e-14 * np.abs(x).max())


def test_dependent_columns(small):
    x = matrix(40, 3)
    x = np.column_stack([x, x[:, 0], np.zeros(40)])
    q, r = (y.numpy() for y in LA.qr(local(x)))
    assert np.allclose(q @ r, x) and np.allclose(np.tril(r, -1), 0)
    assert LA.matrix_rank(local(x)).item() == 3 and np.allclose(LA.pinv(local(x)).numpy(), np.linalg.pinv(x))
