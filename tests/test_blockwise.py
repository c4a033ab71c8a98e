"""Products by blocks, products of integers in chunks, files by ranges."""

import numpy as np
import pytest

import loomarray as la
from loomarray.cells import local


@pytest.mark.parametrize("dtype", ["float64", "float32", "int64", "int32", "uint8", "complex128", "bool"])
@pytest.mark.parametrize(("n", "m", "k"), [(7, 5, 3), (1, 9, 4), (8, 8, 8)])
def test_products_by_blocks(spark, monkeypatch, dtype, n, m, k):
    from loomarray.operators import blockwise, linalg

    monkeypatch.setattr(blockwise, "SIDE", 3)
    monkeypatch.setattr(blockwise, "INNER", 2)
    monkeypatch.setattr(blockwise, "PAIRS", 2)
    monkeypatch.setattr(linalg, "BY_BLOCKS", 0)
    rng = np.random.default_rng(0)
    x, y = (np.asarray(rng.integers(-9, 9, s), float).astype(dtype) for s in ((n, m), (m, k)))
    got, want = la.matmul(local(x), local(y)), x @ y
    assert got.dtype == want.dtype and np.allclose(got.numpy(), want)


def test_tensordot_by_blocks(spark, monkeypatch):
    from loomarray.operators import linalg

    monkeypatch.setattr(linalg, "BY_BLOCKS", 0)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(3, 4, 5)), rng.normal(size=(4, 3, 2))
    assert np.allclose(la.tensordot(local(x), local(y), ([0, 1], [1, 0])).numpy(), np.tensordot(x, y, ([0, 1], [1, 0])))
    assert np.allclose(la.dot(local(x), local(rng.normal(size=(5, 2)))).numpy().shape, (3, 4, 2))
    assert np.allclose(la.cov(local(x.reshape(4, 15))).numpy(), np.cov(x.reshape(4, 15)))


@pytest.mark.parametrize("dtype", ["int64", "uint64", "complex128"])
def test_products_in_chunks(spark, dtype):
    x = np.asarray(np.random.default_rng(1).integers(1, 9, (2, 50)), dtype)
    if dtype == "complex128":
        x = x / 5 + 0.3j
    for axis in (0, 1, None):
        assert np.allclose(la.cumprod(local(x), axis, chunk=7).numpy(), np.cumprod(x, axis))


def test_fromfile_by_ranges(spark, tmp_path, monkeypatch):
    from loomarray.sources import npy

    monkeypatch.setattr(npy.blocks_of, "__defaults__", (10,))
    x = np.arange(37, dtype="<i4")
    p = str(tmp_path / "x.bin")
    x.tofile(p)
    assert (la.fromfile(p, np.int32).numpy() == x).all()
    assert (la.fromfile(p, np.int32, 12, offset=8).numpy() == x[2:14]).all()
    q = str(tmp_path / "x.txt")
    (x / 2).tofile(q, sep=", ")
    assert (la.fromfile(q, sep=",").numpy() == x / 2).all() and (la.fromfile(q, count=5, sep=",").numpy() == x[:5] / 2).all()
    with pytest.raises(FileNotFoundError):
        la.fromfile(str(tmp_path))
