"""As-of merges, convolution of long lines, distinct slices and differences with ends, against NumPy."""

import numpy as np
import pytest
from numpy_checks import Checks

from loomarray import cells
from loomarray.cells import Array, local
from loomarray.operators import convolution
from loomarray.operators import merging
from loomarray.operators import scans as s
from loomarray.operators import sorting as so
from loomarray.operators import ufuncs as u

RNG = np.random.default_rng(11)
HOT = np.where(RNG.random(4000) < 0.4, 0.25, np.round(RNG.normal(size=4000), 2))
ODD = np.concatenate([HOT, [np.nan, np.inf, -np.inf, -0.0]])


@pytest.fixture(params=[1 << 18, 300])
def ranges(request, monkeypatch):
    """Values in one window, and in many ranges of which several hold the hot value alone."""
    monkeypatch.setattr(cells, "IN_A_WINDOW", request.param)
    monkeypatch.setattr(merging, "LITERAL", 10)


def test_places_among_edges(spark, ranges):
    chk = Checks()
    for edges in (np.sort(np.round(RNG.normal(size=500), 1)), np.full(40, 0.25), np.array([-9.0] * 20), np.array([9.0] * 20)):
        for side in ("left", "right"):
            chk(("searchsorted", len(edges), side), lambda: so.searchsorted(local(edges), local(ODD), side), np.searchsorted(edges, ODD, side))
    up = np.unique(np.round(RNG.normal(size=300), 1))
    for bins in (up, up[::-1].copy()):
        for right in (False, True):
            expected = np.digitize(HOT, bins, right)
            chk(("digitize", right), lambda: so.digitize(local(HOT), local(bins), right), expected)
            chk(("digitize few", right), lambda: so.digitize(local(HOT), bins, right), expected)
    chk("ints", lambda: so.searchsorted(local(np.arange(0, 90, 3)), local(np.arange(-5, 100))), np.searchsorted(np.arange(0, 90, 3), np.arange(-5, 100)))
    chk.done()


def test_interpolation(spark, ranges):
    chk = Checks()
    xp = np.unique(np.round(RNG.normal(size=400), 1))
    fp = RNG.normal(size=len(xp))
    for p in (lambda x: x, local):  # on the driver, and spread
        chk("inside", lambda: u.interp(local(ODD), p(xp), p(fp)), np.interp(ODD, xp, fp))
        chk("ends", lambda: u.interp(local(ODD), p(xp), p(fp), left=-7.0, right=8.0), np.interp(ODD, xp, fp, left=-7, right=8))
        for period in (1.5, -2.0):
            some = np.unique(RNG.random(60) * 1.4)
            chk(("period", period), lambda: u.interp(local(HOT), p(some), p(some**2), period=period), np.interp(HOT, some, some**2, period=period))
    chk.done()
    with pytest.raises(ValueError):
        u.interp(local(HOT), xp, fp, period=0)


@pytest.mark.parametrize("block", [1 << 16, 64])
def test_convolution(spark, monkeypatch, block):
    if block < 1000:
        old = convolution.convolved
        monkeypatch.setattr(convolution, "convolved", lambda *x: old(*x, size=block))
    chk = Checks()
    lines = {n: RNG.normal(size=n) for n in (1, 2, 7, 150, 333)}
    for n, m in ((333, 150), (150, 333), (7, 2), (2, 7), (333, 1), (1, 333), (333, 333)):
        for mode in ("full", "same", "valid"):
            x, y = lines[n], lines[m]
            chk(("convolve", n, m, mode), lambda: s.convolve(local(x), local(y), mode), np.convolve(x, y, mode))
            chk(("correlate", n, m, mode), lambda: s.correlate(local(x), local(y), mode), np.correlate(x, y, mode))
            if (n, m) == (150, 333):
                z = x + 1j * x[::-1]
                chk(("complex", n, m, mode), lambda: s.correlate(local(z), local(y + 2j), mode), np.correlate(z, y + 2j, mode))
    chk.done()


@pytest.mark.parametrize("kind", ["int8", "int32", "int64", "uint64", "bool", "float32"])
def test_convolution_types(spark, kind):
    d = np.dtype(kind)
    chk = Checks()
    x, y = (RNG.integers(0, 2, n).astype(bool) if d.kind == "b" else RNG.normal(size=n).astype(d) if d.kind == "f" else RNG.integers(np.iinfo(d).min, np.iinfo(d).max, n, dtype=d, endpoint=True) for n in (3000, 900))
    with np.errstate(all="ignore"):
        expected = np.convolve(x, y)
    got = s.convolve(local(x), local(y)).numpy()
    assert got.dtype == expected.dtype
    assert np.allclose(got, expected, rtol=1e-4, atol=1e-4) if d.kind == "f" else (got == expected).all()
    chk.count = 1


def test_blocks_are_exact():
    for n, m in ((convolution.BLOCK, 700), (5000, 4000)):
        x, y = (RNG.integers(-(2**63), 2**63, k, dtype=np.int64, endpoint=False) for k in (n, m))
        assert (convolution.exact(x, y) == np.convolve(x, y)).all()
    worst = np.full(convolution.BLOCK, -(2**15), np.int64)
    got = convolution.exact(worst, worst)
    assert got[convolution.BLOCK - 1] == convolution.BLOCK * 2**30 and got[0] == 2**30


def test_blocks_keep_inf_and_nan_where_they_are():
    x, y = RNG.normal(size=3000), RNG.normal(size=800)
    x[[5, 700]], y[[3, 9]] = [np.inf, np.nan], [np.nan, -np.inf]
    with np.errstate(all="ignore"):
        expected = np.convolve(x, y)
    assert np.allclose(convolution.together(x, y), expected, equal_nan=True)


def test_long_lines(spark):
    """Both operands over several blocks, none on the driver."""
    n, m = 400_000, 150_000
    line = lambda n, k: cells.generated((n,), np.int64, lambda i: (i * k) % 101 - 50)
    got = s.convolve(line(n, 17), line(m, 29)).numpy()
    x, y = ((np.arange(n) * 17) % 101 - 50, (np.arange(m) * 29) % 101 - 50)
    size = 1 << 20
    assert (got == np.rint(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[: n + m - 1])).all()


def test_distinct_slices(spark, ranges):
    chk = Checks()
    for x in (RNG.integers(0, 2, (400, 3)), RNG.integers(0, 2, (5, 40, 2)).astype(float), np.array([[1.0, np.nan], [1.0, 2.0], [-0.0, 3.0], [0.0, 3.0]]), RNG.integers(0, 2, (30, 2)) + 1j):
        for axis in range(x.ndim):
            chk(("unique", x.shape, axis), lambda: so.unique(local(x), axis=axis), np.unique(x, axis=axis))
            chk(("all", x.shape, axis), lambda: so.unique(local(x), True, True, True, axis=axis), [np.ravel(v) if k else v for k, v in enumerate(np.unique(x, True, True, True, axis=axis))])
    chk.done()
    with pytest.raises(IndexError):
        so.unique(local(np.zeros((2, 2))), axis=2)


def test_differences_with_ends(spark):
    chk = Checks()
    x = RNG.normal(size=(4, 5))
    for axis in (0, 1):
        shape = (1, 5) if axis == 0 else (4, 1)
        chk(("scalar", axis), lambda: s.diff(local(x), axis=axis, prepend=2.0), np.diff(x, axis=axis, prepend=2.0))
        chk(("both", axis), lambda: s.diff(local(x), n=2, axis=axis, prepend=np.ones(shape), append=0), np.diff(x, n=2, axis=axis, prepend=np.ones(shape), append=0))
    chk("line", lambda: s.diff(local(x[0]), prepend=[1.0, 2.0], append=[3.0]), np.diff(x[0], prepend=[1.0, 2.0], append=[3.0]))
    chk.done()
    assert isinstance(s.diff(local(x), 0), Array)


@pytest.mark.parametrize("chunk", [1 << 16, 50])
def test_partition_of_a_line(spark, ranges, monkeypatch, chunk):
    monkeypatch.setattr(s, "CHUNK", chunk)
    for x in (ODD, RNG.integers(-9, 9, 700), np.array([3.0]), np.full(90, 2.0), RNG.normal(size=60) + 1j):
        n = len(x)
        for kth in (0, n // 2, -1, [n // 3, n // 2, n - 1]):
            got, at = so.partition(local(x), kth).numpy(), so.argpartition(local(x), kth).numpy()
            full = np.sort(x)
            assert np.array_equal(np.sort(at), np.arange(n)) and np.array_equal(x[at], got, equal_nan=True)
            places = [0, *sorted(k % n for k in np.ravel(kth)), n]
            for k in places[1:-1]:
                assert np.array_equal(got[k], full[k], equal_nan=True)
            for lo, hi in zip(places, places[1:]):
                assert np.array_equal(np.sort(got[lo:hi]), full[lo:hi], equal_nan=True)
    with pytest.raises(ValueError):
        so.partition(local(np.arange(4)), 4)


def test_partition_does_not_sort(spark):
    """No range exchange and no sort by value in the plan; order is asked for within chunks only."""
    plan = so.partition(cells.generated((300_000,), np.int64, lambda i: (i * 7919) % 1_000_003), 150_000).df
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text
    got = plan.toPandas().sort_values("i").v.to_numpy()
    assert got[150_000] == np.sort(np.arange(300_000) * 7919 % 1_000_003)[150_000] and got[:150_000].max() <= got[150_000] <= got[150_000:].min()
