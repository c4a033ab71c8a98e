"""Comparison with NumPy, shared by the tests of the array operators."""

import numpy as np

from loomarray.cells import Array, local

A = np.arange(24.0).reshape(2, 3, 4)[:, ::-1] * 1.5 - 7
N = A.copy()
N[0, 1, 2] = N[1, 0, 0] = np.nan
Ii = np.array([[3, -1, 2], [7, 0, -5]], np.int32)
Cc = A[0] + 1j * A[1]
Bb = A > 0
D = np.array([3, 1, 2, 3, 1, 0, 7, 3.0])
S = np.array([[3, 1, 2, np.nan], [0, -1, 5, 5]])
M = np.array([[4.0, 1, 2], [1, 3, 0], [2, 0, 5]])
R = np.random.default_rng(0).normal(size=500)


def arrays():
    return [local(np.ascontiguousarray(x)) for x in (A, N, Ii, Cc, Bb)]


class Checks:
    """Collects what differs, so that one run shows all of it."""

    def __init__(self):
        self.wrong, self.count = [], 0

    def __call__(self, name, got, expected):
        self.count += 1
        try:
            g, e = got(), expected() if callable(expected) else expected
            for x, y in zip(g if isinstance(g, (list, tuple)) else [g], e if isinstance(e, (list, tuple)) else [e], strict=True):
                x, y = x.numpy() if isinstance(x, Array) else np.asarray(x), np.asarray(y)
                assert x.shape == y.shape, f"shape {x.shape}, not {y.shape}"
                assert x.dtype == y.dtype or (x.dtype.kind in "iu" and y.dtype.kind in "iu"), f"type {x.dtype}, not {y.dtype}"
                ok = np.allclose(x, y, rtol=1e-6, atol=1e-9, equal_nan=True) if y.dtype.kind in "fc" else (x == y).all()
                assert ok, f"{x.ravel()[:8]}, not {y.ravel()[:8]}"
        except Exception as problem:  # noqa: BLE001 - reported at the end
            self.wrong.append((name, f"{type(problem).__name__}: {str(problem)[:300]}"))

    def done(self):
        assert not self.wrong, self.wrong
        assert self.count
