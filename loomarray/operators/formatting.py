"""Text forms.  Only the cells that are shown come to the driver."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import functions as F

from loomarray.cells import I, V, Array, asarray, coords
from loomarray.operators.dense import _in


def _shown(a: Array, threshold: int, edge: int) -> np.ndarray:
    """The array, or one of its shape in which only cells near the edges are right."""
    if a.size <= threshold:
        return a.numpy()
    test = F.lit(True)
    for c, n in zip(coords(F.col(I), a.shape), a.shape, strict=True):
        if n > 2 * edge:
            test = test & ((c < edge) | (c >= n - edge))
    table = a.df.where(test).toArrow()
    out = np.lib.stride_tricks.as_strided(np.zeros(1, a.dtype), a.shape, (0,) * a.ndim)
    index = np.unravel_index(table[I].to_numpy(), a.shape)
    # a small array of the corners, with the gap left out: NumPy prints the same summary for it
    small = tuple(min(n, 2 * edge + 1) for n in a.shape)
    out = np.zeros(small, a.dtype)
    at = tuple(np.where(x < edge, x, x - n + m) if n > 2 * edge else x for x, n, m in zip(index, a.shape, small, strict=True))
    out[at] = _in(table[V], a.dtype)
    return out


def array2string(a, max_line_width=None, precision=None, suppress_small=None, separator: str = " ", prefix: str = "", threshold=None, edgeitems=None, **kw) -> str:
    a = asarray(a)
    o = np.get_printoptions()
    edge = o["edgeitems"] if edgeitems is None else edgeitems
    limit = o["threshold"] if threshold is None else threshold
    data = _shown(a, limit, edge)
    return np.array2string(data, max_line_width, precision, suppress_small, separator, prefix, threshold=0 if data.size < a.size else limit, edgeitems=edge, **kw)


def array_str(a, **kw) -> str:
    return array2string(a, **kw)


def array_repr(a, **kw) -> str:
    a = asarray(a)
    o = np.get_printoptions()
    text = "array(" + array2string(a, separator=", ", prefix="array(", suffix=")", **kw)
    extras = []
    if a.size > o["threshold"]:
        extras.append(f"shape={a.shape}")
    if a.dtype.name not in ("float64", "int64", "bool", "complex128"):
        extras.append(f"dtype={a.dtype.name}")
    if not extras:
        return text + ")"
    text, more = text + ",", ", ".join(extras) + ")"
    last = len(text) - (text.rfind("\n") + 1)
    return text + (" " if last + len(more) + 1 <= o["linewidth"] else "\n" + " " * len("array(")) + more


format_float_positional = np.format_float_positional
format_float_scientific = np.format_float_scientific
base_repr = np.base_repr
binary_repr = np.binary_repr
set_printoptions = np.set_printoptions
get_printoptions = np.get_printoptions


@contextlib.contextmanager
def printoptions(**kw):
    with np.printoptions(**kw) as o:
        yield o
