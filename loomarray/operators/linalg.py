"""Linear algebra: contractions are joins and sums; factorisations go to NumPy, a matrix of a stack at a time, or
blocks of rows of one tall matrix (`tall`)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, axes_of, coords, elementwise, mapped, ravel, size_of
from loomarray.functions import elementwise as ew
from loomarray.operators import reductions as red
from loomarray.operators import tall
from loomarray.operators.dense import blocks
from loomarray.operators.shape import broadcast_to, expand_dims, matrix_transpose, moveaxis, permute_dims, swapaxes, transpose  # noqa: F401


def einsum_path(subscripts: str, *operands, optimize="greedy"):
    """NumPy's contraction order, from shapes alone."""
    return np.einsum_path(subscripts, *(np.broadcast_to(np.empty((), a.dtype), a.shape) for a in map(asarray, operands)), optimize=optimize)


def _parse(subscripts: str, arrays: list[Array]) -> tuple[list[str], str]:
    subscripts = subscripts.replace(" ", "")
    left, _, right = subscripts.partition("->")
    terms = left.split(",")
    if len(terms) != len(arrays):
        raise ValueError("more operands provided to einstein sum than specified in the subscripts")
    free = [c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in subscripts]
    most = max((a.ndim - len(t.replace("...", "")) for t, a in zip(terms, arrays, strict=True) if "..." in t), default=0)
    dots = "".join(free[:most])
    full = []
    for t, a in zip(terms, arrays, strict=True):
        if "..." in t:
            n = a.ndim - len(t.replace("...", ""))
            t = t.replace("...", dots[most - n :])
        if len(t) != a.ndim:
            raise ValueError("einstein sum subscripts string does not match the operand's dimensions")
        full.append(t)
    if "->" not in subscripts:
        names = "".join(full)
        right = dots + "".join(sorted(c for c in set(names) if names.count(c) == 1 and c not in dots))
    else:
        right = right.replace("...", dots)
    return full, right


def einsum(subscripts: str, *operands) -> Array:
    """Sums of products over repeated labels.

    Three operands or more meet two at a time, in the order that costs least by their shapes
    (`contraction_order`); labels that neither the result nor an operand still to come needs are summed
    away at once.  Two of which each sums over the labels they share go as a product of matrices, by dense
    blocks if it is large; others join on the labels they share.
    """
    arrays = [asarray(a) for a in operands]
    terms, out = _parse(subscripts, arrays)
    sizes: dict[str, int] = {}
    for t, a in zip(terms, arrays, strict=True):
        for c, n in zip(t, a.shape, strict=True):
            if sizes.setdefault(c, n) != n and 1 not in (sizes[c], n):
                raise ValueError(f"operands could not be broadcast together for label {c}")
            sizes[c] = max(sizes[c], n)
    d = np.result_type(*(a.dtype for a in arrays))
    stretched_ = any(a.shape[t.index(c)] != sizes[c] for t, a in zip(terms, arrays, strict=True) for c in t)
    if stretched_:
        return _cellwise(terms, out, arrays, sizes)
    arrays = [a.astype(d) for a in arrays]
    for pair in contraction_order(terms, out, sizes):
        some = [(terms[i], arrays[i]) for i in pair]
        terms, arrays = ([x for i, x in enumerate(xs) if i not in pair] for xs in (terms, arrays))
        later = set("".join(terms)) | set(out)
        keep = "".join(dict.fromkeys(c for t, _ in some for c in t if c in later)) if terms else out
        made = _as_product(*some[0], *some[1], keep, sizes) if len(some) == 2 else None
        arrays.append(made if made is not None else _cellwise([t for t, _ in some], keep, [a for _, a in some], sizes))
        terms.append(keep)
    return arrays[0]


def contraction_order(terms: list[str], out: str, sizes: dict[str, int]) -> list[tuple[int, ...]]:
    """Which operands meet, step by step; what they make is put at the end.  The search is NumPy's, on the shapes alone."""
    if len(terms) < 3:
        return [tuple(range(len(terms)))]
    shapes = [np.broadcast_to(0.0, [sizes[c] for c in t]) for t in terms]
    path, _ = np.einsum_path(f"{','.join(terms)}->{out}", *shapes, optimize="optimal" if len(terms) < 7 else "greedy")
    return [tuple(sorted(p)) for p in path[1:]]


def _as_product(s: str, a: Array, t: str, b: Array, out: str, sizes: dict[str, int]) -> Array | None:
    """Two operands as matrices, if every label is either summed over in both or in the result and one of them, and the product is large."""
    from loomarray.operators.blockwise import product
    from loomarray.operators.shape import transpose

    shared = [c for c in s if c in t]
    left, right = ([c for c in x if c not in shared] for x in (s, t))
    plain = len(set(s)) == len(s) and len(set(t)) == len(t) and not set(shared) & set(out) and set(left) | set(right) == set(out)
    n, m, k = (math.prod(sizes[c] for c in x) for x in (left, shared, right))
    if not plain or not shared or n * m * k < BY_BLOCKS or a.dtype == np.float16 or a.dtype.kind == "b":
        return None
    x = transpose(a, [s.index(c) for c in [*left, *shared]]).reshaped((n, m))
    y = transpose(b, [t.index(c) for c in [*shared, *right]]).reshaped((m, k))
    made = product(x, y).reshaped(tuple(sizes[c] for c in [*left, *right]))
    return transpose(made, [[*left, *right].index(c) for c in out]) if made.ndim else made


def _cellwise(terms: list[str], out: str, arrays: list[Array], sizes: dict[str, int]) -> Array:
    """Operands join one after the other on the labels they share, cell by cell."""
    d = np.result_type(*(a.dtype for a in arrays))
    column = lambda c: f"x{ord(c)}"
    done, labels = None, ""
    for k, (t, a) in enumerate(zip(terms, arrays, strict=True)):
        a = a.astype(d)
        cs = coords(F.col(I), a.shape)
        test = F.lit(True)
        seen: dict[str, int] = {}
        for j, c in enumerate(t):  # a label twice is a diagonal
            if c in seen:
                test = test & (cs[j] == cs[seen[c]])
            seen.setdefault(c, j)
        own = a.df.where(test) if len(seen) < len(t) else a.df
        thin = [c for c in seen if a.shape[seen[c]] == 1 and sizes[c] > 1]
        df = own.select(*(cs[j].alias(column(c)) for c, j in seen.items() if c not in thin), F.col(V).alias("w"))
        for c in thin:
            df = df.withColumn(column(c), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sizes[c] - 1).cast("long"))))
        if done is None:
            done, labels = df.withColumnRenamed("w", V), "".join(seen)
        else:
            shared = [column(c) for c in seen if c in labels]
            both = done.join(df, shared) if shared else done.crossJoin(df)  # no shared label: an outer product is asked for
            labels += "".join(c for c in seen if c not in labels)
            done = both.select(*(column(c) for c in labels), ew.multiply(d, F.col(V), F.col("w")).alias(V))
        later = set("".join(terms[k + 1 :])) | set(out)
        keep = [c for c in labels if c in later]
        if len(keep) < len(labels) or (k == len(terms) - 1 and not keep):
            total = F.bool_or(V) if d.kind == "b" else red._sum(d, F.col(V))
            done = done.groupBy(*(column(c) for c in keep)).agg(total.alias(V)) if keep else done.agg(total.alias(V))
            labels = "".join(keep)
    shape = [sizes[c] for c in out]
    return Array.of(done.select(ravel([F.col(column(c)) for c in out], shape).alias(I), V), shape, d)


#: Products of cells beyond which a product of matrices goes by dense blocks.
BY_BLOCKS = 1 << 21


def _product(a: Array, b: Array) -> Array:
    """A product of two matrices: by blocks if it is large, else by a join of cells."""
    d = np.result_type(a.dtype, b.dtype)
    if a.shape[0] * a.shape[1] * b.shape[1] < BY_BLOCKS or d == np.float16 or d.kind == "b":
        return einsum("ij,jk->ik", a, b)
    from loomarray.operators.blockwise import product

    return product(a.astype(d), b.astype(d))


def matmul(a, b) -> Array:
    a, b = asarray(a), asarray(b)
    if not a.ndim or not b.ndim:
        raise ValueError("matmul: an operand does not have enough dimensions")
    if a.ndim == 1 and b.ndim == 1:
        return einsum("i,i->", a, b)
    if a.ndim == 1:
        return einsum("i,...ij->...j", a, b)
    if b.ndim == 1:
        return einsum("...ij,j->...i", a, b)
    if a.shape[-1] != b.shape[-2]:
        raise ValueError("matmul: mismatch in the core dimension")
    if a.ndim == 2 and b.ndim == 2:
        return _product(a, b)
    return einsum("...ij,...jk->...ik", a, b)


def dot(a, b) -> Array:
    a, b = asarray(a), asarray(b)
    if not a.ndim or not b.ndim:
        return elementwise("multiply", a, b)
    return tensordot(a, b, ([-1], [max(0, b.ndim - 2)]))


def inner(a, b) -> Array:
    a, b = asarray(a), asarray(b)
    return elementwise("multiply", a, b) if not a.ndim or not b.ndim else tensordot(a, b, ([-1], [-1]))


def outer(a, b) -> Array:
    a, b = asarray(a), asarray(b)
    return elementwise("multiply", a.reshaped((a.size, 1)), b.reshaped((1, b.size)))


def vdot(a, b) -> Array:
    a, b = asarray(a), asarray(b)
    return einsum("i,i->", elementwise("conjugate", a.reshaped((a.size,))), b.reshaped((b.size,)))


def vecdot(a, b, axis: int = -1) -> Array:
    a, b = asarray(a), asarray(b)
    return red.sum(elementwise("multiply", elementwise("conjugate", a), b), axis=axis)


def matvec(a, x) -> Array:
    return einsum("...ij,...j->...i", a, x)


def vecmat(x, a) -> Array:
    return einsum("...i,...ij->...j", elementwise("conjugate", x), a)


def tensordot(a, b, axes=2) -> Array:
    a, b = asarray(a), asarray(b)
    if np.isscalar(axes):
        left, right = list(range(a.ndim - axes, a.ndim)), list(range(axes))
    else:
        left, right = (axes_of(x, n) for x, n in zip(axes, (a.ndim, b.ndim), strict=True))
    free_a, free_b = ([k for k in range(v.ndim) if k not in own] for v, own in ((a, left), (b, right)))
    if left and free_a and free_b and [a.shape[k] for k in left] == [b.shape[k] for k in right]:  # as a product of matrices
        inner_ = size_of([a.shape[k] for k in left])
        outer_a, outer_b = ([v.shape[k] for k in free] for v, free in ((a, free_a), (b, free_b)))
        x = transpose(a, [*free_a, *left]).reshaped((size_of(outer_a), inner_))
        y = transpose(b, [*right, *free_b]).reshaped((inner_, size_of(outer_b)))
        return _product(x, y).reshaped((*outer_a, *outer_b))
    names = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    x, y = list(names[: a.ndim]), list(names[a.ndim : a.ndim + b.ndim])
    for p, q in zip(left, right, strict=True):
        y[q] = x[p]
    out = [c for k, c in enumerate(x) if k not in left] + [c for k, c in enumerate(y) if k not in right]
    return einsum(f"{''.join(x)},{''.join(y)}->{''.join(out)}", a, b)


def kron(a, b) -> Array:
    a, b = asarray(a), asarray(b)
    n = max(a.ndim, b.ndim)
    s, t = (1,) * (n - a.ndim) + a.shape, (1,) * (n - b.ndim) + b.shape
    wide = elementwise("multiply", a.reshaped([x for d in s for x in (d, 1)]), b.reshaped([x for d in t for x in (1, d)]))
    return wide.reshaped([p * q for p, q in zip(s, t, strict=True)])


def cross(a, b, axis: int = -1) -> Array:
    """Vector product of lines of two or three."""
    from loomarray.operators.shape import stack, unstack

    a, b = asarray(a), asarray(b)
    x, y = unstack(moveaxis(a, axis, -1), -1), unstack(moveaxis(b, axis, -1), -1)
    mul, sub = (lambda p, q: elementwise("multiply", p, q)), (lambda p, q: elementwise("subtract", p, q))
    if len(x) == 2 and len(y) == 2:
        return sub(mul(x[0], y[1]), mul(x[1], y[0]))
    zero = lambda v: elementwise("multiply", v[0], 0)
    x, y = (v if len(v) == 3 else [*v, zero(v)] for v in (x, y))
    return moveaxis(stack([sub(mul(x[(k + 1) % 3], y[(k + 2) % 3]), mul(x[(k + 2) % 3], y[(k + 1) % 3])) for k in range(3)], -1), -1, axis)


def diagonal(a, offset: int = 0, axis1: int = 0, axis2: int = 1) -> Array:
    a = asarray(a)
    p, q = axes_of([axis1, axis2], a.ndim)
    n = max(0, min(a.shape[p] - max(0, -offset), a.shape[q] - max(0, offset)))
    rest = [k for k in range(a.ndim) if k not in (p, q)]
    shape = [a.shape[k] for k in rest] + [n]
    cs = coords(F.col(I), a.shape)
    df = a.df.where(cs[q] - cs[p] == offset)
    return Array.of(df.select(ravel([*(cs[k] for k in rest), F.least(cs[p], cs[q])], shape).alias(I), V), shape, a.dtype)


def trace(a, offset: int = 0, axis1: int = 0, axis2: int = 1) -> Array:
    return red.sum(diagonal(a, offset, axis1, axis2), axis=-1)


# ---- dense
def _float(a) -> Array:
    a = asarray(a)
    return a if a.dtype.kind in "fc" and a.dtype != np.float16 else a.astype(np.float64)


def _square(a: Array) -> int:
    if a.ndim < 2 or a.shape[-1] != a.shape[-2]:
        raise np.linalg.LinAlgError("Last 2 dimensions of the array must be square")
    return a.shape[-1]


def _matrices(a, f, *outs):
    """`f` on every matrix of a stack."""
    a = _float(a)
    got = blocks(a, [a.ndim - 2, a.ndim - 1], f, [(s, t if t is not None else a.dtype) for s, t in outs])
    return got[0] if len(got) == 1 else tuple(got)


def det(a) -> Array:
    a = _float(a)
    _square(a)
    return _matrices(a, np.linalg.det, ((), None))


def slogdet(a):
    a = _float(a)
    _square(a)
    return _matrices(a, lambda m: tuple(np.linalg.slogdet(m)), ((), None), ((), dt.part(a.dtype)))


def inv(a) -> Array:
    a = _float(a)
    n = _square(a)
    return _matrices(a, np.linalg.inv, ((n, n), None))


def pinv(a, rcond: float = 1e-15) -> Array:
    a = _float(a)
    m, n = a.shape[-2:]
    if tall.fits(a):
        return transpose(tall.pinv_transposed(a, rcond))
    if tall.fits(across := _across(a)):
        return tall.pinv_transposed(across, rcond)
    return _matrices(a, lambda x: np.linalg.pinv(x, rcond), ((n, m), None))


def _across(a: Array) -> Array:
    """A matrix with its axes swapped, for what a wide one shares with a tall one; stacks as they are."""
    return transpose(a) if a.ndim == 2 else a


def _triangle(a: Array) -> Array | None:
    """The tall one of a matrix and its transpose, if there is one that goes by blocks of rows."""
    return next((x for x in (a, _across(a)) if tall.fits(x)), None)


def _together(a: Array, b: Array):
    """Matrices of two stacks side by side, as one stack, and how many columns are the first's."""
    from loomarray.operators.shape import concatenate

    d = np.result_type(a.dtype, b.dtype)
    lead = np.broadcast_shapes(a.shape[:-2], b.shape[:-2])
    x, y = (broadcast_to(v.astype(d), (*lead, *v.shape[-2:])) for v in (a, b))
    return concatenate([x, y], -1), a.shape[-1]


def solve(a, b) -> Array:
    a, b = _float(a), _float(b)
    n = _square(a)
    vector = b.ndim == 1
    both, k = _together(a, b.reshaped((b.size, 1)) if vector else b)
    m = both.shape[-1] - k
    out = _matrices(both, lambda x: np.linalg.solve(x[:, :k], x[:, k:]), ((n, m), None))
    return out.reshaped(out.shape[:-1]) if vector else out


def lstsq(a, b, rcond=None):
    """Least squares: (solution, residuals, rank, singular values)."""
    a, b = _float(a), _float(b)
    vector = b.ndim == 1
    both, k = _together(a, b.reshaped((b.size, 1)) if vector else b)
    m, p = both.shape[-2], both.shape[-1] - k
    full = m > k
    if tall.fits(both):
        most = np.finfo(both.dtype).eps * max(m, k) if rcond is None else rcond
        return _least(tall.lstsq(both, k, most), full, k, vector)

    def f(x):
        s, r, rank, sv = np.linalg.lstsq(x[:, :k], x[:, k:], rcond)
        return s, r if len(r) else np.full(p, np.nan), np.array(rank), sv

    outs = _matrices(both, f, ((k, p), None), ((p,), dt.part(both.dtype)), ((), np.dtype("int64")), ((min(m, k),), dt.part(both.dtype)))
    return _least(outs, full, k, vector)


def _least(found, full: bool, k: int, vector: bool):
    """Results of `lstsq` in NumPy's form: without full rank there are no residuals."""
    s, r, rank, sv = found
    rank_ = int(rank.item())
    if not full or rank_ < k:
        r = asarray(np.empty(0))
    return (s.reshaped((k,)) if vector else s), r, rank_, sv


def qr(a, mode: str = "reduced"):
    a = _float(a)
    m, n = a.shape[-2:]
    if mode != "complete" and tall.fits(a):
        return tall.qr(a, mode)
    k = m if mode == "complete" else min(m, n)
    if mode == "r":
        return _matrices(a, lambda x: np.linalg.qr(x, "r"), ((min(m, n), n), None))
    return _matrices(a, lambda x: tuple(np.linalg.qr(x, mode)), ((m, k), None), ((k, n), None))


def cholesky(a, upper: bool = False) -> Array:
    a = _float(a)
    n = _square(a)
    return _matrices(a, lambda x: np.linalg.cholesky(x, upper=upper), ((n, n), None))


def svd(a, full_matrices: bool = True, compute_uv: bool = True):
    a = _float(a)
    m, n = a.shape[-2:]
    k = min(m, n)
    if not compute_uv:
        return svdvals(a)
    if not full_matrices and tall.fits(a):
        return tall.svd(a)
    if not full_matrices and tall.fits(across := _across(a)):
        u, s, v = tall.svd(across)
        return transpose(v), s, transpose(u)
    u, v = (m, n) if full_matrices else (k, k)
    return _matrices(a, lambda x: tuple(np.linalg.svd(x, full_matrices)), ((m, u), None), ((k,), dt.part(a.dtype)), ((v, n), None))


def svdvals(a) -> Array:
    a = _float(a)
    if (x := _triangle(a)) is not None:
        return tall.of_triangle(x, lambda r: np.linalg.svd(r, compute_uv=False), (x.shape[1],))
    return _matrices(a, lambda x: np.linalg.svd(x, compute_uv=False), ((min(a.shape[-2:]),), dt.part(a.dtype)))


def _real_if_all(x: Array, exact: bool) -> Array:
    if exact or not red.all(elementwise("equal", elementwise("imag", x), 0.0)).item():
        return x
    return elementwise("real", x)


def eig(a):
    """Eigenvalues and vectors; real ones where every imaginary part is 0."""
    a = _float(a)
    n = _square(a)
    c = np.result_type(a.dtype, np.complex64)
    w, v = _matrices(a, lambda x: tuple(np.linalg.eig(x)), ((n,), c), ((n, n), c))
    if a.dtype.kind == "c":
        return w, v
    real = red.all(elementwise("equal", elementwise("imag", w), 0.0)).item()
    return (elementwise("real", w), elementwise("real", v)) if real else (w, v)


def eigvals(a) -> Array:
    a = _float(a)
    n = _square(a)
    w = _matrices(a, np.linalg.eigvals, ((n,), np.result_type(a.dtype, np.complex64)))
    return _real_if_all(w, a.dtype.kind == "c")


def eigh(a, UPLO: str = "L"):  # noqa: N803
    a = _float(a)
    n = _square(a)
    return _matrices(a, lambda x: tuple(np.linalg.eigh(x, UPLO)), ((n,), dt.part(a.dtype)), ((n, n), None))


def eigvalsh(a, UPLO: str = "L") -> Array:  # noqa: N803
    a = _float(a)
    n = _square(a)
    return _matrices(a, lambda x: np.linalg.eigvalsh(x, UPLO), ((n,), dt.part(a.dtype)))


def cond(a, p=None) -> Array:
    a = _float(a)
    if p in (None, 2, -2) and (x := _triangle(a)) is not None:
        return tall.of_triangle(x, lambda r: np.linalg.cond(r, p), ())
    return _matrices(a, lambda x: np.linalg.cond(x, p), ((), dt.part(a.dtype)))


def matrix_rank(a, tol=None) -> Array:
    a = _float(a)
    if a.ndim < 2:
        return red.any(a).astype(np.int64)
    if (x := _triangle(a)) is not None:
        small = np.finfo(x.dtype).eps * max(x.shape)

        def rank(r):
            s = np.linalg.svd(r, compute_uv=False)
            return np.array(float((s > (s[0] * small if tol is None else tol)).sum()))

        return tall.of_triangle(x, rank, (), np.int64)
    return _matrices(a, lambda x: np.linalg.matrix_rank(x, tol), ((), np.dtype("int64")))


def matrix_power(a, n: int) -> Array:
    """By squares."""
    a = asarray(a)
    size = _square(a)
    if n < 0:
        a, n = inv(a), -n
    from loomarray.operators.creation import eye

    out = None
    while n:
        if n & 1:
            out = a if out is None else matmul(out, a)
        n >>= 1
        if n:
            a = matmul(a, a).cached()
    return broadcast_to(eye(size, dtype=a.dtype), a.shape) if out is None else out


def multi_dot(arrays) -> Array:
    """Products in the order that costs least."""
    arrays = [asarray(a) for a in arrays]
    if len(arrays) < 2:
        raise ValueError("Expecting at least two arrays.")
    first, last = arrays[0].ndim == 1, arrays[-1].ndim == 1
    if first:
        arrays[0] = arrays[0].reshaped((1, arrays[0].size))
    if last:
        arrays[-1] = arrays[-1].reshaped((arrays[-1].size, 1))
    p = [a.shape[0] for a in arrays] + [arrays[-1].shape[1]]
    n = len(arrays)
    best = {(i, i): (0, None) for i in range(n)}
    for length in range(1, n):
        for i in range(n - length):
            j = i + length
            best[i, j] = min((best[i, k][0] + best[k + 1, j][0] + p[i] * p[k + 1] * p[j + 1], k) for k in range(i, j))

    def build(i, j):
        if i == j:
            return arrays[i]
        k = best[i, j][1]
        return matmul(build(i, k), build(k + 1, j))

    out = build(0, n - 1)
    return out.reshaped([d for k, d in enumerate(out.shape) if not (k == 0 and first) and not (k == 1 and last)])


def tensorinv(a, ind: int = 2) -> Array:
    a = _float(a)
    m = size_of(a.shape[:ind])
    return inv(a.reshaped((m, m))).reshaped((*a.shape[ind:], *a.shape[:ind]))


def tensorsolve(a, b, axes=None) -> Array:
    a, b = _float(a), _float(b)
    if axes is not None:
        keep = [k for k in range(a.ndim) if k not in axes_of(axes, a.ndim)]
        a = transpose(a, keep + axes_of(axes, a.ndim))
    shape = a.shape[b.ndim :]
    n = size_of(shape)
    return solve(a.reshaped((n, n)), b.reshaped((b.size,))).reshaped(shape)


def norm(a, ord=None, axis=None, keepdims: bool = False) -> Array:  # noqa: A002
    a = _float(a)
    if axis is None and ord is None:
        out = vector_norm(a.reshaped((a.size,)))
        return out.reshaped((1,) * a.ndim) if keepdims else out
    axes = axes_of(axis, a.ndim)
    if len(axes) == 1:
        return vector_norm(a, axes[0], keepdims, 2 if ord is None else ord)
    return matrix_norm(a, keepdims, "fro" if ord is None else ord, axes)


def vector_norm(a, axis=None, keepdims: bool = False, ord=2) -> Array:  # noqa: A002
    a = _float(a)
    x = elementwise("absolute", a)
    if ord == math.inf:
        return red.max(x, axis, keepdims)
    if ord == -math.inf:
        return red.min(x, axis, keepdims)
    if ord == 0:
        return red.count_nonzero(x, axis, keepdims).astype(x.dtype)
    if ord == 1:
        return red.sum(x, axis, keepdims)
    if ord == 2:
        return elementwise("sqrt", red.sum(elementwise("square", x), axis, keepdims))
    return elementwise("power", red.sum(elementwise("power", x, float(ord)), axis, keepdims), 1.0 / ord)


def matrix_norm(a, keepdims: bool = False, ord="fro", axes=(-2, -1)) -> Array:  # noqa: A002
    a = _float(a)
    p, q = axes_of(axes, a.ndim)
    if ord == "fro":
        x = elementwise("square", elementwise("absolute", a))
        return elementwise("sqrt", red.sum(x, (p, q), keepdims))
    if ord in (1, -1, math.inf, -math.inf):
        x = elementwise("absolute", a)
        by, over = (p, q) if abs(ord) == 1 else (q, p)
        lines = red.sum(x, by, keepdims=True)
        out = (red.max if ord > 0 else red.min)(lines, over, keepdims=True)
    else:
        s = svdvals(moveaxis(a, (p, q), (-2, -1)))
        out = {2: lambda: red.max(s, -1), -2: lambda: red.min(s, -1), "nuc": lambda: red.sum(s, -1)}[ord]()
        out = expand_dims(out, sorted((p, q)))
    return out if keepdims else out.reshaped([d for k, d in enumerate(out.shape) if k not in (p, q)])


del mapped
