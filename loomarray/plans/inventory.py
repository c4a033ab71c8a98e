"""More queries with SQL twins: factorisations by what they satisfy, N-d transforms, polynomials, random draws by
their moments, files, text forms, and questions about types and arrays.

A factorisation is not unique, so its query shows a product that SQL can write down: A inv(A), Q R, L L', U S V'.
A question's answer, a text or a scalar is a row with its number (i) and the answer (v).
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

import loomarray as la
from loomarray.cells import I, V, Array, byteswap, from_column, from_columns, mapped, view
from loomarray.operators import tall
from loomarray.plans.queries import CELLS, QUERIES, SQL, WIDTH, _K, _POS, _by_column, _by_row, _cells, _holes, _whole, made, matrix, of_column, of_columns, of_matrix, shared_folder, shown, sql_neat

LA = la.linalg


# ---- linear algebra
def gram(a: Array) -> Array:
    return la.matmul(la.transpose(a), a)


def eights(a: Array) -> Array:
    """Each vector as a matrix of 8 x 8."""
    return la.reshape(a, (-1, 8, 8))


def twos(a: Array) -> Array:
    """Of each vector the first four as a matrix of 2 x 2."""
    return la.reshape(a[:, :4], (-1, 2, 2))


def t(a: Array) -> Array:
    return la.matrix_transpose(a)


def scaled(u: Array, s: Array) -> Array:
    return u * la.expand_dims(s, -2)


def rebuilt(a: Array) -> Array:
    u, s, v = LA.svd(eights(a), full_matrices=False)
    return la.matmul(scaled(u, s), v)


def spectral(a: Array) -> Array:
    w, v = LA.eigh(gram(a))
    return la.matmul(scaled(v, w), la.transpose(v))


def eigen_rest(a: Array) -> Array:
    """A V - V W, which is 0, of a symmetric matrix."""
    g = gram(a) / 1000.0
    w, v = LA.eig(g)
    return la.absolute(la.matmul(g, v) - scaled(v, w))


def rest_of_fit(a: Array) -> Array:
    """A' (A x - b), which is 0 where x fits best."""
    m, b = a[:, :4], a[:, 4]
    x = LA.lstsq(m, b)[0]
    return la.matmul(la.transpose(m), la.matmul(m, x) - b)


def cube(a: Array) -> Array:
    return la.reshape(gram(a), (8, 8, WIDTH))


IDENTITY = f"SELECT k::BIGINT AS i, ((k // {WIDTH} = k % {WIDTH})::INT)::DOUBLE AS v {_K.format(WIDTH * WIDTH)}"
GRAM = f"SELECT (x.c * {WIDTH} + y.c)::BIGINT AS i, {sql_neat('sum(x.v * y.v)')} AS v FROM m x JOIN m y ON x.r = y.r GROUP BY x.c, y.c"
ZEROS = "SELECT k::BIGINT AS i, 0.0::DOUBLE AS v " + _K
ONES = "SELECT k::BIGINT AS i, 1.0::DOUBLE AS v " + _K
DET = "(max(v) FILTER (c = 0) * max(v) FILTER (c = 3) - max(v) FILTER (c = 1) * max(v) FILTER (c = 2))"
FRO = "(sum(v * v) FILTER (c < 4))"
for _name, _f, _sql in [
    ("inv", lambda a: la.matmul(gram(a), LA.inv(gram(a))), IDENTITY),
    ("solve", lambda a: la.matmul(gram(a), LA.solve(gram(a), np.ones(WIDTH))), ONES.format(WIDTH)),
    ("lstsq", rest_of_fit, ZEROS.format(4)),
    ("qr", lambda a: la.matmul(*LA.qr(eights(a))), _cells("i")),
    ("qr_tall", lambda a: la.matmul(*LA.qr(a)), _cells("i")),
    ("cholesky", lambda a: la.matmul(LA.cholesky(gram(a)), la.transpose(LA.cholesky(gram(a)))), GRAM),
    ("svd", rebuilt, _cells("i")),
    ("svdvals", lambda a: la.sum(la.square(LA.svdvals(eights(a))), axis=-1), _by_row("sum(v * v)")),
    ("eigh", spectral, GRAM),
    ("eig", eigen_rest, ZEROS.format(WIDTH * WIDTH)),
    ("eigvals", lambda a: la.sum(la.real(LA.eigvals(eights(a))), axis=-1), _by_row("sum(v) FILTER (c % 9 = 0)")),
    ("eigvalsh", lambda a: la.sum(LA.eigvalsh(gram(a))), _whole("sum(v * v)")),
    ("cond", lambda a: 1.0 / LA.cond(twos(a)), _by_row(f"2 * abs({DET}) / ({FRO} + sqrt(greatest({FRO} * {FRO} - 4 * {DET} * {DET}, 0)))")),
    ("matrix_rank", lambda a: LA.matrix_rank(eights(a)), _by_row("8", "i")),
    ("matrix_power", lambda a: LA.matrix_power(twos(a), 2), f"SELECT (x.r * 4 + x.c // 2 * 2 + y.c % 2)::BIGINT AS i, {sql_neat('sum(x.v * y.v)')} AS v FROM m x JOIN m y ON x.r = y.r AND x.c % 2 = y.c // 2 AND x.c < 4 AND y.c < 4 GROUP BY x.r, x.c // 2, y.c % 2"),
    ("pinv", lambda a: la.matmul(la.matmul(eights(a), LA.pinv(eights(a))), eights(a)), _cells("i")),
    ("pinv_tall", lambda a: la.matmul(LA.pinv(a), a), IDENTITY),
    ("slogdet", lambda a: LA.slogdet(twos(a))[1], _by_row(f"ln(abs({DET}))")),
    ("slogdet_sign", lambda a: LA.slogdet(twos(a))[0], _by_row(f"sign({DET})")),
    ("multi_dot", lambda a: LA.multi_dot([la.transpose(a), a, np.ones(WIDTH)]), f"SELECT c::BIGINT AS i, {sql_neat('sum(v * s)')} AS v FROM (SELECT c, v, sum(v) OVER (PARTITION BY r) AS s FROM m) GROUP BY c"),
    ("tensorinv", lambda a: la.tensordot(LA.tensorinv(cube(a), 2), cube(a), 2), IDENTITY),
    ("tensorsolve", lambda a: la.tensordot(cube(a), LA.tensorsolve(cube(a), np.ones((8, 8))), 1), ONES.format(WIDTH)),
    ("vector_norm", lambda a: LA.vector_norm(a, axis=1), _by_row("sqrt(sum(v * v))")),
    ("norm_nuclear", lambda a: LA.norm(twos(a), "nuc", axis=(1, 2)), _by_row(f"sqrt({FRO} + 2 * abs({DET}))")),
    ("linalg_diagonal", lambda a: LA.diagonal(a, 1), _cells("r", where="c = r + 1")),
    ("linalg_transpose", lambda a: LA.transpose(a), _cells("c * n + r")),
    ("linalg_matrix_transpose", lambda a: LA.matrix_transpose(a), _cells("c * n + r")),
    ("linalg_permute_dims", lambda a: LA.permute_dims(a, (1, 0)), _cells("c * n + r")),
    ("matmul_columns", lambda a: la.matmul(a, np.eye(WIDTH)[:, ::-1].copy()), _cells(f"r * {WIDTH} + {WIDTH - 1} - c")),
]:
    of_matrix(f"linalg_{_name.removeprefix('linalg_')}" if not _name.startswith("linalg_") else f"linalg_of_{_name.removeprefix('linalg_')}", _f, _sql)


# ---- one tall matrix, by blocks of rows whatever its size: a constant, quantities and prices of line items
def tall_columns(spark, sf_dir: str) -> Array:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q, p = from_columns(df, ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"])
    q, p = q.astype(np.float64), p.astype(np.float64)
    return la.stack([q * 0.0 + 1.0, q / 10.0, p / 10000.0], axis=1)


def tall_fit(a: Array) -> Array:
    """Intercept and slope of prices by quantities."""
    return tall.lstsq(a, 2, 1e-12)[0]


def tall_gram(a: Array) -> Array:
    return gram(tall.qr(a, "r")) / float(a.shape[0])


def tall_orthogonal(a: Array) -> Array:
    return gram(tall.qr(a)[0])


_TALL = "WITH t AS (SELECT 1.0::DOUBLE AS c0, l_quantity::DOUBLE / 10 AS c1, l_extendedprice::DOUBLE / 10000 AS c2 FROM lineitem) "
_THREE = "SELECT k::BIGINT AS i, ((k // 3 = k % 3)::INT)::DOUBLE AS v FROM (SELECT unnest(range(9)) AS k)"
for _name, _f, _sql in [
    ("lstsq", tall_fit, f"SELECT 0::BIGINT AS i, {sql_neat('regr_intercept(c2, c1)')} AS v FROM t UNION ALL SELECT 1::BIGINT, {sql_neat('regr_slope(c2, c1)')} FROM t"),
    ("qr_r", tall_gram, " UNION ALL ".join(f"SELECT {3 * j + k}::BIGINT AS i, {sql_neat(f'avg(c{j} * c{k})')} AS v FROM t" for j in range(3) for k in range(3))),
    ("qr", tall_orthogonal, _THREE),
    ("pinv", lambda a: la.matmul(la.transpose(tall.pinv_transposed(a, 1e-15)), a), _THREE),
    ("svdvals", lambda a: la.sum(la.square(tall.of_triangle(a, lambda r: np.linalg.svd(r, compute_uv=False), (3,)))) / float(a.shape[0]), f"SELECT 0::BIGINT AS i, {sql_neat('avg(c0 * c0 + c1 * c1 + c2 * c2)')} AS v FROM t"),
]:
    QUERIES[f"linalg_tall_{_name}"] = lambda spark, sf_dir, f=_f, shown=shown: shown(f(tall_columns(spark, sf_dir)))
    SQL[f"linalg_tall_{_name}"] = _TALL + _sql


# ---- transforms
_DFT = "SELECT r, k, sum(v * cos(2 * pi() * k * c / 64)) AS re, -sum(v * sin(2 * pi() * k * c / 64)) AS im FROM m, (SELECT unnest(range({0})) AS k) GROUP BY r, k"
_FOUR = "SELECT r, k, l, sum(v * cos(2 * pi() * (k * (c // 8) + l * (c % 8)) / 8)) AS re, -sum(v * sin(2 * pi() * (k * (c // 8) + l * (c % 8)) / 8)) AS im FROM m, (SELECT unnest(range(8)) AS k), (SELECT unnest(range({0})) AS l) GROUP BY r, k, l"


def _pairs(index: str, scale: str = "", sign: str = "", source: str = "") -> str:
    return f"SELECT ({index})::BIGINT AS i, {sql_neat('re' + scale)} AS re, {sql_neat(sign + 'im' + scale)} AS im FROM ({source})"


#: sum over the 64 coefficients that a real line's 33 stand for
_HFFT = "SELECT r * 126 + k AS i, " + sql_neat("max(v) FILTER (c = 0) + sum(2 * v * cos(2 * pi() * k * c / 126)) FILTER (c BETWEEN 1 AND 62) + max(v * cos(pi() * k)) FILTER (c = 63)") + " AS v FROM m, (SELECT unnest(range(126)) AS k) GROUP BY r, k"
for _name, _f, _sql in [
    ("fftn", lambda a: la.fft.fftn(eights(a), axes=(1, 2)), _pairs("r * 64 + k * 8 + l", source=_FOUR.format(8))),
    ("ifftn", lambda a: la.fft.ifftn(eights(a), axes=(1, 2)), _pairs("r * 64 + k * 8 + l", " / 64", "-", _FOUR.format(8))),
    ("fft2_values", lambda a: la.fft.fft2(eights(a)), _pairs("r * 64 + k * 8 + l", source=_FOUR.format(8))),
    ("ifft2", lambda a: la.fft.ifft2(eights(a)), _pairs("r * 64 + k * 8 + l", " / 64", "-", _FOUR.format(8))),
    ("rfft2", lambda a: la.fft.rfft2(eights(a)), _pairs("r * 40 + k * 5 + l", source=_FOUR.format(5))),
    ("rfftn", lambda a: la.fft.rfftn(eights(a), axes=(1, 2)), _pairs("r * 40 + k * 5 + l", source=_FOUR.format(5))),
    ("irfft2", lambda a: la.fft.irfft2(la.fft.rfft2(eights(a))), _cells("i")),
    ("irfftn", lambda a: la.fft.irfftn(la.fft.rfftn(eights(a), axes=(1, 2)), axes=(1, 2)), _cells("i")),
    ("hfft", la.fft.hfft, _HFFT),
    ("ihfft", la.fft.ihfft, _pairs("r * 33 + k", " / 64", "-", _DFT.format(33))),
]:
    of_matrix(f"fft_{_name}", _f, _sql)

# ---- along lines
_STEP = "v * 3 - lag(v * 3) OVER (PARTITION BY r ORDER BY c)"
_TURN = f"SELECT i, r, c, v * 3 AS v, d, d - 2 * pi() * floor((d + pi()) / (2 * pi())) AS w FROM (SELECT *, coalesce({_STEP}, 0) AS d FROM m)"
_FIX = f"SELECT i, r, c, v, CASE WHEN abs(d) < pi() THEN 0 WHEN w = -pi() AND d > 0 THEN pi() - d ELSE w - d END AS f FROM ({_TURN})"
for _name, _f, _sql in [
    ("unwrap", lambda a: la.unwrap(a * 3.0, axis=1), f"SELECT i, {sql_neat('v + sum(f) OVER (PARTITION BY r ORDER BY c)')} AS v FROM ({_FIX})"),
    ("apply_along_axis", lambda a: la.apply_along_axis(lambda x: x[::2] * 2.0, 1, a), _cells("r * 32 + c // 2", "v * 2", "c % 2 = 0")),
    ("apply_over_axes", lambda a: la.apply_over_axes(la.sum, a, [0, 1]), _whole("sum(v)")),
    ("cumprod_integers", lambda a: la.cumprod((a > 0.1).astype(np.int64) + 1, axis=1), "SELECT i, product(1 + (v > 0.1)::INT) OVER (PARTITION BY r ORDER BY c)::BIGINT AS v FROM m"),
]:
    of_matrix(f"scan_{_name}", _f, _sql)

# ---- sorting, counting
_GRID = "SELECT (k * 3 + l)::BIGINT AS i, count(p)::BIGINT AS v FROM (SELECT unnest(range(3)) AS k), (SELECT unnest(range(3)) AS l) LEFT JOIN (SELECT CASE WHEN x >= -0.6 AND x < -0.1 THEN 0 WHEN x >= -0.1 AND x < 0.1 THEN 1 WHEN x >= 0.1 AND x <= 0.6 THEN 2 END AS p, CASE WHEN y >= -0.6 AND y < -0.1 THEN 0 WHEN y >= -0.1 AND y < 0.1 THEN 1 WHEN y >= 0.1 AND y <= 0.6 THEN 2 END AS q FROM (SELECT max(v) FILTER (c = 0) AS x, max(v) FILTER (c = 1) AS y FROM m GROUP BY r)) ON p = k AND q = l GROUP BY k, l"
_EDGES = [-0.6, -0.1, 0.1, 0.6]
for _name, _f, _sql in [
    ("sort_complex", lambda a: la.real(la.sort_complex(a)), f"SELECT r * {WIDTH} + k AS i, {sql_neat('v')} AS v FROM (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY v, c) - 1 AS k FROM m)"),
    ("histogram_bin_edges", lambda a: la.asarray(la.histogram_bin_edges(a, 8)), "SELECT k::BIGINT AS i, " + sql_neat("lo + (hi - lo) * k / 8") + " AS v FROM (SELECT min(v) AS lo, max(v) AS hi FROM m), (SELECT unnest(range(9)) AS k)"),
    ("histogram2d", lambda a: la.histogram2d(a[:, 0], a[:, 1], [_EDGES, _EDGES])[0], _GRID),
    ("histogramdd", lambda a: la.histogramdd([a[:, 0], a[:, 1]], [_EDGES, _EDGES])[0], _GRID),
    ("put_along_axis", lambda a: la.put_along_axis(a, la.reshape(la.argmax(a, axis=1), (-1, 1)), 9.0, 1), "SELECT i, CASE WHEN v = max(v) OVER (PARTITION BY r) THEN 9.0 ELSE " + sql_neat("v") + " END AS v FROM m"),
    ("ix", lambda a: a[la.ix_([3, 1], [0, 5, 7])], "SELECT (p * 3 + q)::BIGINT AS i, " + sql_neat("v") + " AS v FROM m JOIN (SELECT unnest([0, 1]) AS p, unnest([3, 1]) AS x) ON r = x JOIN (SELECT unnest([0, 1, 2]) AS q, unnest([0, 5, 7]) AS y) ON c = y"),
]:
    of_matrix(f"search_{_name}", _f, _sql)
of_matrix("reduce_var_", lambda a: la.var_(a, axis=0), _by_column("var_pop(v)"))

# ---- the same cells in another form
_SAME = _cells("i")
_TWO = 2 * WIDTH


for _name, _f, _sql in [
    ("array", lambda a: la.array(a), _SAME),
    ("asarray", lambda a: la.asarray(a), _SAME),
    ("asanyarray", lambda a: la.asanyarray(a), _SAME),
    ("ascontiguousarray", lambda a: la.ascontiguousarray(a), _SAME),
    ("asfortranarray", lambda a: la.asfortranarray(a), _SAME),
    ("asarray_chkfinite", lambda a: la.asarray_chkfinite(a), _SAME),
    ("require", lambda a: la.require(a), _SAME),
    ("copy", lambda a: la.copy(a), _SAME),
    ("zeros_like", lambda a: la.zeros_like(a), _cells("i", "0.0")),
    ("ones_like", lambda a: la.ones_like(a), _cells("i", "1.0")),
    ("empty_like", lambda a: la.empty_like(a) * 0.0, _cells("i", "0.0")),
    ("full_like", lambda a: la.full_like(a, 2.5), _cells("i", "2.5")),
    ("fill", lambda a: a.fill(2.5), _cells("i", "2.5")),
    ("diagflat", lambda a: la.diagflat(a[0]), f"SELECT k::BIGINT AS i, coalesce({sql_neat('v')}, 0.0) AS v {_K.format(WIDTH * WIDTH)} LEFT JOIN m ON r = 0 AND k // {WIDTH} = c AND k % {WIDTH} = c"),
    ("concat", lambda a: la.concat([a, -a], axis=1), f"SELECT r * {_TWO} + c AS i, {sql_neat('v')} AS v FROM m UNION ALL SELECT r * {_TWO} + {WIDTH} + c, {sql_neat('-v')} FROM m"),
    ("row_stack", lambda a: la.row_stack([a, -a]), f"SELECT i, {sql_neat('v')} AS v FROM m UNION ALL SELECT i + n * {WIDTH}, {sql_neat('-v')} FROM m"),
    ("column_stack", lambda a: la.column_stack([a[:, 0], a[:, 1]]), _cells("r * 2 + c", where="c < 2")),
    ("block", lambda a: la.block([[a, -a]]), f"SELECT r * {_TWO} + c AS i, {sql_neat('v')} AS v FROM m UNION ALL SELECT r * {_TWO} + {WIDTH} + c, {sql_neat('-v')} FROM m"),
    ("dsplit", lambda a: la.dsplit(eights(a), 2)[1], _cells("r * 32 + c // 8 * 4 + c % 8 - 4", where="c % 8 >= 4")),
    ("atleast_1d", lambda a: la.atleast_1d(a), _SAME),
    ("atleast_2d", lambda a: la.atleast_2d(a[0]), _cells("c", where="r = 0")),
    ("broadcast_arrays", lambda a: la.broadcast_arrays(a, a[0])[1], f"SELECT m.r * {WIDTH} + z.c AS i, {sql_neat('z.v')} AS v FROM m JOIN m z ON z.r = 0 AND z.c = m.c"),
    ("round", lambda a: la.round(a, 1), _cells("i", "round_even(v * 10, 0) / 10")),
    ("unpackbits", lambda a: la.unpackbits(la.packbits(a > 0, axis=1), axis=1), _cells("i", "(v > 0)::INT", kind="i")),
    ("real_if_close", lambda a: la.real_if_close(a.astype(np.complex128)), _SAME),
    ("astype", lambda a: a.astype(np.int32), _cells("i", "trunc(v)", kind="i")),
    ("byteswap", lambda a: byteswap(byteswap(a)), _SAME),
    ("view", lambda a: view(view(a, np.uint8), np.float64), _SAME),
    ("row", lambda a: a.row(3), _cells("c", where="r = 3")),
    ("col", lambda a: a.col(-1), _cells("r", where=f"c = {WIDTH - 1}")),
    ("rows", lambda a: a.rows(2, 5), _cells(f"i - {2 * WIDTH}", where="r BETWEEN 2 AND 4")),
    ("cols", lambda a: a.cols(2, 5), _cells("r * 3 + c - 2", where="c BETWEEN 2 AND 4")),
    ("slice", lambda a: a.slice("::2", "5:1:-1"), _cells("r // 2 * 4 + 5 - c", where="r % 2 = 0 AND c BETWEEN 2 AND 5")),
    ("set", lambda a: a.set([1, 2], 7.5), _cells("i", "CASE WHEN r = 1 AND c = 2 THEN 7.5 ELSE v END")),
    ("iset", lambda a: a.iset(-1, 7.5), _cells("i", f"CASE WHEN i = n * {WIDTH} - 1 THEN 7.5 ELSE v END")),
]:
    of_matrix(f"shape_{_name}", _f, _sql)


def kept(a: Array) -> Array:
    """Used while it is kept, and after."""
    with a.using() as x:
        first = la.sum(x).item()
    return la.asarray(np.array([first, la.sum(x).item()]))


of_matrix("method_using", kept, "SELECT k::BIGINT AS i, " + sql_neat("s") + " AS v FROM (SELECT sum(v) AS s FROM m), (SELECT unnest([0, 1]) AS k)")


# ---- answers: a scalar, text or yes and no from an array
def answers(name: str, f, sql: str, kind: str = "double") -> None:
    """`f(matrix)` gives a list of answers; `sql` gives rows (i, v) over the cells m."""

    def query(spark, sf_dir):
        got = f(matrix(spark, sf_dir))
        out = spark.createDataFrame([(k, v) for k, v in enumerate(got)], f"i long, v {kind}")
        return out.withColumn(V, F.round(V, 6) + 0.0) if kind == "double" else out

    QUERIES[name] = query
    SQL[name] = CELLS + sql


def _cell(r: int, c: int, k: int = 0) -> str:
    return f"SELECT {k}::BIGINT AS i, {sql_neat('v')} AS v FROM m WHERE r = {r} AND c = {c}"


def listed(rows: list, kind: str = "BOOLEAN") -> str:
    """SQL of literal answers."""
    return " UNION ALL ".join(f"SELECT {k}::BIGINT AS i, {v}::{kind} AS v" for k, v in enumerate(rows))


answers("method_get", lambda a: [a.get([2, 3]), a.get([0, -1])], _cell(2, 3) + " UNION ALL " + _cell(0, WIDTH - 1, 1))
answers("method_iget", lambda a: [a.iget(WIDTH + 5)], _cell(1, 5))
answers("method_item", lambda a: [a.item(2, 3), la.item(a, 7)], _cell(2, 3) + " UNION ALL " + _cell(0, 7, 1))
answers("method_tolist", lambda a: a[1].tolist(), f"SELECT c::BIGINT AS i, {sql_neat('v')} AS v FROM m WHERE r = 1")
answers("method_toArray", lambda a: a[1].toArray(), f"SELECT c::BIGINT AS i, {sql_neat('v')} AS v FROM m WHERE r = 1")
answers("method_tobytes", lambda a: np.frombuffer(a[1].tobytes()).tolist(), f"SELECT c::BIGINT AS i, {sql_neat('v')} AS v FROM m WHERE r = 1")
answers("method_dispose", lambda a: [a.cached().dispose() is None], "SELECT 0::BIGINT AS i, true AS v", "boolean")
answers("question_shape", lambda a: [*map(float, la.shape(a)), float(la.size(a)), float(la.ndim(a))], f"SELECT * FROM (SELECT 0::BIGINT AS i, max(n)::DOUBLE AS v FROM m UNION ALL SELECT 1, {WIDTH}.0 UNION ALL SELECT 2, count(*)::DOUBLE FROM m UNION ALL SELECT 3, 2.0)")
answers("question_array_equal", lambda a: [la.array_equal(a, a + 0.0), la.array_equal(a, -a), la.array_equal(a, a[0])], listed(["true", "false", "false"]), "boolean")
answers("question_array_equiv", lambda a: [la.array_equiv(a[0], la.broadcast_to(a[0], (3, WIDTH))), la.array_equiv(a, -a)], listed(["true", "false"]), "boolean")
answers("question_allclose", lambda a: [la.allclose(a, a + 1e-12), la.allclose(a, a + 0.1)], listed(["true", "false"]), "boolean")
answers("question_share_memory", lambda a: [la.may_share_memory(a, a), la.shares_memory(a, a)], listed(["false", "false"]), "boolean")
answers("question_objects", lambda a: [la.iscomplexobj(a), la.iscomplexobj(a.astype(np.complex128)), la.isrealobj(a), la.isfortran(a), la.iterable(a), la.iterable(3), la.isscalar(3.5), la.isscalar(a)], listed(["false", "true", "true", "false", "true", "false", "true", "false"]), "boolean")
for _name, _f, _rows in [
    ("isdtype", lambda: [la.isdtype(np.int32, "integral"), la.isdtype(np.float64, "integral"), la.isdtype(np.bool_, "bool")], ["true", "false", "true"]),
    ("can_cast", lambda: [la.can_cast(np.int8, np.int64), la.can_cast(np.int64, np.int8), la.can_cast(np.int64, np.float64), la.can_cast(np.float64, np.float32)], ["true", "false", "true", "false"]),
    ("issubdtype", lambda: [la.issubdtype(np.int8, np.integer), la.issubdtype(np.float32, np.integer)], ["true", "false"]),
    ("promote_types", lambda: [str(la.promote_types(x, y)) for x, y in (("int8", "uint8"), ("int64", "uint64"), ("float32", "int32"), ("bool", "int16"))], ["'int16'", "'float64'", "'float64'", "'int16'"]),
    ("result_type", lambda: [str(la.result_type(la.zeros(2, "int8"), la.zeros(2, "uint8"))), str(la.result_type("float32", "complex64"))], ["'int16'", "'complex64'"]),
    ("common_type", lambda: [str(la.common_type(la.zeros(2, "int32"))), str(la.common_type(la.zeros(2, "float32"), la.zeros(2, "complex64")))], ["'float64'", "'complex64'"]),
    ("min_scalar_type", lambda: [str(la.min_scalar_type(x)) for x in (10, -10, 300, 70_000, True)], ["'uint8'", "'int8'", "'uint16'", "'uint32'", "'bool'"]),
    ("typename", lambda: [la.typename("d"), la.typename("i"), la.typename("?")], ["'double precision'", "'integer'", "'bool'"]),
    ("mintypecode", lambda: [la.mintypecode(["d", "f"]), la.mintypecode("fF")], ["'d'", "'F'"]),
    ("broadcast_shapes", lambda: [str(tuple(la.broadcast_shapes((3, 1), (1, 4)))), str(tuple(la.broadcast_shapes((5,), (2, 1))))], ["'(3, 4)'", "'(2, 5)'"]),
    ("einsum_path", lambda: [str(la.einsum_path("ij,jk,kl->il", np.ones((2, 50)), np.ones((50, 3)), np.ones((3, 2)))[0])], ["'[''einsum_path'', (0, 1), (0, 1)]'"]),
    ("seterr", lambda: [la.seterr(divide="raise")["divide"], la.geterr()["divide"], la.seterr(divide="warn")["divide"], la.geterr()["divide"]], ["'warn'", "'raise'", "'raise'", "'warn'"]),
    ("geterr", lambda: [la.geterr()["under"], la.geterr()["invalid"]], ["'ignore'", "'warn'"]),
    ("array2string", lambda: [la.array2string(la.asarray([1.0, 2.5, -3.0]), separator=", ")], ["'[ 1. ,  2.5, -3. ]'"]),
    ("array_repr", lambda: [la.array_repr(la.arange(3)), la.array_repr(la.asarray([0.5, 1.0]))], ["'array([0, 1, 2])'", "'array([0.5, 1. ])'"]),
    ("array_str", lambda: [la.array_str(la.arange(3))], ["'[0 1 2]'"]),
    ("format_float_positional", lambda: [la.format_float_positional(0.1), la.format_float_positional(1e16), la.format_float_positional(3.14159, precision=2)], ["'0.1'", "'10000000000000000.'", "'3.14'"]),
    ("format_float_scientific", lambda: [la.format_float_scientific(12345.678), la.format_float_scientific(0.1, precision=3)], ["'1.2345678e+04'", "'1.e-01'"]),
    ("base_repr", lambda: [la.base_repr(5), la.base_repr(-255, 16), la.base_repr(10, 3, 4)], ["'101'", "'-FF'", "'0000101'"]),
    ("binary_repr", lambda: [la.binary_repr(5), la.binary_repr(-3, 5), la.binary_repr(3, 6)], ["'101'", "'11101'", "'000011'"]),
    ("set_printoptions", lambda: [la.set_printoptions(precision=3), la.array_str(la.asarray([1 / 3])), la.set_printoptions(precision=8)][1:2], ["'[0.333]'"]),
    ("get_printoptions", lambda: [str(la.get_printoptions()["precision"]), str(la.get_printoptions()["edgeitems"])], ["'8'", "'3'"]),
    ("printoptions", lambda: _printed(), ["'[0.33]'", "'[0.33333333]'"]),
]:
    QUERIES[f"question_{_name}"] = lambda spark, sf_dir, f=_f: spark.createDataFrame(list(enumerate(f())), "i long, v " + ("boolean" if isinstance(f()[0], bool) else "string"))
    SQL[f"question_{_name}"] = listed(_rows, "VARCHAR" if _rows[0].startswith("'") else "BOOLEAN")


def _printed() -> list[str]:
    with la.printoptions(precision=2):
        first = la.array_str(la.asarray([1 / 3]))
    return [first, la.array_str(la.asarray([1 / 3]))]


# ---- made of the index, and polynomials
for _name, _f, _sql in [
    ("empty", lambda: la.empty((3, 4)) * 0.0, ZEROS.format(12)),
    ("array_of_lists", lambda: la.array([[1.0, 2.0], [3.0, 4.0]]), f"SELECT k::BIGINT AS i, (k + 1)::DOUBLE AS v {_K.format(4)}"),
    ("frombuffer", lambda: la.frombuffer(np.arange(5.0).tobytes()), f"SELECT k::BIGINT AS i, k::DOUBLE AS v {_K.format(5)}"),
    ("fromiter", lambda: la.fromiter((k * k for k in range(5)), np.float64), f"SELECT k::BIGINT AS i, (k * k)::DOUBLE AS v {_K.format(5)}"),
    ("fromstring", lambda: la.fromstring("0 1.5 3", sep=" "), f"SELECT k::BIGINT AS i, k * 1.5::DOUBLE AS v {_K.format(3)}"),
    ("ravel_multi_index", lambda: la.ravel_multi_index(la.unravel_index(la.arange(24), (2, 3, 4)), (2, 3, 4)), f"SELECT k::BIGINT AS i, k::BIGINT AS v {_K.format(24)}"),
    ("diag_indices", lambda: la.diag_indices(5)[1], f"SELECT k::BIGINT AS i, k::BIGINT AS v {_K.format(5)}"),
    ("diag_indices_from", lambda: la.diag_indices_from(la.zeros((4, 4)))[0], f"SELECT k::BIGINT AS i, k::BIGINT AS v {_K.format(4)}"),
    ("triu_indices", lambda: la.triu_indices(4, 1)[1], _POS.replace("ORDER BY i", "ORDER BY k") + "(k % 4)::BIGINT AS v FROM (SELECT unnest(range(16)) AS k) WHERE k % 4 > k // 4"),
    ("tril_indices_from", lambda: la.tril_indices_from(la.zeros((4, 4)))[1], _POS.replace("ORDER BY i", "ORDER BY k") + "(k % 4)::BIGINT AS v FROM (SELECT unnest(range(16)) AS k) WHERE k % 4 <= k // 4"),
    ("triu_indices_from", lambda: la.triu_indices_from(la.zeros((4, 4)))[0], _POS.replace("ORDER BY i", "ORDER BY k") + "(k // 4)::BIGINT AS v FROM (SELECT unnest(range(16)) AS k) WHERE k % 4 >= k // 4"),
    ("mask_indices", lambda: la.mask_indices(4, la.triu)[1], _POS.replace("ORDER BY i", "ORDER BY k") + "(k % 4)::BIGINT AS v FROM (SELECT unnest(range(16)) AS k) WHERE k % 4 >= k // 4"),
    ("nextafter", lambda: (la.nextafter(la.full((3,), 1.0), 2.0) - 1.0) * 2.0**52, ONES.format(3)),
    ("spacing", lambda: la.spacing(la.asarray([1.0, 2.0, 4.0])) * 2.0**52, f"SELECT k::BIGINT AS i, pow(2, k)::DOUBLE AS v {_K.format(3)}"),
    ("poly", lambda: la.poly([1.0, 2.0, 3.0]), "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, -6.0), (2, 11.0), (3, -6.0)) x(i, v)"),
    ("polyadd", lambda: la.polyadd([1.0, 2.0], [3.0, 4.0, 5.0]), "SELECT * FROM (VALUES (0::BIGINT, 3.0::DOUBLE), (1, 5.0), (2, 7.0)) x(i, v)"),
    ("polysub", lambda: la.polysub([1.0, 2.0], [3.0, 4.0, 5.0]), "SELECT * FROM (VALUES (0::BIGINT, -3.0::DOUBLE), (1, -3.0), (2, -3.0)) x(i, v)"),
    ("polymul", lambda: la.polymul([1.0, 2.0], [3.0, 4.0]), "SELECT * FROM (VALUES (0::BIGINT, 3.0::DOUBLE), (1, 10.0), (2, 8.0)) x(i, v)"),
    ("polydiv", lambda: la.polydiv([1.0, 3.0, 2.0], [1.0, 1.0])[0], "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 2.0)) x(i, v)"),
    ("polyder", lambda: la.polyder([1.0, 3.0, 2.0]), "SELECT * FROM (VALUES (0::BIGINT, 2.0::DOUBLE), (1, 3.0)) x(i, v)"),
    ("polyint", lambda: la.polyint([2.0, 3.0]), "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 3.0), (2, 0.0)) x(i, v)"),
    ("roots", lambda: la.sort(la.real(la.roots([1.0, -6.0, 11.0, -6.0]))), f"SELECT k::BIGINT AS i, (k + 1)::DOUBLE AS v {_K.format(3)}"),
]:
    made(f"made_{_name}", _f, _sql)

of_matrix("linalg_einsum_chain", lambda a: la.einsum("ij,kj,kl->il", a, a, a), f", g AS (SELECT x.c AS p, y.c AS q, sum(x.v * y.v) AS s FROM m x JOIN m y ON x.r = y.r GROUP BY x.c, y.c) SELECT (r * {WIDTH} + q)::BIGINT AS i, {sql_neat('sum(v * s)')} AS v FROM m JOIN g ON c = p GROUP BY r, q")

_PARTED = "SELECT (row_number() OVER (ORDER BY CASE WHEN x < t THEN 0 WHEN x = t THEN 1 ELSE 2 END, k) - 1)::BIGINT AS i, {0} AS v FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, (SELECT max(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 701)) AS t FROM orders)"
of_column("column_partition", "orders", "o_totalprice", ["o_orderkey"], lambda a: la.partition(a, 700), _PARTED.format(sql_neat("x")))
of_column("column_argpartition", "orders", "o_totalprice", ["o_orderkey"], lambda a: la.argpartition(a, 700), _PARTED.format("k::BIGINT"))

# ---- lines that meet lines: merges, convolutions, distinct slices
def _two(spark, sf_dir):
    return from_column(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", ["o_orderkey"]), from_column(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice", ["p_partkey"])


def of_two(name: str, f, sql: str) -> None:
    """Prices of orders (l, in order), and of parts (p)."""
    QUERIES[name] = lambda spark, sf_dir: shown(f(*_two(spark, sf_dir)))
    SQL[name] = "WITH l AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) AS i, o_totalprice AS x FROM orders), p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS j, p_retailprice AS y, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS k FROM part) " + sql


of_two("search_searchsorted_table", lambda x, p: la.searchsorted(la.sort(p), x / 200, "right"), "SELECT i, coalesce(k + 1, 0)::BIGINT AS v FROM l ASOF LEFT JOIN (SELECT y, max(k) AS k FROM p GROUP BY y) p ON l.x / 200 >= p.y")
of_two("search_digitize_table", lambda x, p: la.digitize(x / 200, la.sort(p)[::-1]), "SELECT i, ((SELECT count(*) FROM p) - coalesce(k + 1, 0))::BIGINT AS v FROM l ASOF LEFT JOIN (SELECT y, max(k) AS k FROM p GROUP BY y) p ON l.x / 200 >= p.y")
_KNOTS = "q AS (SELECT y AS x0, lead(y) OVER (ORDER BY y) AS x1 FROM (SELECT DISTINCT y FROM p))"
of_two("shape_interp_table", lambda x, p: (lambda u: la.interp(x / 200, u, la.sqrt(u), left=-1.0))(la.unique(p)), f", {_KNOTS} SELECT i, {sql_neat('CASE WHEN x0 IS NULL THEN -1 WHEN x1 IS NULL THEN sqrt(x0) ELSE sqrt(x0) + (sqrt(x1) - sqrt(x0)) / (x1 - x0) * (x / 200 - x0) END')} AS v FROM l ASOF LEFT JOIN q ON l.x / 200 >= q.x0")
of_two("shape_interp_period", lambda x, p: la.interp(x, [0.0, 100.0, 250.0], [1.0, 5.0, 2.0], period=400.0), f" SELECT i, {sql_neat('CASE WHEN m < 100 THEN 1 + 4 * m / 100 WHEN m < 250 THEN 5 - 3 * (m - 100) / 150 ELSE 2 - (m - 250) / 150 END')} AS v FROM (SELECT i, x - 400 * floor(x / 400) AS m FROM l)")
of_two("scan_convolve_table", lambda x, p: la.convolve(la.rint(x * 100).astype(np.int64), la.rint(p * 100).astype(np.int64), "same"), "SELECT i, v::BIGINT AS v FROM (SELECT i + j - ((SELECT count(*) FROM p) - 1) // 2 AS i, sum((x * 100)::BIGINT::HUGEINT * (y * 100)::BIGINT) AS v FROM l, p GROUP BY 1) WHERE i BETWEEN 0 AND (SELECT max(i) FROM l)")
of_two("scan_diff_ends", lambda x, p: la.diff(x, prepend=0.0, append=[1.0, 2.0]), f"SELECT i::BIGINT AS i, {sql_neat('x - b')} AS v FROM (SELECT i, x, lag(x, 1, 0.0) OVER (ORDER BY i) AS b FROM (SELECT i, x FROM l UNION ALL SELECT (SELECT count(*) FROM l) + k, k + 1.0 FROM (SELECT unnest([0, 1]) AS k)))")
for _name, _f, _sql in [
    ("slices", lambda u: u[0], "SELECT (k * 6 + c)::BIGINT AS i, x[c + 1] + 0.0 AS v FROM u, (SELECT unnest(range(6)) AS c)"),
    ("slices_inverse", lambda u: u[2], "SELECT r::BIGINT AS i, k::BIGINT AS v FROM s JOIN u USING (x)"),
    ("slices_counts", lambda u: u[3], "SELECT k::BIGINT AS i, n::BIGINT AS v FROM u"),
]:
    QUERIES[f"set_unique_{_name}"] = lambda spark, sf_dir, f=_f: shown(f(la.unique(la.rint(matrix(spark, sf_dir)[:, :6] * 2.0) + 0.0, True, True, True, axis=0)))
    SQL[f"set_unique_{_name}"] = f"WITH s AS (SELECT r, list(round_even(v * 2, 0) + 0.0 ORDER BY c) AS x FROM (SELECT vec_id AS r, unnest(range({WIDTH})) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE c < 6 GROUP BY r), u AS (SELECT x, count(*) AS n, row_number() OVER (ORDER BY x) - 1 AS k FROM s GROUP BY x) {_sql}"


# ---- random draws, by their moments
DRAWS = 200_000


def moments(name: str, draw, mean: str, sd: str, places: tuple[float, float]) -> None:
    """Four draws of a fixed seed for each line item: how many there are, whether mean and standard deviation are within
    `places` (five standard errors and more for DRAWS draws) of what theory says, and whether draws have nothing
    to do with the items' prices."""

    def query(spark, sf_dir):
        y = la.tile(from_column(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", ["l_orderkey", "l_linenumber"]), 4)
        a = draw(la.random.default_rng(7), y.size)
        both = mapped(lambda v, w: F.struct(v.cast("double").alias("x"), w.alias("y")), np.float64, a, y)
        x = both.bag.select(f"{V}.x", f"{V}.y").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.coalesce(F.corr("x", "y"), F.lit(1.0)).alias("r"))
        wide = F.sqrt(F.lit(float(DRAWS)) / F.col("n"))
        near = [F.abs(F.col(c) - w) <= p * wide for c, w, p in zip("ms", (eval_sql(e) for e in (mean, sd)), places, strict=True)]
        return x.select("n", near[0].alias("mean_near"), near[1].alias("sd_near"), (F.abs("r") * F.sqrt("n") <= 6).alias("unrelated"))

    QUERIES[f"random_{name}"] = query
    SQL[f"random_{name}"] = "SELECT count(*) * 4 AS n, true AS mean_near, true AS sd_near, true AS unrelated FROM lineitem"


def eval_sql(e: str) -> float:
    """The formulas below mean the same in Python."""
    return float(eval(e, {"sqrt": math.sqrt, "pi": lambda: math.pi, "gamma": math.gamma, "exp": math.exp, "ln": math.log, "pow": math.pow}))  # noqa: S307 - fixed formulas


def _as(f):
    """Draws of the global generator's function, seeded."""

    def draw(g, n):
        la.random.seed(7)
        return f(n)

    return draw


EULER = "0.5772156649015329"
for _name, _draw, _mean, _sd, _places in [
    ("uniform", lambda g, n: g.uniform(2.0, 5.0, size=n), "3.5", "3 / sqrt(12)", (0.02, 0.02)),
    ("normal", lambda g, n: g.normal(1.0, 2.0, size=n), "1.0", "2.0", (0.03, 0.03)),
    ("standard_normal", lambda g, n: g.standard_normal(n), "0.0", "1.0", (0.02, 0.02)),
    ("exponential", lambda g, n: g.exponential(2.0, size=n), "2.0", "2.0", (0.03, 0.05)),
    ("standard_exponential", lambda g, n: g.standard_exponential(size=n), "1.0", "1.0", (0.02, 0.02)),
    ("gamma", lambda g, n: g.gamma(2.0, 1.5, size=n), "3.0", "1.5 * sqrt(2)", (0.03, 0.05)),
    ("standard_gamma", lambda g, n: g.standard_gamma(2.0, size=n), "2.0", "sqrt(2)", (0.02, 0.03)),
    ("beta", lambda g, n: g.beta(2.0, 3.0, size=n), "2.0 / 5", "sqrt(6.0 / 150)", (0.01, 0.01)),
    ("chisquare", lambda g, n: g.chisquare(4.0, size=n), "4.0", "sqrt(8)", (0.05, 0.06)),
    ("noncentral_chisquare", lambda g, n: g.noncentral_chisquare(4.0, 2.0, size=n), "6.0", "sqrt(16)", (0.06, 0.08)),
    ("f", lambda g, n: g.f(5.0, 20.0, size=n), "20.0 / 18", "sqrt(2 * 400.0 * 23 / (5 * 324 * 16))", (0.02, 0.05)),
    ("noncentral_f", lambda g, n: g.noncentral_f(5.0, 20.0, 2.0, size=n), "20.0 * 7 / (5 * 18)", "sqrt(2 * (49.0 + 9 * 18) / (18 * 18 * 16) * 16)", (0.03, 0.06)),
    ("standard_t", lambda g, n: g.standard_t(10.0, size=n), "0.0", "sqrt(10.0 / 8)", (0.02, 0.03)),
    ("laplace", lambda g, n: g.laplace(1.0, 2.0, size=n), "1.0", "2 * sqrt(2)", (0.05, 0.05)),
    ("logistic", lambda g, n: g.logistic(1.0, 2.0, size=n), "1.0", "2 * pi() / sqrt(3)", (0.06, 0.06)),
    ("lognormal", lambda g, n: g.lognormal(0.0, 0.5, size=n), "exp(0.125)", "sqrt((exp(0.25) - 1) * exp(0.25))", (0.02, 0.03)),
    ("gumbel", lambda g, n: g.gumbel(1.0, 2.0, size=n), f"1 + 2 * {EULER}", "2 * pi() / sqrt(6)", (0.04, 0.05)),
    ("pareto", lambda g, n: g.pareto(6.0, size=n), "1.0 / 5", "sqrt(6.0 / (25 * 4))", (0.01, 0.02)),
    ("power", lambda g, n: g.power(3.0, size=n), "3.0 / 4", "sqrt(3.0 / (16 * 5))", (0.01, 0.01)),
    ("rayleigh", lambda g, n: g.rayleigh(2.0, size=n), "2 * sqrt(pi() / 2)", "2 * sqrt(2 - pi() / 2)", (0.02, 0.02)),
    ("triangular", lambda g, n: g.triangular(0.0, 1.0, 5.0, size=n), "2.0", "sqrt(21.0 / 18)", (0.02, 0.02)),
    ("wald", lambda g, n: g.wald(2.0, 4.0, size=n), "2.0", "sqrt(8.0 / 4)", (0.03, 0.05)),
    ("weibull", lambda g, n: g.weibull(2.0, size=n), "gamma(1.5)", "sqrt(1 - gamma(1.5) * gamma(1.5))", (0.01, 0.01)),
    ("vonmises", lambda g, n: la.sin(g.vonmises(0.0, 4.0, size=n)), "0.0", "0.4646484", (0.01, 0.01)),
    ("poisson", lambda g, n: g.poisson(3.0, size=n), "3.0", "sqrt(3)", (0.03, 0.03)),
    ("binomial", lambda g, n: g.binomial(10, 0.3, size=n), "3.0", "sqrt(2.1)", (0.02, 0.02)),
    ("geometric", lambda g, n: g.geometric(0.25, size=n), "4.0", "sqrt(12)", (0.05, 0.08)),
    ("hypergeometric", lambda g, n: g.hypergeometric(10, 20, 6, size=n), "2.0", "sqrt(6.0 * (1.0 / 3) * (2.0 / 3) * 24 / 29)", (0.02, 0.02)),
    ("logseries", lambda g, n: g.logseries(0.5, size=n), "0.5 / (0.5 * ln(2))", "sqrt((0.5 / (0.25 * ln(2))) * (1 - 0.5 / ln(2)))", (0.02, 0.03)),
    ("negative_binomial", lambda g, n: g.negative_binomial(4, 0.5, size=n), "4.0", "sqrt(8)", (0.05, 0.06)),
    ("zipf", lambda g, n: g.zipf(7.0, size=n), "1.0173430619844491 / 1.0083492773819228", "sqrt(1.0369277551433699 / 1.0083492773819228 - pow(1.0173430619844491 / 1.0083492773819228, 2))", (0.01, 0.08)),
    ("multinomial", lambda g, n: g.multinomial(10, [0.2, 0.8], n)[:, 0], "2.0", "sqrt(1.6)", (0.03, 0.03)),
    ("multivariate_normal", lambda g, n: g.multivariate_normal([1.0, 2.0], [[2.0, 0.5], [0.5, 1.0]], n)[:, 1], "2.0", "1.0", (0.03, 0.03)),
    ("dirichlet", lambda g, n: g.dirichlet([1.0, 2.0, 3.0], n)[:, 2], "0.5", "sqrt(0.25 / 7)", (0.01, 0.01)),
    ("standard_cauchy", lambda g, n: la.arctan(g.standard_cauchy(size=n)), "0.0", "pi() / sqrt(12)", (0.02, 0.02)),
    ("choice", lambda g, n: g.choice(50, n), "24.5", "sqrt(2499.0 / 12)", (0.3, 0.3)),
    ("choice_weighted", lambda g, n: g.choice(3, n, p=[0.2, 0.3, 0.5]), "1.3", "sqrt(0.61)", (0.02, 0.02)),
    ("permutation_moments", lambda g, n: g.permutation(n) / n, "0.5", "1 / sqrt(12)", (0.001, 0.001)),
    ("shuffle", lambda g, n: g.shuffle(la.arange(n)) / n, "0.5", "1 / sqrt(12)", (0.001, 0.001)),
    ("random", lambda g, n: g.random(n), "0.5", "1 / sqrt(12)", (0.01, 0.01)),
    ("random_sample", _as(lambda n: la.random.random_sample(n)), "0.5", "1 / sqrt(12)", (0.01, 0.01)),
    ("ranf", _as(lambda n: la.random.ranf(n)), "0.5", "1 / sqrt(12)", (0.01, 0.01)),
    ("sample", _as(lambda n: la.random.sample(n)), "0.5", "1 / sqrt(12)", (0.01, 0.01)),
    ("rand", _as(lambda n: la.ravel(la.random.rand(n // 4, 4))), "0.5", "1 / sqrt(12)", (0.01, 0.01)),
    ("randn", _as(lambda n: la.ravel(la.random.randn(n // 4, 4))), "0.0", "1.0", (0.02, 0.02)),
    ("randint", _as(lambda n: la.random.randint(0, 50, n)), "24.5", "sqrt(2499.0 / 12)", (0.3, 0.3)),
    ("random_integers", _as(lambda n: la.random.random_integers(0, 49, n)), "24.5", "sqrt(2499.0 / 12)", (0.3, 0.3)),
]:
    moments(_name, _draw, _mean, _sd, _places)


def _states() -> list[bool]:
    """Seeds and states repeat what they say; another seed doesn't."""
    r = la.random
    r.seed(3)
    kept_state = r.get_state()
    first = r.rand(5).tolist()
    r.set_state(kept_state)
    again = r.rand(5).tolist()
    r.seed(4)
    other = r.rand(5).tolist()
    old = r.get_bit_generator()
    r.set_bit_generator(np.random.PCG64(5))
    drawn = r.rand(3).tolist()
    r.set_bit_generator(np.random.PCG64(5))
    repeated = r.rand(3).tolist()
    r.set_bit_generator(old)
    return [first == again, first != other, drawn == repeated, r.default_rng(1).random(3).tolist() == r.default_rng(1).random(3).tolist(), len(r.bytes(7)) == 7]


QUERIES["random_states"] = lambda spark, sf_dir: spark.createDataFrame(list(enumerate(_states())), "i long, v boolean")
SQL["random_states"] = listed(["true"] * 5)


# ---- files and bytes
def _path(a: Array, name: str) -> str:
    return f"{shared_folder(a.df.sparkSession)}/{uuid.uuid4().hex}.{name}"


def _npy(a: Array) -> Array:
    path = _path(a, "npy")
    la.saveNpy(path, a)
    return la.loadNpy(path)


def _npy_sync(a: Array) -> Array:
    path = _path(a, "npy")
    la.saveSync(path, a)
    la.saveNpySync(path + "2", la.loadSync(path))
    return la.loadNpySync(path + "2")


def _npz(a: Array) -> Array:
    path = _path(a, "npz")
    la.saveNpz(path, {"x": a})
    la.saveNpzSync(path, {"y": la.loadNpzFile(path)["x"]}, True)
    return la.loadNpzFileSync(path)["y"]


def _compressed(a: Array) -> Array:
    path = _path(a, "npz")
    la.savez_compressed(path, a)
    return la.load(path)["arr_0"]


def _zip(a: Array) -> Array:
    data = la.writeZip({"a.npy": la.serializeNpy(a), "b.txt": b"text"})
    return la.parseNpy(la.readZipSync(la.writeZipSync(la.readZip(data), True))["a.npy"])


def _parts(a: Array) -> Array:
    data = la.serializeNpy(a)
    return la.parseNpyData(data, la.parseNpyHeader(data))


def _text(a: Array) -> Array:
    return la.parseTxt(la.serializeTxt(a).encode())


def _text_sync(a: Array) -> Array:
    path = _path(a, "txt")
    la.savetxtSync(path, a, delimiter=",")
    la.savetxtSync(path + "2", la.genfromtxtSync(path, delimiter=","))
    return la.loadtxtSync(path + "2")


def _regex(f):
    def run(a: Array) -> Array:
        path = _path(a, "txt")
        la.savetxt(path, a, fmt="<%.18e>")
        return f(path, r"<([^>]*)>").reshape((-1, WIDTH))

    return run


for _name, _f in [
    ("loadNpy", _npy),
    ("saveSync", _npy_sync),
    ("parseNpy", lambda a: la.parseNpy(la.serializeNpy(a))),
    ("parseNpyHeader_Data", _parts),
    ("parseNpz", lambda a: la.parseNpz(la.serializeNpz({"x": a}))["x"]),
    ("parseNpzSync", lambda a: la.parseNpzSync(la.serializeNpzSync([a], True))["arr_0"]),
    ("loadNpz", lambda a: la.loadNpz(la.serializeNpz([a]))["arr_0"]),
    ("loadNpzSync", lambda a: la.loadNpzSync(la.serializeNpz([a]))["arr_0"]),
    ("loadNpzFile", _npz),
    ("savez_compressed", _compressed),
    ("readZip_writeZip", _zip),
    ("parseTxt_serializeTxt", _text),
    ("savetxtSync", _text_sync),
    ("fromregex", _regex(la.fromregex)),
    ("fromregexSync", _regex(la.fromregexSync)),
]:
    of_matrix(f"io_{_name}", _f, _SAME)
QUERIES["io_parseDescriptor"] = lambda spark, sf_dir: spark.createDataFrame([(0, str(la.parseDescriptor("<f8"))), (1, str(la.parseDescriptor("|b1"))), (2, str(la.crc32(b"123456789")))], "i long, v string")
SQL["io_parseDescriptor"] = listed(["'float64'", "'bool'", "'3421780262'"], "VARCHAR")  # the check value of CRC-32

# ---- columns: functions and reductions that read the table as it stands
for _name, _f, _sql in [
    ("max", lambda a: la.max(a * 2.0), "SELECT 0::BIGINT AS i, " + sql_neat("max(o_totalprice) * 2") + " AS v FROM orders"),
    ("percentile", lambda a: la.percentile(a, 90), "SELECT 0::BIGINT AS i, " + sql_neat("quantile_cont(o_totalprice, 0.9)") + " AS v FROM orders"),
    ("argmax", la.argmax, "SELECT 0::BIGINT AS i, arg_max(k, o_totalprice)::BIGINT AS v FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)"),
    ("argsort", la.argsort, "SELECT (row_number() OVER (ORDER BY o_totalprice, k) - 1)::BIGINT AS i, k::BIGINT AS v FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)"),
]:
    of_column(f"column_{_name}", "orders", "o_totalprice", ["o_orderkey"], _f, _sql)
