"""N-dimensional arrays as DataFrames.

An `Array` is a frame with a row for each element: its flat row-major index (a long) and its value.
Shape and element type are kept on the driver, so reshaping costs nothing and all else is a plan
for Catalyst.  Values are Column expressions over the frame, so functions of arrays that share a
frame and an index are one projection; only arrays of different frames are joined, on the index.
Arrays that are a function of the index (constants, ranges, grids) have no frame until they need
one: they take part in any expression without a join.
"""

from __future__ import annotations

import math
import numbers
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomarray import dtypes as dt
from loomarray.functions import elementwise as ew

I, V = "i", "v"
MAX_NDIM = 64


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def div(a: Column, n: int) -> Column:
    return a if n == 1 else F.call_function("div", a, F.lit(n))


def strides(shape: Sequence[int]) -> list[int]:
    out, n = [], 1
    for d in reversed(shape):
        out.append(n)
        n *= d
    return out[::-1]


def size_of(shape: Sequence[int]) -> int:
    return math.prod(shape)


def coords(index: Column, shape: Sequence[int]) -> list[Column]:
    """The index along each axis."""
    out = []
    for k, (d, s) in enumerate(zip(shape, strides(shape), strict=True)):
        c = div(index, s)
        out.append(F.lit(0).cast("long") if d == 1 else c if k == 0 else c % F.lit(d))
    return out


def ravel(cs: Sequence[Column], shape: Sequence[int]) -> Column:
    """The flat index of coordinates."""
    out = None
    for c, s, d in zip(cs, strides(shape), shape, strict=True):
        if d == 1 and len(shape) > 1:
            continue
        term = c * s if s != 1 else c
        out = term if out is None else out + term
    return (F.lit(0) if out is None else out).cast("long")


def axes_of(axis, ndim: int) -> list[int]:
    given = range(ndim) if axis is None else [axis] if isinstance(axis, numbers.Integral) else list(axis)
    out = []
    for a in given:
        if not -ndim <= a < ndim:
            raise IndexError(f"axis {a} is out of bounds for array of dimension {ndim}")
        out.append(int(a) % ndim)
    if len(set(out)) != len(out):
        raise ValueError("duplicate axis")
    return out


class Array:
    __array_priority__ = 1000

    def __init__(self, frame: DataFrame | None, index: Column | None, value: Column | None, shape: Sequence[int], dtype, gen: Callable[[Column], Column] | None = None):
        if len(shape) > MAX_NDIM:
            raise ValueError(f"at most {MAX_NDIM} dimensions")
        self._frame, self._index, self._value, self.gen = frame, index, value, gen
        self.shape, self.dtype = tuple(int(s) for s in shape), dt.dtype(dtype)

    #: The table behind an array whose places are not numbered yet.
    _table: Rows | None = None
    #: For a matrix whose rows are vectors of a table: (table, number of the row, vector, width).
    _vectors = None
    #: What keeps a frame in the cluster's memory for this array; it goes with the arrays that hold it.
    _kept = None
    #: How many runs of neighbouring places interleave in the frame's rows; 0: they stand in no known order.
    _runs = 0
    #: The value as a function of the place that tasks compute in Python, and the most runs it is to see (see `placed`).
    _lookup: Callable[[Column], Column] | None = None
    _reach = 0

    # ---- frames
    @property
    def frame(self) -> DataFrame:
        if self._frame is None and self._table is not None:
            self._frame = self._table.numbered
        if self._frame is None:
            self._frame = session().range(self.size).withColumnRenamed("id", I)
            self._index, self._value = F.col(I), self.gen(F.col(I))
        return self._frame

    @property
    def index(self) -> Column:
        self.frame  # noqa: B018
        return self._index

    @property
    def value(self) -> Column:
        self.frame  # noqa: B018
        return self._value

    @property
    def df(self) -> DataFrame:
        """Columns i and v."""
        return self.frame.select(self.index.cast("long").alias(I), self.value.alias(V))

    @property
    def bag(self) -> DataFrame:
        """Column v, for what does not depend on places: nothing is numbered for it."""
        return self.df.select(V) if self._table is None else self._table.df.select(self._value.alias(V))

    @classmethod
    def of(cls, df: DataFrame, shape: Sequence[int], dtype) -> Array:
        """From a frame with columns i and v."""
        return cls(df, F.col(I), F.col(V), shape, dtype)

    def with_value(self, f: Callable[[Column], Column], dtype) -> Array:
        """The same cells with other values."""
        if self.gen is not None:
            g = self.gen
            return Array(None, None, None, self.shape, dtype, lambda i: f(g(i)))
        if self._table is not None and len(self.shape) == 1:
            return self._table.array(f(self._value), dtype)
        out = Array(self.frame, self.index, f(self.value), self.shape, dtype)
        if self._vectors is not None:
            table, key, vector, width = self._vectors
            # `transform` gives functions with a second parameter the place: `f` is to have the value only
            out._vectors = table, key, F.transform(vector, lambda x: f(x)), width
        out._runs = self._runs
        if (g := self._lookup) is not None:
            out._lookup, out._reach = lambda i: f(g(i)), self._reach
        return out

    def reshaped(self, shape: Sequence[int]) -> Array:
        out = Array(self._frame, self._index, self._value, shape, self.dtype, self.gen)
        out._table, out._vectors, out._kept = self._table, self._vectors, self._kept
        out._runs, out._lookup, out._reach = self._runs, self._lookup, self._reach
        return out

    def cached(self) -> Array:
        """Kept in memory and on disk of the cluster, for arrays that are used again, until `dispose`."""
        return Array.of(self.df.persist(), self.shape, self.dtype)

    def dispose(self) -> None:
        """Give back what `cached` keeps.  The array stays usable: its plan is run again."""
        if self._frame is not None:
            self._frame.unpersist()
        self._kept = None

    def __enter__(self) -> Array:
        return self

    def __exit__(self, *problem) -> None:
        self.dispose()

    using = cached

    # ---- metadata
    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return size_of(self.shape)

    @property
    def itemsize(self) -> int:
        return self.dtype.itemsize

    @property
    def nbytes(self) -> int:
        return self.size * self.itemsize

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(s * self.itemsize for s in strides(self.shape))

    @property
    def flags(self) -> dict:
        return {"C_CONTIGUOUS": True, "F_CONTIGUOUS": self.ndim <= 1, "OWNDATA": True}

    base = None

    @property
    def T(self) -> Array:
        from loomarray.operators.shape import transpose

        return transpose(self)

    # ---- out of Spark
    def numpy(self) -> np.ndarray:
        """On the driver, in order.  For arrays that fit there."""
        table = self.df.toArrow()
        index = table[I].to_numpy()
        if self.dtype.kind == "c":
            flat = table.flatten()
            data = flat[f"{V}.re"].to_numpy() + 1j * flat[f"{V}.im"].to_numpy()
        elif self.dtype.name == "uint64":
            data = np.array([int(x) for x in table[V].to_pylist()], np.uint64)
        else:
            data = table[V].to_numpy()
        out = np.zeros(self.size, self.dtype)
        out[index] = data.astype(self.dtype)
        return out.reshape(self.shape)

    def item(self, *args):
        flat = 0
        if len(args) == 1:
            flat = args[0] + (self.size if args[0] < 0 else 0)
        elif args:
            flat = int(np.ravel_multi_index(args, self.shape))
        elif self.size != 1:
            raise ValueError("can only convert an array of size 1 to a scalar")
        row = self.df.where(F.col(I) == flat).first()
        if row is None:
            raise IndexError("index out of bounds")
        v = row[V]
        return complex(v["re"], v["im"]) if self.dtype.kind == "c" else int(v) if self.dtype.name == "uint64" else v

    def tolist(self):
        return self.numpy().tolist()

    toArray = tolist

    def _flat(self, indices: Sequence[int]) -> int:
        """The flat index of one index an axis; negative ones count from the end."""
        if len(indices) != self.ndim:
            raise IndexError(f"Index has {len(indices)} dimensions, but array has {self.ndim} dimensions")
        at = []
        for k, (j, n) in enumerate(zip(indices, self.shape, strict=True)):
            if not -n <= j < n:
                raise IndexError(f"Index {j} is out of bounds for axis {k} with size {n}")
            at.append(j % n)
        return sum(j * s for j, s in zip(at, strides(self.shape), strict=True))

    def get(self, indices: Sequence[int]):
        """One value, by an index for each axis."""
        return self.item(self._flat(indices))

    def iget(self, flat: int):
        return self.item(flat)

    def set(self, indices: Sequence[int], value) -> Array:
        """A new array with another value in one place; whole-number arrays round it."""
        return self.iset(self._flat(indices), value)

    def iset(self, flat: int, value) -> Array:
        if not -self.size <= flat < self.size:
            raise IndexError("index out of bounds")
        if self.dtype.kind in "iu" and isinstance(value, float):
            value = math.floor(value + 0.5)
        one = dt.lit(bool(value) if self.dtype.kind == "b" else value, self.dtype)
        flat %= self.size
        return Array(self.frame, self.index, F.when(self.index == flat, one).otherwise(self.value), self.shape, self.dtype)

    def _part(self, name: str, *slices: str) -> Array:
        if self.ndim < 2:
            raise ValueError(f"{name}() requires at least 2 dimensions")
        return self.slice(*slices)

    def row(self, i: int) -> Array:
        return self._part("row", str(i), ":")

    def col(self, j: int) -> Array:
        return self._part("col", ":", str(j))

    def rows(self, start: int, stop: int) -> Array:
        return self._part("rows", f"{start}:{stop}", ":")

    def cols(self, start: int, stop: int) -> Array:
        return self._part("cols", ":", f"{start}:{stop}")

    def tobytes(self, order: str = "C") -> bytes:
        return self.numpy().tobytes(order)

    def astype(self, dtype) -> Array:
        new, old = dt.dtype(dtype), self.dtype
        return self if new == old else self.with_value(lambda v: dt.cast(v, old, new), new)

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("len() of unsized object")
        return self.shape[0]

    def __repr__(self) -> str:
        from loomarray.operators.formatting import array_repr

        return array_repr(self)

    def __str__(self) -> str:
        from loomarray.operators.formatting import array_str

        return array_str(self)

    def __getitem__(self, key):
        from loomarray.operators.indexing import getitem

        return getitem(self, key)

    def slice(self, *strs: str) -> Array:
        """Slices as text: '0:2', ':', '-1', '::2', '...', 'newaxis'."""
        from loomarray.operators.indexing import getitem, parse_slice

        return getitem(self, tuple(parse_slice(s) for s in strs))

    def __bool__(self) -> bool:
        return bool(self.item())

    def __float__(self) -> float:
        return float(self.item())

    def __int__(self) -> int:
        return int(self.item())


def asarray(x, dtype=None) -> Array:
    """An Array of an Array, NumPy array, nested list or scalar; lists of numbers are float64 unless a type is given."""
    if isinstance(x, Array):
        return x if dtype is None else x.astype(dtype)
    if dtype is None and isinstance(x, (list, tuple, int, float)) and not isinstance(x, bool):
        guess = np.asarray(x)
        dtype = guess.dtype if guess.dtype.kind in "cb" else np.float64
    data = np.asarray(x, dtype)
    d = dt.dtype(data.dtype)
    if not data.ndim:
        return Array(None, None, None, (), d, lambda i: dt.lit(data.item(), d))
    return local(data)


def local(data: np.ndarray) -> Array:
    """From the driver's memory, as an Arrow table."""
    import pyarrow as pa

    d = dt.dtype(data.dtype)
    flat = np.ascontiguousarray(data).ravel()
    schema = T.StructType([T.StructField(I, T.LongType(), False), T.StructField(V, dt.spark_type(d))])
    index = pa.array(np.arange(flat.size))
    if d.kind == "c":
        p = dt.part(d)
        value = pa.StructArray.from_arrays([pa.array(flat.real.astype(p)), pa.array(flat.imag.astype(p))], ["re", "im"])
    elif d.name == "uint64":
        from decimal import Decimal

        value = pa.array([Decimal(int(x)) for x in flat], pa.decimal128(20, 0))
    else:
        held = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}.get(d.name, d)
        value = pa.array(flat.astype(held))
    return Array.of(session().createDataFrame(pa.table([index, value], [I, V]), schema), data.shape, d)


def generated(shape: Sequence[int], dtype, f: Callable[[Column], Column]) -> Array:
    """An array whose values are a function of the flat index."""
    return Array(None, None, None, shape, dtype, f)


def placed(shape: Sequence[int], dtype, f: Callable[[Column], Column], reach: float) -> Array:
    """An array whose values tasks compute in Python from the flat index: alone it is a frame of its own; beside
    arrays of one frame whose rows come in `reach` runs of neighbouring places or fewer it is a function of their
    index, without a join."""
    out = Array.of(session().range(size_of(shape)).select(F.col("id").alias(I), f(F.col("id")).alias(V)), shape, dtype)
    out._lookup, out._reach = f, reach
    return out


def looked_up(arrays: Sequence[Array], shape: Sequence[int]) -> list[Array]:
    """`arrays`, those of `placed` as functions of the index where the rows of the others let them."""
    rest = [a for a in arrays if a.gen is None and a._lookup is None]
    if not rest:
        return list(arrays)
    base = rest[0]
    near = base._runs and all(a.shape == shape and a.frame is base.frame and a.index is base.index for a in rest)
    runs = base._runs if near else math.inf
    return [generated(shape, a.dtype, a._lookup) if a._lookup is not None and a.shape == shape and runs <= a._reach else a for a in arrays]


def broadcast_index(index: Column, shape: Sequence[int], own: Sequence[int]) -> Column:
    """The flat index, in an operand of shape `own`, of a cell of the broadcast shape."""
    if tuple(own) == tuple(shape):
        return index
    cs = coords(index, shape)[len(shape) - len(own) :]
    return ravel([F.lit(0).cast("long") if d == 1 else c for c, d in zip(cs, own, strict=True)], own) if own else F.lit(0).cast("long")


def stretched(a: Array, shape: Sequence[int]) -> DataFrame:
    """Cells i, v of `a` broadcast to `shape`: each is repeated along the axes that stretch."""
    own = (1,) * (len(shape) - a.ndim) + a.shape
    df = a.df
    cs = coords(F.col(I), own)
    for k, (d, n) in enumerate(zip(own, shape, strict=True)):
        if d != n:
            name = f"_c{k}"
            df = df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else df.where(F.lit(False)).withColumn(name, F.lit(0).cast("long"))
            cs[k] = F.col(name)
    return df.select(ravel(cs, shape).alias(I), V)


def aligned(*arrays: Array) -> tuple[DataFrame | None, Column | None, list, tuple[int, ...]]:
    """One frame for all: (frame, index, values, shape).  Without a frame, values are functions of the index."""
    shape = np.broadcast_shapes(*(a.shape for a in arrays))
    arrays = looked_up(arrays, shape)
    framed = [a for a in arrays if a.gen is None]
    if not framed:
        return None, None, [lambda i, a=a: a.gen(broadcast_index(i, shape, a.shape)) for a in arrays], shape
    base = next((a for a in framed if a.shape == shape), None)
    together = base is not None and all(a.frame is base.frame and a.index is base.index for a in framed if a.shape == shape) and all(a.shape == shape for a in framed)
    if together:
        return base.frame, base.index, [a.value if a.gen is None else a.gen(broadcast_index(base.index, shape, a.shape)) for a in arrays], shape
    values: dict[int, Column] = {}
    if base is None:
        base = framed[0]
        df = stretched(base, shape).withColumnRenamed(V, "v0")
        values[id(base)] = F.col("v0")
    else:
        same = [a for a in framed if a.shape == shape and a.frame is base.frame and a.index is base.index]
        df = base.frame.select(base.index.cast("long").alias(I), *(a.value.alias(f"v{k}") for k, a in enumerate(same)))
        values |= {id(a): F.col(f"v{k}") for k, a in enumerate(same)}
    for a in framed:
        if id(a) not in values:
            n = f"v{len(values)}"
            own = a.df.select(F.col(I).alias("_j"), F.col(V).alias(n))
            df = df.withColumn("_k", broadcast_index(F.col(I), shape, a.shape)).join(own, F.col("_k") == F.col("_j")).drop("_j", "_k")
            values[id(a)] = F.col(n)
    index = F.col(I)
    return df, index, [values[id(a)] if a.gen is None else a.gen(broadcast_index(index, shape, a.shape)) for a in arrays], shape


def mapped(f: Callable[..., Column], dtype, *arrays: Array) -> Array:
    """A new array of a function of cells that broadcast together."""
    framed = [a for a in arrays if a.gen is None]
    rows = framed[0]._table if framed else None
    if rows is not None and all(a._table is rows and a.ndim == 1 if a.gen is None else a.size == 1 and a.ndim < 2 for a in arrays):
        return rows.array(f(*(a._value if a.gen is None else a.gen(F.lit(0).cast("long")) for a in arrays)), dtype)
    frame, index, values, shape = aligned(*arrays)
    if frame is None:
        return generated(shape, dtype, lambda i: f(*(v(i) for v in values)))
    out = Array(frame, index, f(*values), shape, dtype)
    out._runs = next((a._runs for a in framed if a._frame is frame), 0)
    if all(a._lookup is not None and a.shape == shape for a in framed):
        out._lookup = lambda i: f(*((a.gen if a.gen is not None else a._lookup)(broadcast_index(i, shape, a.shape)) for a in arrays))
        out._reach = min(a._reach for a in framed)
    return out


def elementwise(name: str, *operands, **options) -> Array:
    """A ufunc on arrays and scalars; Python scalars take the arrays' type where they can."""
    arrays, kinds = [], []
    given = [x for x in operands if isinstance(x, (Array, np.ndarray, np.generic, list, tuple))]
    for x in operands:
        if isinstance(x, (bool, np.bool_)):
            kinds.append(np.dtype("bool"))
            arrays.append(asarray(np.bool_(x)))
        elif isinstance(x, (int, float, complex)) and not isinstance(x, np.generic):
            kinds.append(type(x) if given else np.dtype(type(x)))
            arrays.append(x)
        else:
            a = x if isinstance(x, Array) else asarray(x)
            kinds.append(a.dtype)
            arrays.append(a)
    to, out = ew.resolve(name, *kinds)
    arrays = [a if isinstance(a, Array) else generated((), t, lambda i, a=a, t=t: dt.lit(a, t)) for a, t in zip(arrays, to, strict=True)]
    olds = [a.dtype for a in arrays]

    def f(*columns):
        return ew.KERNELS[name](to[0], *(dt.cast(c, o, t) for c, o, t in zip(columns, olds, to, strict=True)), **options)

    return mapped(f, out, *arrays)


def gather(a: Array, shape: Sequence[int], source: Callable[[Column], Column], fill=None) -> Array:
    """Cell i of the result is cell `source(i)` of `a`; where that is null or not there, `fill`."""
    if a.gen is not None and fill is None:
        return generated(shape, a.dtype, lambda i: a.gen(source(i)))
    df = session().range(size_of(shape)).select(F.col("id").alias(I), source(F.col("id")).cast("long").alias("_j"))
    own = a.df.select(F.col(I).alias("_s"), V)
    if fill is None:
        return Array.of(df.join(own, F.col("_j") == F.col("_s")).select(I, V), shape, a.dtype)
    joined = df.join(own, F.col("_j") == F.col("_s"), "left")
    return Array.of(joined.select(I, F.coalesce(V, dt.lit(fill, a.dtype)).alias(V)), shape, a.dtype)


def moved(a: Array, shape: Sequence[int], target: Callable[[list[Column]], Sequence[Column]], keep: Callable[[list[Column]], Column] | None = None) -> Array:
    """Cells go to the coordinates `target` of the result: index arithmetic, no join; `keep` leaves some out."""
    if keep is None:
        return Array(a.frame, ravel(target(coords(a.index, a.shape)), shape), a.value, shape, a.dtype)
    df = a.df.where(keep(coords(F.col(I), a.shape)))
    return Array.of(df.select(ravel(target(coords(F.col(I), a.shape)), shape).alias(I), V), shape, a.dtype)


#: Rows that one window numbers, about; more are cut into ranges, of which there are at most RANGES.
IN_A_WINDOW, RANGES = 1 << 18, 1 << 14


def _literal(x, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and x is not None:
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(x, kind.fields, strict=True)))
    return F.lit(bytes(x) if isinstance(x, bytearray) else x).cast(kind)


def _cuts(keys: DataFrame, n: int) -> tuple[list, list[int]]:
    """Values of column k that cut a sample of it into even ranges, ascending, and how often each would stand
    there: more than once where one value fills several ranges.  The sample is bounded by the number of ranges."""
    ranges = min(RANGES, -(-n // IN_A_WINDOW))
    sample = [r.k for r in keys.sample(min(1.0, 32 * ranges / n), seed=17).orderBy("k").collect()]
    cuts, times = [], []
    for j in range(1, ranges if sample else 1):
        x = sample[j * len(sample) // ranges]
        if x is None:  # nulls stand before the first cut
            continue
        if cuts and repr(cuts[-1]) == repr(x):
            times[-1] += 1
        else:
            cuts.append(x)
            times.append(1)
    return cuts, times


def ranged(df: DataFrame, key: Column, n: int, salt: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Rows with the number of their range by `key` (column _range), and how many rows stand before each range.

    A row's range is a function of its values alone: a binary search among cuts that are literals in the
    plan.  What equals a cut is apart from what is above it, and with `salt` (a hash of the row) spread over
    as many ranges as it would fill.  One count a range comes to the driver.
    """
    keys = df.select(key.alias("k"))
    cuts, times = _cuts(keys, n)
    return _dealt(df, key, keys.schema["k"].dataType, cuts, times, salt)


def _dealt(df: DataFrame, key: Column, kind: T.DataType, cuts: list, times: list[int], salt: Column | None) -> tuple[DataFrame, dict[int, int]]:
    if not cuts:
        return df.withColumn("_range", F.lit(0)), {0: 0}
    width = [0, *(times if salt is not None else [1] * len(cuts))]  # ranges of what equals a cut; then one of what is above
    base = np.cumsum([0, *(w + 1 for w in width[:-1])]).tolist()
    literal = F.array(*(_literal(x, kind) for x in cuts))
    if len(cuts) < 32:
        up = reduce(add, [F.coalesce((_literal(x, kind) <= key).cast("int"), F.lit(0)) for x in cuts])
    else:
        steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
        up = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(literal, at + s - 1) <= key, at + s).otherwise(at))
    wide = F.get(whole(width), F.col("_up"))
    equal = F.get(literal, F.col("_up") - 1).eqNullSafe(key) & (F.col("_up") > 0)
    inside = F.when(equal, F.pmod(salt, wide).cast("int") if salt is not None else F.lit(0)).otherwise(wide)
    out = df.withColumn("_up", up).withColumn("_range", (F.get(whole(base), F.col("_up")) + inside).cast("int")).drop("_up")
    counts = dict(out.groupBy("_range").agg(F.count("*")).collect())
    order = sorted(counts)
    return out, dict(zip(order, np.cumsum([0, *(counts[r] for r in order[:-1])]).tolist(), strict=True))


def whole(numbers: Sequence[int]) -> Column:
    """A literal array of longs."""
    return F.expr("array(" + ",".join(f"{x}L" for x in numbers) + ")")


def numbered(df: DataFrame, *order, name: str = I, n: int | None = None) -> tuple[DataFrame, int]:
    """Rows with their place from 0 in the order of the values `order`, and how many there are.

    The place is a function of the rows: what stands before a row's range (see `ranged`), and its place in
    the range by a window.  So the result does not depend on how often, or in how many partitions, the plan
    is run.  Rows that tie in `order` and differ elsewhere stand in the order of a hash of the row, rows alike
    in everything in any order.  `order` has values, not sort orders: negatives of numbers for descending ones.
    """
    order = [c if isinstance(c, Column) else F.col(c) for c in order]
    if n is None:
        n = df.count()
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    if n <= IN_A_WINDOW:
        w = Window.partitionBy(F.lit(0)).orderBy(*order, tie)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long")), n
    first = df.select(order[0].alias("k"))
    cuts, times = _cuts(first, n)
    if cuts and max(times) == 1:  # the first value alone cuts evenly
        out, before = _dealt(df, order[0], first.schema["k"].dataType, cuts, times, None)
    else:
        out, before = ranged(df, F.struct(*(c.alias(f"k{j}") for j, c in enumerate(order))), n, tie)
    start = F.get(whole([before.get(r, 0) for r in range(max(before, default=0) + 1)]), F.col("_range"))
    w = Window.partitionBy("_range").orderBy(*order, tie)
    return out.withColumn(name, (F.row_number().over(w) - 1).cast("long") + start).drop("_range"), n


class Rows:
    """A table whose rows are cells in a given order; they are counted at once, and numbered when a place is asked for."""

    def __init__(self, df: DataFrame, order: Sequence[Column], values: Sequence[str]):
        kinds = {c: df.schema[c] for c in values}
        floats = [c for c, f in kinds.items() if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and f.nullable]
        whole = [c for c, f in kinds.items() if c not in floats and f.nullable]
        n, *known = df.agg(F.count(F.lit(1)), *(F.count(f"`{c}`") for c in whole)).first()
        if lacking := [c for c, k in zip(whole, known, strict=True) if k < n]:
            raise ValueError(f"null in column {lacking[0]}: only floats have a value for it, NaN")
        self.df = df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(math.nan).cast(kinds[c].dataType)) for c in floats})
        self.order, self.count, self._numbered = list(order), n, None

    @property
    def numbered(self) -> DataFrame:
        if self._numbered is None:
            self._numbered = numbered(self.df, *self.order, name="_i", n=self.count)[0]
        return self._numbered

    def array(self, value: Column, dtype) -> Array:
        out = Array(None, F.col("_i"), value, (self.count,), dtype)
        out._table, out._runs = self, 1
        return out


def from_column(df: DataFrame, value: str | Column, order_by: Sequence, dtype=None) -> Array:
    """A table's column as a one-dimensional array, in a given order of the rows (ties must not matter).

    Rows are numbered only where a place is needed: functions of the values and reductions of all of them
    read the table as it stands.  A null is NaN in a column of floats, and an error in others.
    """
    v = F.col(value) if isinstance(value, str) else value
    order = [c if isinstance(c, Column) else F.col(c) for c in order_by]
    kept = df.select(v.alias(V), *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    rows = Rows(kept, [F.col(f"_o{k}") for k in range(len(order))], [V])
    a = rows.array(F.col(V), dt.of_spark(kept.schema[V].dataType))
    return a if dtype is None else a.astype(dtype)


def from_columns(df: DataFrame, values: Sequence[str], order_by: Sequence) -> list[Array]:
    """Columns of one table as arrays of one frame: functions of them are projections.  Nulls are as in `from_column`."""
    names = list(dict.fromkeys([*values, *order_by]))
    rows = Rows(df.select(*names), [F.col(c) for c in order_by], list(dict.fromkeys(values)))
    return [rows.array(F.col(v), dt.of_spark(rows.df.schema[v].dataType)) for v in values]


def from_vectors(df: DataFrame, key: str, vector: str, width: int) -> Array:
    """An array-typed column as a matrix: row `key` (0 .. n - 1), one column an element."""
    n = df.agg(F.max(key)).first()[0]
    d = dt.of_spark(df.schema[vector].dataType.elementType)
    cells = df.select(F.col(key).cast("long").alias("_r"), F.posexplode(vector).alias("_c", V)).select((F.col("_r") * width + F.col("_c")).alias(I), V)
    out = Array.of(cells, (0 if n is None else n + 1, width), d)
    out._vectors = df, F.col(key).cast("long"), F.col(vector), width
    return out


def gather_bits(a: Array, axis: int, count, bitorder: str) -> Array:
    """Each byte's eight bits along `axis`, cut or filled with zeros to `count`."""
    n = a.shape[axis] * 8
    cs = coords(F.col(I), a.shape)
    bit = F.col("_b")
    shape = (*a.shape[:axis], n, *a.shape[axis + 1 :])
    df = a.df.withColumn("_b", F.explode(F.array(*map(F.lit, range(8)))))
    out = [*cs[:axis], cs[axis] * 8 + bit, *cs[axis + 1 :]]
    place = (7 - bit) if bitorder == "big" else bit
    value = F.call_function("shiftright", F.col(V).cast("int"), place).bitwiseAND(F.lit(1)).cast("short")
    bits = Array.of(df.select(ravel(out, shape).alias(I), value.alias(V)), shape, np.uint8)
    if count is None:
        return bits
    want = count if count >= 0 else n + count
    if want <= n:
        keep = (*a.shape[:axis], want, *a.shape[axis + 1 :])
        return moved(bits, keep, lambda c: c, lambda c: c[axis] < want)
    from loomarray.operators.shape import pad

    return pad(bits, [(0, want - n) if k == axis else (0, 0) for k in range(a.ndim)])


def _operators() -> None:
    def binary(name):
        return lambda self, other: elementwise(name, self, other)

    def swapped(name):
        return lambda self, other: elementwise(name, other, self)

    for method, name in {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "mod": "mod", "pow": "power", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "left_shift", "rshift": "right_shift"}.items():
        setattr(Array, f"__{method}__", binary(name))
        setattr(Array, f"__r{method}__", swapped(name))
    for method, name in {"lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal", "eq": "equal", "ne": "not_equal"}.items():
        setattr(Array, f"__{method}__", binary(name))
    Array.__hash__ = object.__hash__
    for method, name in {"neg": "negative", "pos": "positive", "abs": "absolute", "invert": "bitwise_not"}.items():
        setattr(Array, f"__{method}__", lambda self, name=name: elementwise(name, self))


_operators()


# ---- functions of any array-like, where the class has methods
def ndim(a) -> int:
    return asarray(a).ndim


def shape(a) -> tuple[int, ...]:
    return asarray(a).shape


def size(a) -> int:
    return asarray(a).size


def item(a, *args):
    return asarray(a).item(*args)


def tolist(a):
    return asarray(a).tolist()


def tobytes(a, order: str = "C") -> bytes:
    return asarray(a).tobytes(order)


def view(a, dtype=None) -> Array:
    """The same bytes as another type of the same size; without a type, the array."""
    a = asarray(a)
    if dtype is None or np.dtype(dtype) == a.dtype:
        return a
    d = dt.dtype(dtype)
    return _bytes(a, d, lambda x: x.view(d))


def byteswap(a) -> Array:
    a = asarray(a)
    return _bytes(a, a.dtype, lambda x: x.byteswap())


def _bytes(a: Array, d: np.dtype, f) -> Array:
    """A change of the bytes of values, batch by batch (bits of floats have no Column form)."""
    import pyarrow as pa

    from loomarray.operators.dense import _in, arrow

    old = a.dtype
    ratio = old.itemsize / d.itemsize
    if a.shape and a.shape[-1] * ratio % 1 or (not a.shape and ratio != 1):
        raise ValueError("the last axis must hold a whole number of values of the new type")
    if ratio < 1:
        return _joined(a, d, d.itemsize // old.itemsize)
    n = int(ratio)

    def run(batches):
        for b in batches:
            x = np.ascontiguousarray(f(np.ascontiguousarray(_in(b.column(1), old))))
            index = np.repeat(b.column(0).to_numpy() * n, n) + np.tile(np.arange(n), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(index), arrow(x, d)], [I, V])

    schema = T.StructType([T.StructField(I, T.LongType()), T.StructField(V, dt.spark_type(d))])
    new = (*a.shape[:-1], a.shape[-1] * n) if a.shape else ()
    return Array.of(a.df.mapInArrow(run, schema), new, d)


def _joined(a: Array, d: np.dtype, n: int) -> Array:
    """Each `n` neighbouring values of the last axis as one of a wider type: they meet in a group of their own."""
    import pyarrow as pa

    from loomarray.operators.dense import _in, arrow

    old = a.dtype
    groups = a.df.select(div(F.col(I), n).alias(I), F.struct((F.col(I) % n).alias("p"), V).alias("x")).groupBy(I)
    df = groups.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x[V]).alias("x"))  # n is at most 16

    def run(batches):
        for b in batches:
            x = np.ascontiguousarray(_in(b.column(1).flatten(), old)).view(d)
            yield pa.RecordBatch.from_arrays([b.column(0), arrow(x, d)], [I, V])

    schema = T.StructType([T.StructField(I, T.LongType()), T.StructField(V, dt.spark_type(d))])
    return Array.of(df.mapInArrow(run, schema), (*a.shape[:-1], a.shape[-1] // n), d)


def _methods() -> None:
    """Every function whose first argument is an array is also a method."""
    names = """sum prod mean max min ptp argmax argmin var std median all any cumsum cumprod sort argsort partition argpartition
    reshape flatten ravel squeeze swapaxes transpose repeat take put choose compress clip round nonzero searchsorted diagonal trace dot conj conjugate
    real imag copy fill byteswap view tofile count_nonzero around""".split()
    import loomarray

    def method(name):
        def run(self, *args, **kw):
            return getattr(loomarray, name)(self, *args, **kw)

        run.__name__ = name
        return run

    for name in names:
        if name in ("real", "imag"):
            setattr(Array, name, property(lambda self, name=name: elementwise(name, self)))
        else:
            setattr(Array, name, method(name))


_methods()
