"""Random arrays.  Up to BLOCK values come from NumPy's own generator on the driver, so seeds give NumPy's
sequences; larger arrays are drawn in blocks across the cluster, each block from its own stream of the
same family, so that neither partitions nor retries change a value.  A draw is a function of its place, so
beside a table whose rows come in order it takes neither a join nor a shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, coords, local, placed, ravel, size_of
from loomarray.operators.dense import arrow

BLOCK = 1 << 16
#: Runs of neighbouring places that a task may draw for in turn, and blocks that it keeps meanwhile.
RUNS, HELD = 16, 32


def _size(size) -> tuple[int, ...]:
    return () if size is None else (int(size),) if np.isscalar(size) else tuple(int(s) for s in size)


def _function(f: Callable[[np.ndarray], np.ndarray], d: np.dtype):
    """A function of NumPy arrays of places as one of a column."""

    def run(i: pa.Array) -> pa.Array:
        return arrow(f(i.to_numpy()), d)

    return F.arrow_udf(run, dt.spark_type(d))


def _by_blocks(draw: Callable[[int], np.ndarray], step: int) -> Callable[[np.ndarray], np.ndarray]:
    """Values at places, each block of `step` drawn when the first of its places comes; the last ones used are kept."""
    held: dict[int, np.ndarray] = {}

    def f(at: np.ndarray) -> np.ndarray:
        block, out = at // step, np.empty(0)
        for k in np.unique(block).tolist():
            held[k] = held.pop(k) if k in held else draw(k)
            if len(held) > HELD:
                del held[next(iter(held))]
            own = block == k
            if not len(out):
                out = np.empty(len(at), held[k].dtype)
            out[own] = held[k][at[own] - k * step]
        return out

    return f


class Permuted:
    """A permutation of 0 .. n - 1 as a function of the place (`at`), and its inverse (`to`).

    Rounds of a Feistel network permute a grid of `rows` x `columns` places, n of them and as few more as a grid near
    a square can have; who lands on one of these is sent on until it is among the n.
    """

    def __init__(self, n: int, seed: int, rounds: int = 8):
        root = math.isqrt(n)
        rows = np.arange(max(1, root - min(4096, root // 4)), root + 1)
        columns = -(-n // rows)
        best = int(np.argmin((rows * columns - n)[::-1]))
        self.n, self.rows, self.columns = n, int(rows[::-1][best]), int(columns[::-1][best])
        self.keys = np.random.SeedSequence([seed, n]).generate_state(rounds, np.uint64)

    def _step(self, x: np.ndarray, sign: int) -> np.ndarray:
        row, column = np.divmod(x, self.columns)
        for j, key in list(enumerate(self.keys))[::sign]:
            if j % 2:
                column = (column + sign * self._hash(row, key, self.columns)) % self.columns
            else:
                row = (row + sign * self._hash(column, key, self.rows)) % self.rows
        return row * self.columns + column

    @staticmethod
    def _hash(x: np.ndarray, key: np.uint64, size: int) -> np.ndarray:
        """SplitMix64's mix of the value and the key, below `size`."""
        z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _walk(self, x: np.ndarray, sign: int) -> np.ndarray:
        out = self._step(x, sign)
        while (over := np.flatnonzero(out >= self.n)).size:
            out[over] = self._step(out[over], sign)
        return out

    def at(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, 1)

    def to(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, -1)


class _Source:
    """Draws by method name: `self.draws` makes a NumPy generator of a key, `self.own` is the driver's."""

    def __init__(self, own, make, legacy: bool):
        self.own, self.make, self.legacy = own, make, legacy

    def draw(self, name: str, size, *args, dtype=np.float64, item: tuple[int, ...] = (), **kw):
        shape = _size(size)
        n = size_of(shape)
        if n * size_of(item) <= BLOCK or not shape:
            out = getattr(self.own, name)(*args, size=size, **kw)
            return out if size is None and not item else local(np.asarray(out).astype(dtype, copy=False))
        key = [int(x) for x in self.own.randint(0, 2**31 - 1, 4)] if self.legacy else [int(x) for x in self.own.integers(0, 2**31 - 1, 4)]
        d, make, width = dt.dtype(dtype), self.make, size_of(item)
        rows = max(1, BLOCK // width)

        def block(k: int) -> np.ndarray:
            return np.asarray(getattr(make([*key, k]), name)(*args, size=min(rows, n - k * rows), **kw)).ravel()

        return placed((*shape, *item), d, _function(_by_blocks(block, rows * width), d), RUNS)


#: Distributions: the method's name, its parameters with defaults, and the type of what it draws.
_R, _Z = np.float64, np.int64
DISTRIBUTIONS = {
    "uniform": ((("low", 0.0), ("high", 1.0)), _R), "normal": ((("loc", 0.0), ("scale", 1.0)), _R), "standard_normal": ((), _R), "exponential": ((("scale", 1.0),), _R),
    "standard_exponential": ((), _R), "gamma": ((("shape", None), ("scale", 1.0)), _R), "standard_gamma": ((("shape", None),), _R), "beta": ((("a", None), ("b", None)), _R),
    "chisquare": ((("df", None),), _R), "noncentral_chisquare": ((("df", None), ("nonc", None)), _R), "f": ((("dfnum", None), ("dfden", None)), _R),
    "noncentral_f": ((("dfnum", None), ("dfden", None), ("nonc", None)), _R), "standard_cauchy": ((), _R), "standard_t": ((("df", None),), _R), "laplace": ((("loc", 0.0), ("scale", 1.0)), _R),
    "logistic": ((("loc", 0.0), ("scale", 1.0)), _R), "lognormal": ((("mean", 0.0), ("sigma", 1.0)), _R), "gumbel": ((("loc", 0.0), ("scale", 1.0)), _R), "pareto": ((("a", None),), _R),
    "power": ((("a", None),), _R), "rayleigh": ((("scale", 1.0),), _R), "triangular": ((("left", None), ("mode", None), ("right", None)), _R), "wald": ((("mean", None), ("scale", None)), _R),
    "weibull": ((("a", None),), _R), "vonmises": ((("mu", None), ("kappa", None)), _R), "poisson": ((("lam", 1.0),), _Z), "binomial": ((("n", None), ("p", None)), _Z),
    "geometric": ((("p", None),), _Z), "hypergeometric": ((("ngood", None), ("nbad", None), ("nsample", None)), _Z), "logseries": ((("p", None),), _Z), "negative_binomial": ((("n", None), ("p", None)), _Z),
    "zipf": ((("a", None),), _Z),
}


def _method(name: str):
    params, kind = DISTRIBUTIONS[name]

    def f(self, *args, size=None, **kw):
        values = []
        args = list(args)
        if len(args) > len(params):
            size = args.pop()
        for k, (p, default) in enumerate(params):
            v = args[k] if k < len(args) else kw.get(p, default)
            if v is None:
                raise TypeError(f"{name}() needs {p}")
            values.append(v)
        return self.source.draw(name, size, *values, dtype=kind)

    f.__name__ = name
    f.__doc__ = f"Draws of the {name} distribution."
    return f


class _Common:
    source: _Source

    def bytes(self, length: int) -> bytes:
        return self.source.own.bytes(length)

    def multinomial(self, n: int, pvals, size=None):
        return self.source.draw("multinomial", size, n, list(pvals), dtype=_Z, item=(len(pvals),))

    def multivariate_normal(self, mean, cov, size=None):
        mean = [float(x) for x in mean]
        return self.source.draw("multivariate_normal", size, mean, np.asarray(cov, float), item=(len(mean),))

    def dirichlet(self, alpha, size=None):
        return self.source.draw("dirichlet", size, [float(x) for x in alpha], item=(len(alpha),))

    def permutation(self, x):
        """In random order: small ones as NumPy does; of others the place is a function of the place before, so
        cells only get other indices."""
        small = isinstance(x, (int, np.integer)) and x <= BLOCK or not isinstance(x, (int, np.integer)) and asarray(x).size <= BLOCK
        if small:
            return local(self.source.own.permutation(x if isinstance(x, (int, np.integer)) else asarray(x).numpy()))
        seed = int(self.source.own.randint(0, 2**31 - 1) if self.source.legacy else self.source.own.integers(0, 2**31 - 1))
        if isinstance(x, (int, np.integer)):
            return placed((int(x),), np.int64, _function(Permuted(int(x), seed).at, np.dtype("int64")), math.inf)
        a = asarray(x)
        order = Permuted(a.shape[0], seed)
        at, to = (_function(f, np.dtype("int64")) for f in (order.at, order.to))

        def source(i, f):
            first, *rest = coords(i, a.shape)
            return ravel([f(first), *rest], a.shape)

        if a.gen is not None:
            return placed(a.shape, a.dtype, lambda i: a.gen(source(i, at)), math.inf)
        return Array.of(a.df.select(source(F.col(I), to).alias(I), V), a.shape, a.dtype)

    shuffle = permutation

    def weighted_order(self, n: int, p: Array) -> Array:
        """Places in the order in which draws without replacement take them: by an exponential time over the
        weight, from a hash of the place and a seed.  Places of weight 0 come last."""
        from loomarray.cells import numbered

        seed = int(self.source.own.randint(0, 2**31 - 1) if self.source.legacy else self.source.own.integers(0, 2**31 - 1))
        u = (F.call_function("shiftrightunsigned", F.xxhash64(I, F.lit(seed)), F.lit(11)) + 0.5) / float(1 << 53)
        w = F.col(V).cast("double")
        times = p.df.select(I, F.when(w > 0, -F.log(u) / w).otherwise(float("inf")).alias("_t"))
        order, _ = numbered(times, "_t", I, name="_n", n=n)
        return Array.of(order.select(F.col("_n").alias(I), F.col(I).alias(V)), (n,), np.int64)

    def choice(self, a, size=None, replace: bool = True, p=None):
        n = int(a) if isinstance(a, (int, np.integer)) else asarray(a).shape[0]
        count = size_of(_size(size))
        if count <= BLOCK and n <= BLOCK:
            at = self.source.own.choice(n, size, replace, None if p is None else np.asarray(p.numpy() if isinstance(p, Array) else p))
            if size is None:
                return int(at) if isinstance(a, (int, np.integer)) else asarray(a)[int(at)].item()
            at = local(np.asarray(at, np.int64))
        elif not replace:
            from loomarray.operators.shape import array_split

            order = self.permutation(n) if p is None else self.weighted_order(n, asarray(p))
            at = array_split(order, [count])[0].reshaped(_size(size))
        else:
            weights = None if p is None else np.asarray(p.numpy() if isinstance(p, Array) else p)
            at = self.source.draw("choice", size, n, dtype=_Z, **({"p": weights} if weights is not None else {})) if weights is not None else self.integers_(0, n, size)
        if isinstance(a, (int, np.integer)):
            return at
        from loomarray.operators.indexing import take

        return take(a, at, 0)


class Generator(_Common):
    """PCG64, as NumPy's default_rng."""

    def __init__(self, seed=None):
        own = np.random.default_rng(seed)
        self.source = _Source(own, lambda key: np.random.Generator(np.random.PCG64(np.random.SeedSequence(key))), False)

    def random(self, size=None):
        return self.source.draw("random", size)

    def integers(self, low, high=None, size=None, dtype=np.int64, endpoint: bool = False):
        low, high = (0, low) if high is None else (low, high)
        return self.source.draw("integers", size, low, high, dtype=dtype, endpoint=endpoint)

    integers_ = integers


class RandomState(_Common):
    """MT19937, as NumPy's legacy functions."""

    def __init__(self, seed=None):
        own = np.random.RandomState(seed)
        self.source = _Source(own, lambda key: np.random.RandomState(np.random.MT19937(np.random.SeedSequence(key))), True)

    def seed(self, seed=None) -> None:
        self.source.own.seed(seed)

    def get_state(self):
        return self.source.own.get_state()

    def set_state(self, state) -> None:
        self.source.own.set_state(state)

    def random_sample(self, size=None):
        return self.source.draw("random_sample", size)

    random = ranf = sample = random_sample

    def rand(self, *shape):
        return self.random_sample(shape or None)

    def randn(self, *shape):
        return self.standard_normal(size=shape or None)

    def randint(self, low, high=None, size=None, dtype=np.int64):
        low, high = (0, low) if high is None else (low, high)
        return self.source.draw("randint", size, low, high, dtype=dtype)

    integers_ = randint

    def random_integers(self, low, high=None, size=None):
        low, high = (1, low) if high is None else (low, high)
        return self.randint(low, high + 1, size)


for _name in DISTRIBUTIONS:
    for _kind in (Generator, RandomState):
        setattr(_kind, _name, _method(_name))

_state = RandomState()
_bit_generator = None


def default_rng(seed=None) -> Generator:
    return seed if isinstance(seed, Generator) else Generator(seed)


def get_bit_generator():
    return _bit_generator or _state.source.own._bit_generator


def set_bit_generator(bit_generator) -> None:
    global _bit_generator
    _bit_generator = bit_generator
    _state.source.own = np.random.RandomState(bit_generator)


def _top(name: str):
    def f(*args, **kw):
        return getattr(_state, name)(*args, **kw)

    f.__name__ = name
    return f


for _name in [*DISTRIBUTIONS, "seed", "get_state", "set_state", "random_sample", "random", "ranf", "sample", "rand", "randn", "randint", "random_integers", "bytes", "multinomial", "multivariate_normal", "dirichlet", "permutation", "shuffle", "choice"]:
    globals()[_name] = _top(_name)
