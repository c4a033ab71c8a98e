"""Large draws: functions of the place, exact beside tables, and never sent to every executor."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import loomarray as la
from loomarray.cells import from_column, local, mapped
from loomarray.operators.random import Permuted

N = 100_000


@pytest.fixture(scope="module")
def column(spark):
    return from_column(spark.range(N // 4).select(((F.col("id") * 7919) % (N // 4)).alias("k")).withColumn("x", F.col("k") * 0.5), "x", ["k"])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


DRAWS = {
    "beta": lambda g: g.beta(2.0, 3.0, size=N),
    "binomial": lambda g: g.binomial(10, 0.3, size=N),
    "choice": lambda g: g.choice(50, N),
    "choice_weighted": lambda g: g.choice(3, N, p=[0.2, 0.3, 0.5]),
    "multinomial": lambda g: g.multinomial(10, [0.2, 0.8], N)[:, 0],
    "dirichlet": lambda g: g.dirichlet([1.0, 2.0, 3.0], N)[:, 2],
    "scaled": lambda g: la.ravel(la.reshape(g.poisson(3.0, size=N), (-1, 4))) / 2,
}


@pytest.mark.parametrize("name", DRAWS)
def test_draws_beside_a_table(spark, column, name):
    """They take no join there: a join took them for the size of their blocks' numbers, and sent all of them through the driver."""
    y = la.tile(column, 4)
    a = DRAWS[name](la.random.default_rng(7))
    both = mapped(lambda v, w: F.struct(v.cast("double").alias("x"), w.alias("y")), np.float64, a, y).df
    assert "Join" not in plan(both)
    got = both.select("i", "v.x", "v.y").orderBy("i").toPandas()
    assert (got.i == np.arange(N)).all()
    assert (got.x == a.numpy()).all()
    assert (got.y == np.tile(np.arange(N // 4) * 0.5, 4)).all()


def test_draws_in_a_join(spark):
    """Where rows stand in no known order, draws are joined, and their size is known to the optimizer."""
    a = la.random.default_rng(3).normal(size=N)
    size = int(a.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size >= 8 * N
    other = la.flip(la.arange(N).cached())
    got = mapped(lambda v, w: v + w, np.float64, a, other).numpy()
    assert (got == a.numpy() + np.arange(N)[::-1]).all()


def test_draws_are_those_of_their_blocks(spark):
    """Values, as before, are those of a generator for each block; partitions don't matter."""
    key = np.random.default_rng(7).integers(0, 2**31 - 1, 4).tolist()
    blocks = [np.random.Generator(np.random.PCG64(np.random.SeedSequence([*key, k]))).gamma(2.0, 1.5, size=min(65536, N - k * 65536)) for k in range(2)]
    a = la.random.default_rng(7).gamma(2.0, 1.5, size=N)
    assert (a.numpy() == np.concatenate(blocks)).all()
    assert a.df.repartition(7).agg(F.count_distinct("i")).first()[0] == N


@pytest.mark.parametrize("n", [65_537, 100_000, 99_991, 1_000_003])
def test_permutation_functions(n):
    """Each place once, and back; nothing like the order before, for neighbours and across seeds."""
    x = np.arange(n)
    one, two = Permuted(n, 1), Permuted(n, 2)
    p = one.at(x)
    assert (np.bincount(p, minlength=n) == 1).all()
    assert (one.to(p) == x).all()
    for y in (x, np.roll(p, 1), two.at(x)):
        assert abs(np.corrcoef(p, y)[0, 1]) * n**0.5 < 5
    assert abs((np.diff(p) > 0).mean() - 0.5) * n**0.5 < 5
    assert (p == x).sum() < 12


def test_large_permutations_take_no_shuffle(spark, column):
    """They were sorted by a random key, joined with the cells and joined again with what stands beside them."""
    g = lambda: la.random.default_rng(5)
    y = la.tile(column, 4)
    for a in (g().permutation(N) / N, g().shuffle(la.arange(N)) / N):
        both = mapped(lambda v, w: F.struct(v.alias("x"), w.alias("y")), np.float64, a, y).df
        assert "Join" not in plan(both)
        assert plan(both).count("Exchange") == plan(y.df).count("Exchange")
        got = both.select("v.x").toPandas().x
        assert sorted(got) == (np.arange(N) / N).tolist()
    held = local(np.arange(N, dtype=np.int64) * 3)
    assert (g().permutation(held).numpy() == g().permutation(N).numpy() * 3).all()
    rows = la.reshape(held, (-1, 2))
    p = g().permutation(rows).numpy()
    assert (p[:, 1] == p[:, 0] + 3).all() and (np.sort(p[:, 0]) == np.arange(0, 3 * N, 6)).all()
    chosen = g().choice(N, 70_000, replace=False).numpy()
    assert len(np.unique(chosen)) == 70_000 and (chosen == g().permutation(N).numpy()[:70_000]).all()
