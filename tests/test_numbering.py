"""Places of rows: right with any number of partitions, and only computed where they are needed."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import loomarray as la
from loomarray import cells
from loomarray.cells import from_column, from_columns, numbered


@pytest.fixture(params=["adaptive", "eight partitions"])
def plain(spark, request, monkeypatch):
    """Many ranges, with partitions folded by the adaptive planner and without."""
    monkeypatch.setattr(cells, "IN_A_WINDOW", 4000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    if request.param != "adaptive":
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def table(spark, n=40_000):
    hashed = F.xxhash64("id")
    odd = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 1000 == 1, float("nan")).when(F.col("id") % 1000 == 2, float("-inf")).otherwise((hashed % 10007).cast("double"))
    return spark.range(n).repartition(5).select("id", odd.alias("x"), (hashed % 11).alias("few"), F.when(hashed % 5 > 0, F.concat(F.lit("s"), (hashed % 997).cast("string"))).alias("s"))


@pytest.mark.parametrize("order", [["id"], ["x", "id"], ["few", "id"], ["s", "id"], ["few", "x", "id"]])
def test_places(plain, order):
    df = table(plain)
    out, n = numbered(df, *order, name="place")
    assert n == 40_000
    got = out.select("place", *order).toPandas().sort_values("place")
    assert (got.place.to_numpy() == np.arange(n)).all()
    rows = [tuple((x is not None, math.isnan(x) if isinstance(x, float) else False, 0 if isinstance(x, float) and math.isnan(x) else x or 0 if not isinstance(x, str) else x) for x in r) for r in got[order].astype(object).where(got[order].notna() | got[order].map(lambda v: isinstance(v, float)), None).itertuples(index=False)]
    if "s" in order:
        rows = [((r[0][0] and isinstance(r[0][2], str), str(r[0][2]) if isinstance(r[0][2], str) else ""), *r[1:]) for r in rows]
    assert rows == sorted(rows)


def test_places_agree_between_runs(plain):
    df = table(plain, 30_000)
    out, _ = numbered(df, "few", "id", name="place")
    a = out.select(F.col("id").alias("a"), "place").join(out.select(F.col("id").alias("b"), "place"), "place")
    assert a.where("a <> b").count() == 0 and a.count() == 30_000


def test_rows_alike_and_frequent_keys(plain):
    df = plain.range(50_000).select(F.lit(1).alias("x"))
    out, _ = numbered(df, "x", name="place")
    assert out.agg(F.count_distinct("place"), F.max("place")).first()[:] == (50_000, 49_999)
    df = plain.range(50_000).select((F.col("id") % 2).alias("x"), "id")
    out, _ = numbered(df, "x", name="place")
    assert out.agg(F.count_distinct("place"), F.max(F.when(F.col("x") == 0, F.col("place"))), F.min(F.when(F.col("x") == 1, F.col("place")))).first()[:] == (50_000, 24_999, 25_000)


def test_sorts_and_sets(plain):
    x = np.random.default_rng(2).integers(0, 30_000, 40_000)
    a = cells.local(x)
    assert (la.sort(a).numpy() == np.sort(x)).all()
    assert (la.argsort(a).numpy() == np.argsort(x, kind="stable")).all()
    assert (la.unique(a).numpy() == np.unique(x)).all()
    assert (la.flatnonzero(a > 15_000).numpy() == np.flatnonzero(x > 15_000)).all()
    y = np.sort(x[:9000])
    assert (la.searchsorted(y, a).numpy() == np.searchsorted(y, x)).all()


def test_quantiles_by_ranges(plain, monkeypatch):
    from loomarray.operators import reductions as red

    monkeypatch.setattr(red, "GATHERED", 100)
    for x in (np.random.default_rng(3).normal(size=30_001), np.repeat([3.0, 1.0, 2.0], 9000)):
        assert np.allclose(la.quantile(cells.local(x), [0.0, 0.1, 0.5, 0.99, 1.0]).numpy(), np.quantile(x, [0.0, 0.1, 0.5, 0.99, 1.0]))
    assert math.isnan(la.median(cells.local(np.array([1.0, np.nan] * 9000))).item())


def test_columns_are_numbered_only_where_places_count(spark):
    df = table(spark, 5000)
    plan = lambda a: a.df._jdf.queryExecution().optimizedPlan().toString()
    a, b = from_columns(df, ["x", "few"], ["id"])
    for f in (la.sum(a), la.max(a * 2), la.mean(a + b), la.unique(b), la.any(la.isnan(a)), la.count_nonzero(a)):
        assert "Window" not in plan(f) or f.ndim, plan(f)
    assert "Window" in plan(la.cumsum(b))
    got = (a + b).numpy()
    rows = df.orderBy("id").toPandas()
    assert np.allclose(got, rows.x + rows.few, equal_nan=True)
    assert la.argmax(from_column(df, "few", ["id"])).item() == int(rows.few.argmax())


def test_element_methods(spark):
    x = np.arange(12.0).reshape(3, 4)
    a = cells.local(x)
    assert (a.row(1).numpy() == x[1]).all() and (a.col(-1).numpy() == x[:, -1]).all()
    assert (a.rows(1, 3).numpy() == x[1:3]).all() and (a.cols(0, 2).numpy() == x[:, :2]).all()
    assert a.get([2, -1]) == 11.0 and a.iget(5) == 5.0 and a.toArray() == x.tolist()
    b = a.set([0, -1], 9.5).iset(4, -1.0)
    assert b.numpy().tolist() == [[0, 1, 2, 9.5], [-1, 5, 6, 7], [8, 9, 10, 11]] and a.get([0, 3]) == 3.0
    assert cells.local(np.array([1, 2])).set([0], 2.5).tolist() == [3, 2] and cells.local(np.array([True, False])).set([1], 3).tolist() == [True, True]
    for bad in ([0], [3, 0], [0, -5]):
        with pytest.raises(IndexError):
            a.get(bad)
    with pytest.raises(ValueError):
        a.row(0).row(0)
    with a.using() as kept:
        assert kept.frame.is_cached and kept.sum().item() == 66.0
    assert not kept.frame.is_cached and kept.sum().item() == 66.0
    a.dispose()


def test_views_of_other_widths(spark):
    x = np.arange(16, dtype=np.uint8).reshape(2, 8)
    for d in (np.uint16, np.int32, np.float64, np.complex128 if x.shape[1] % 16 == 0 else np.int64):
        assert (cells.view(cells.local(x), d).numpy() == x.view(d)).all()
    y = np.array([[1.5, -2.0]])
    assert (cells.view(cells.view(cells.local(y), np.int16), np.float64).numpy() == y).all()
    with pytest.raises(ValueError):
        cells.view(cells.local(x[:, :3].copy()), np.int16)


def test_large_weighted_draws_without_replacement(spark, monkeypatch):
    from loomarray.operators import random as rn

    monkeypatch.setattr(rn, "BLOCK", 100)
    w = np.arange(1000.0)
    got = rn.default_rng(1).choice(1000, 400, replace=False, p=w / w.sum()).numpy()
    assert len(set(got.tolist())) == 400 and 0 not in got and got.mean() > 550
    assert (rn.default_rng(1).choice(1000, 400, replace=False, p=w / w.sum()).numpy() == got).all()
