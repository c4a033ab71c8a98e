"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import gc
import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from concurrent.futures import ThreadPoolExecutor

    from loomarray.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def differs(name):
        try:
            got, expected = QUERIES[name](spark, DATA).toPandas(), con.cursor().execute(SQL[name]).df()
            columns = sorted(got.columns)
            if columns != sorted(expected.columns) or len(got) != len(expected):
                return name, "columns or rows", len(got), len(expected)
            got, expected = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expected))
            same = (got == expected) | (got.isna() & expected.isna())
            return None if same.all().all() else (name, (~same.all(axis=1)).sum())
        except Exception as problem:  # noqa: BLE001 - reported at the end
            return name, str(problem)[:300]

    alone = [n for n in SQL if n.startswith(("random_", "question_"))]  # they use what the process has once
    wrong = [*map(differs, alone)]
    rest = [n for n in SQL if n not in alone]
    for k in range(0, len(rest), 100):  # what a hundred leave behind goes before the next
        with ThreadPoolExecutor(4) as pool:
            wrong += pool.map(differs, rest[k : k + 100])
        spark.catalog.clearCache()
        gc.collect()
        spark._jvm.System.gc()
    assert not [w for w in wrong if w], [w for w in wrong if w]


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_angle_of_negative_zero(spark, tmp_path):
    """A balance of -0.0, which large tables have, is not below 0 for the SQL, nor is NaN; the function itself keeps NumPy's pi and NaN."""
    duckdb = pytest.importorskip("duckdb")
    import numpy as np

    import loomarray as la
    from loomarray.plans.queries import QUERIES, SQL

    spark.createDataFrame([(k, x) for k, x in enumerate([-0.0, 0.0, -1.5, 2.5, None, float("inf"), float("-inf"), float("nan")])], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    customer = duckdb.read_parquet(f"{tmp_path}/customer.parquet/*.parquet")  # noqa: F841 - the SQL reads it
    got = [tuple(r) for r in QUERIES["ufunc_angle"](spark, str(tmp_path)).orderBy("c_custkey").collect()]
    assert got == sorted(duckdb.sql(SQL["ufunc_angle"]).fetchall())
    assert np.array_equal(la.angle(np.array([-0.0, 0.0, np.nan])).numpy(), [np.pi, 0.0, np.nan], equal_nan=True)
