"""Connected components by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarray.llm.common import discard, materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        differ = p != q
        if not differ.any():
            break
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _local(batches):
    batches = list(batches)
    if batches:
        table = pa.Table.from_batches(batches)
        a, b = forest(table["a"].to_numpy(), table["b"].to_numpy())
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: Edges that one task joins at once, where no more are left.
ONE_TASK = 1 << 20


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (the least node it reaches) of every node in `edges` (a, b: long, not null).

    Each round replaces a partition's edges by a forest of stars, then links neighbours to the least
    node near them, until nothing changes; the rounds needed grow with the logarithm of the longest
    path.  Every round is written to the shared folder; no edge comes to the driver.  As soon as no
    more than `one_task` edges are left, counted each time, one task joins them.
    """
    stars = materialise(edges.select("a", "b").where("a <> b").mapInArrow(_local, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        if (seen[0] if seen else stars.count()) <= one_task:
            old, stars = stars, materialise(stars.coalesce(1).mapInArrow(_local, "a long, b long"), "edges")
            discard(old)
            break
        # large star: the greater neighbours of a node go to the least node near it
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.mapInArrow(_local, "a long, b long").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        old, stars = stars, materialise(small.distinct(), "edges")
        discard(old)
        # done when every edge leads from a node with one edge to a node that leads nowhere
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
