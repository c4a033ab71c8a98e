"""As-of merges: each value finds the edges next to it, both spread over ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomarray.cells import _cuts, _dealt, session

#: Edges up to this many are literals in the plan, searched by halves; more are merged with the values.
LITERAL = 1024


def found(edges: Column, n: int, value: Column, right: bool) -> Column:
    """How many of the ascending literal `edges` (an array of n) are below a value, or up to it (`right`), by halves."""
    steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1))) if n else F.array().cast("array<int>")
    passed = (lambda e: e <= value) if right else (lambda e: e < value)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(passed(F.get(edges, at + s - 1)), at + s).otherwise(at))


def asof(values: DataFrame, edges: DataFrame, n: int, right: bool, sides: bool = False) -> DataFrame:
    """`values` (x, more) with `_before`: how many edges (x, y) are below x, or up to it (`right`).

    With `sides`, also `_prev` and `_next`, the edge before and the one after (structs of x and y, null
    where there is none).  `n` is about the number of rows of both.  Rows go to ranges of x by cuts of a
    bounded sample, so that a range is a window; what a range has no edge for, it takes from the ranges
    before and after it, of which the driver knows the count and the outer edges.  Rows that equal a cut
    which fills several ranges are spread over them: all they need is what the ranges before have.
    """
    more = [c for c in values.columns if c != "x"]
    side = lambda df, edge: df.select("x", *([F.col(c) for c in more] if not edge else [F.lit(None).cast(values.schema[c].dataType).alias(c) for c in more]), F.lit(edge).alias("_edge"), (F.struct("x", "y") if edge else F.lit(None).cast(edges.select(F.struct("x", "y").alias("e")).schema["e"].dataType)).alias("_e"))
    rows = side(values, False).unionByName(side(edges, True))
    key = F.col("x")
    kind = rows.schema["x"].dataType
    cuts, times = _cuts(rows.select(key.alias("k")), max(n, 1))
    dealt, _ = _dealt(rows, key, kind, cuts, times, F.xxhash64(*(F.col(f"`{c}`") for c in [*more, "x", "_edge"])))
    alone, at = {}, 1  # ranges of what equals a cut, by their number; range 0 is what is below all cuts
    for u, w in enumerate(times):
        for r in range(at, at + w):
            alone[r] = u
        at += w + 1
    groups = {r: (1, u) if (u := alone.get(r)) is not None else (0, r) for r in range(at)}
    known = {r["_range"]: r for r in dealt.where("_edge").groupBy("_range").agg(F.count("*").alias("n"), F.min("_e").alias("lo"), F.max("_e").alias("hi")).collect()}
    # what stands before a group of ranges, in it, and after it
    order = list(dict.fromkeys(groups[r] for r in range(at)))
    inside = {g: [known[r] for r in range(at) if groups[r] == g and r in known] for g in order}
    before, prev, rows_ = 0, None, {}
    for g in order:
        n_in = sum(r["n"] for r in inside[g])
        rows_[g] = [before, n_in, prev, None, max((r["hi"] for r in inside[g]), default=None)]
        before, prev = before + n_in, max((r["hi"] for r in inside[g]), default=prev)
    after = None
    for g in reversed(order):
        rows_[g][3] = after
        after = min((r["lo"] for r in inside[g]), default=after)
    edge_kind = dealt.schema["_e"].dataType.simpleString()
    table = session().createDataFrame([(r, g[0] == 1, *rows_[g]) for r, g in groups.items()], f"_range int, _alone boolean, _b long, _n long, _p {edge_kind}, _a {edge_kind}, _own {edge_kind}")
    w = Window.partitionBy("_range").orderBy("x", F.col("_edge") if not right else ~F.col("_edge"), "_e")
    own = F.sum(F.col("_edge").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_c", own)
    if sides:
        out = out.withColumn("_l", F.last("_e", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_f", F.first("_e", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    out = out.where(~F.col("_edge")).join(F.broadcast(table), "_range")  # a row a range, of which there are at most 2 * RANGES
    count = F.col("_b") + F.when(F.col("_alone"), F.col("_n") if right else F.lit(0)).otherwise(F.col("_c"))
    picks = [count.alias("_before")]
    if sides:
        here = F.col("_own") if right else F.lit(None)
        picks.append(F.when(F.col("_alone"), F.coalesce(here, "_p") if right else F.col("_p")).otherwise(F.coalesce("_l", "_p")).alias("_prev"))
        picks.append(F.when(F.col("_alone"), F.col("_a") if right else F.coalesce("_own", "_a")).otherwise(F.coalesce("_f", "_a")).alias("_next"))
    return out.select("x", *more, *picks)
