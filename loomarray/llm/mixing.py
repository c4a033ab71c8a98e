"""Operator 5: mixing sources to target weights by pivotal rounding."""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray.llm.common import columns, free, id_text, materialise, texts_of

#: A word is a run of anything but these.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of a source that one task rounds before residuals are combined, and residuals combined at once.
LEAF, FAN = 2_000, 64
#: The shortest documents of a node, which take up what longer ones leave over and go up the tree.
RESERVE = 16


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of the whole text (null: 0)."""

    def count(batches):
        for batch in batches:
            n = pa.array([len(x.encode().split()) for x in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n], ["doc_id", "source", "size"])

    return id_text(docs, F.col("source").cast("string").alias("source")).mapInArrow(count, "doc_id long, source string, size long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, float]:
    """Words that the mix takes of each source.

    Sources stand by code point, null last, and weigh `weights` over and over; they share the sum
    of all sizes.  A source stops at `most` times its size, and its excess is shared again by
    weight among those below, until none is above.  Exact fractions, so the order of sums doesn't
    matter.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, all_w, out = sum(sizes.values()), sum(weight.values()), {}
    # those that reach their limit first, in one pass: each that stops leaves more for the others
    for s in sorted(order, key=lambda s: Fraction(most * sizes[s], weight[s])):
        if left * weight[s] > most * sizes[s] * all_w:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
            all_w -= weight[s]
        else:
            out[s] = None
    return {s: float(Fraction(left * weight[s], all_w)) if t is None else t for s, t in out.items()}


def pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """Pivotal rounding in the given order: (rounded, place of the one left over or -1, its p).

    Two fractional probabilities at a time: mass moves between them, to one side or the other at
    random, until one is 0 or 1.  The sum of size x p never changes and no p changes in expectation.
    """
    out, held, q = np.zeros(len(p)), -1, 0.0
    coins = rng.random(len(p))
    s = size.tolist()
    for i, (x, coin) in enumerate(zip(p.tolist(), coins.tolist(), strict=True)):
        if x <= 1e-12 or x >= 1 - 1e-12:
            out[i] = round(x)
            continue
        if held < 0:
            held, q = i, x
            continue
        a, b = s[held], s[i]
        up = min((1 - q) * a, x * b)  # words that can move from i to the one held
        down = min(q * a, (1 - x) * b)
        move = up if coin * (up + down) < down else -down
        q, x = q + move / a, x - move / b
        for k, y in ((held, q), (i, x)):
            if y <= 1e-9 or y >= 1 - 1e-9:
                out[k] = round(y)
        free = [(k, y) for k, y in ((held, q), (i, x)) if 1e-9 < y < 1 - 1e-9]
        held, q = free[0] if free else (-1, 0.0)
    return out, held, q


def settle(a: int, q: float, size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> float:
    """Pair one document (size `a`, probability `q`) with a group, in place: mass moves between it and the
    group, whose probabilities all change by the same, until it is 0 or 1 or the group has nothing to give.

    Each move goes as far as it can in the direction drawn, so that something becomes integral; the sum of
    size x p never changes, and no p changes in expectation.
    """
    while 1e-9 < q < 1 - 1e-9:
        free_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        total = float(size[free_].sum())
        if not total:
            break
        up = min((1 - q) * a, float(p[free_].min()) * total)  # words that can move to it
        down = min(q * a, float(1 - p[free_].max()) * total)
        move = up if rng.random() * (up + down) < down else -down
        q += move / a
        p[free_] -= move / total
    return q


def nearer(size: np.ndarray, copies: np.ndarray, miss: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """`copies` with what is missed (words taken too many) made smaller: one or two documents at a time have one
    copy more or less, within `low` and `high`, those that leave the least, as long as that helps."""
    copies, n = copies.copy(), len(copies)
    for _ in range(4 * n):
        who = np.concatenate([np.flatnonzero(copies < high), np.flatnonzero(copies > low)])
        sign = np.where(np.arange(len(who)) < (copies < high).sum(), 1, -1)
        change = sign * size[who]
        order = np.argsort(change, kind="stable")
        best = (abs(miss), None)
        for shift in (0, 1):  # a second one whose change is next to what is wanted, on either side
            if not len(who):
                break
            at = order[np.clip(np.searchsorted(change[order], -miss - change) - shift, 0, len(who) - 1)]
            two = np.where(who[at] == who, np.inf, np.abs(miss + change + change[at]))
            for value, pair in ((np.abs(miss + change), False), (two, True)):
                if value.min() < best[0] - 1e-9:
                    i = int(value.argmin())
                    best = (float(value[i]), [i, int(at[i])] if pair else [i])
        if best[1] is None:
            break
        for i in best[1]:
            copies[who[i]] += sign[i]
            miss += float(change[i])
    return copies


#: Documents whose copies `reached` tries in all numbers, the shortest ones, and words that these may have.
FEW, WORDS = 48, 1 << 22


def reached(size: np.ndarray, copies: np.ndarray, miss: float, most: int) -> np.ndarray:
    """`copies` with the least miss that 0 to `most` copies of each of the FEW shortest documents can reach.

    The sums that the first k documents can make are the bits of a number; the way back gives the copies.
    """
    who = np.flatnonzero(size > 0)
    who = who[np.argsort(size[who], kind="stable")][:FEW]
    who = who[: int(np.searchsorted(np.cumsum(size[who]) * most, WORDS, side="right"))]
    if not len(who):
        return copies
    want = max(0, round(float((size[who] * copies[who]).sum()) - miss))
    sums = [1]
    for n in size[who].tolist():
        line = sums[-1]
        for k in range(1, most + 1):
            line |= sums[-1] << k * n
        sums.append(line)
    above, below = sums[-1] >> want, sums[-1] & ((1 << want) - 1)
    up = want + (above & -above).bit_length() - 1 if above else None
    down = below.bit_length() - 1 if below else None
    at = min((x for x in (up, down) if x is not None), key=lambda x: abs(x - want))
    if abs(miss) <= abs(at - float((size[who] * copies[who]).sum()) + miss) + 1e-9:
        return copies
    out = copies.copy()
    for i, line in zip(who[::-1], sums[-2::-1], strict=True):
        n = int(size[i])
        out[i] = next(k for k in range(most + 1) if at >= k * n and line >> at - k * n & 1)
        at -= int(out[i]) * n
    return out


def whole(p: np.ndarray) -> np.ndarray:
    """What is within rounding error of 0 or 1."""
    return (p <= 1e-9) | (p >= 1 - 1e-9)


KINDS = "doc_id long, source string, size long, source_size long, target double, copies long, p double, node long"


def rounded(seed: int, level: int, last: bool, most: int):
    """For one node of the tree: integral copies.

    The longest documents, with half of all words, are rounded by pairs; the one left over is paired with
    the shorter ones as a group.  These are halved in turn, until RESERVE documents are left, which keep
    their `p` and go up.  At the root it goes on to the very last, which is rounded to the nearer side.
    """
    least = 1 if last else RESERVE

    def node(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        source, at = table["source"][0].as_py(), table["node"][0].as_py()
        rng = np.random.default_rng([seed, level, at & 0xFFFFFFFF, *(source or "\0").encode()])
        p, size = table["p"].to_numpy(zero_copy_only=False).copy(), table["size"].to_numpy()
        first = p.copy()
        open_ = np.flatnonzero(~whole(p))
        while len(open_) > least:
            upto = np.cumsum(size[open_])
            n = min(int(np.searchsorted(upto, upto[-1] / 2)) + 1, len(open_) - least)
            head, rest = open_[:n], open_[n:]
            p[head], held, q = pivot(size[head], p[head], rng)
            if held >= 0:
                own = p[rest]
                p[head[held]] = settle(int(size[head[held]]), q, size[rest], own, rng)
                p[rest] = own
            open_ = rest[~whole(p[rest])]
        if last:
            p = np.round(p)
        done = whole(p)
        copies = table["copies"].to_numpy() + np.where(done, np.round(p), 0).astype(np.int64)
        if last:
            had = table["copies"].to_numpy()
            for low, high in ((had, had + ~whole(first)), (0, np.where(size > 0, most, 0))):  # the second where the first can't do
                miss = float((size * (copies - had - first)).sum())
                if abs(miss) >= max(1, size[size > 0].min(initial=1)):
                    copies = nearer(size, copies, miss, low + 0 * copies, high + 0 * copies)
            miss = float((size * (copies - had - first)).sum())
            if abs(miss) >= 1:
                copies = reached(size, copies, miss, most)
        rest = np.where(done, np.nan, p)
        put = lambda t, name, a: t.set_column(t.schema.get_field_index(name), name, a)
        return put(put(table, "copies", pa.array(copies, pa.int64())), "p", pa.array(rest, pa.float64(), mask=np.isnan(rest)))

    return node


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 5) -> DataFrame:
    """Mix all documents: how many copies of each the mix holds, so that sources meet their targets.

    Every document of a source has the same fractional number of copies, target / source_size, at
    most `most`.  The fraction is rounded by pivotal dependent rounding: within leaves of a source
    (its rows dealt by a hash of doc_id, so a source of any size is many leaves), then among what
    the leaves leave over, some 16 of their shortest documents each, up a tree of fan-in 64; the last one
    of a source is rounded to the nearer side.  Where that misses by more than its shortest document, a few
    documents of the root have one copy more or less; and where a word or more is missed after that, the
    shortest of them get the copies, 0 to `most`, whose sum is the nearest that any numbers give (`reached`).

    Only one row a source comes to the driver.  Draws depend on the seed, the source and the node
    alone, so reruns agree.

    Per document: doc_id, source, size (words; null text: 0), source_size, target (of its source),
    copies, taken (copies x size).  Documents without words take none; a source without words has
    target 0.  A null source is a source; null ids and repeated rows are rounded like others; an
    empty table gives no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    rows = materialise(word_sizes(docs), "sizes")
    sums = {r.source: (r.size, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    goal = targets({s: n for s, (n, _) in sums.items()}, weights, most)
    leaves = max((-(-n // LEAF) for _, n in sums.values()), default=1)
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_leaves", T.LongType())])
    table = spark.createDataFrame([(s, n, goal[s], -(-m // LEAF)) for s, (n, m) in sums.items()], schema)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.least(share, F.lit(float(most))) + 1e-12)
    joined = (
        rows.join(table, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("copies", F.when(F.col("size") > 0, whole).otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(share - whole, F.lit(0.0))).otherwise(0.0))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "size"), F.col("_leaves")))
        .select(*(x.split()[0] for x in KINDS.split(", ")))
    )
    level, parts = 0, []
    while True:
        done = leaves == 1
        joined = materialise(joined.groupBy("source", "node").applyInArrow(rounded(seed, level, done, most), KINDS), "rounded")
        parts.append(joined.where(F.col("p").isNull()))
        if done:
            break
        leaves, level = -(-leaves // FAN), level + 1
        joined = joined.where(F.col("p").isNotNull()).withColumn("node", F.floor(F.col("node") / FAN))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 5) -> DataFrame:
    """The rows of `docs`, whole, each as often as the mix holds it.

    Rows of one doc_id count as one document here: all of them stand as often as the first of them
    is taken.  A row without a doc_id goes by what is taken of such rows.  Texts without words are not
    taken.  Columns of any name come through unchanged; an empty table gives no rows.
    """
    id_, times, copy = free(docs, "id", "copies", "copy")
    copies = mix(docs, weights, most, seed).groupBy("doc_id").agg(F.max("copies").alias(times)).withColumnRenamed("doc_id", id_)
    joined = docs.join(copies.where(F.col(times) > 0).hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*columns(docs))
