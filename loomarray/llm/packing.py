"""Operator 10: packing documents into few sequences by linear grouping."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomarray.llm.common import id_text, materialise, texts_of
from loomarray.llm.tokens import Ids

#: Pieces of one length that one window ranks, about; runs of a plan that is broadcast.
WINDOW, FEW_RUNS = 1 << 19, 1 << 18

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Encode every whole text, append `end_id`, cut what is longer than `capacity`: one row a piece."""

    def encode(batches):
        ids_of, end = Ids(path), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for k in range(0, len(texts), 1024):
                out = [(d, at // step, at // 4, len(part) // 4, zlib.crc32(part)) for d, data in zip(doc_ids[k : k + 1024], ids_of(texts[k : k + 1024]), strict=True) for whole in (data + end,) for at in range(0, len(whole), step) for part in (whole[at : at + step],)]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(encode, PIECES)


class Bins:
    """Runs of equal sequences: how many, their contents as (length, first rank), and their slack."""

    def __init__(self):
        self.runs: list[tuple[int, tuple]] = []  # (count, ((length, first rank), ...))

    @property
    def count(self) -> int:
        return sum(n for n, _ in self.runs)


def fill(sizes: list[int], have: list[int], room: int) -> list[int]:
    """Indices (repeats allowed up to `have`) of the sizes that fill `room` best: a bounded subset sum in bit sets."""
    reach, layers = 1, []
    full = (1 << (room + 1)) - 1
    for s, n in zip(sizes, have, strict=True):
        layers.append(reach)
        left, k = min(n, room // s if s else 0), 1
        while left > 0:  # binary splitting
            k = min(k, left)
            reach |= (reach << (s * k)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, []
    for i in range(len(layers) - 1, -1, -1):
        while not layers[i] >> best & 1:
            chosen.append(i)
            best -= sizes[i]
    return chosen


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """How often to take each size so that `capacity` holds the most value: an unbounded knapsack by size."""
    best = np.zeros(capacity + 1)
    for s, v in zip(sizes.tolist(), value.tolist(), strict=True):
        if v > 0:
            for at in range(s, capacity + 1, s):
                part = best[at : at + s]
                np.maximum(part, best[at - s : at][: len(part)] + v, out=part)
    best = np.maximum.accumulate(best)
    use, room = np.zeros(len(sizes), np.int64), capacity
    while room >= sizes.min():
        fits = np.flatnonzero((sizes <= room) & (value > 0))
        i = fits[np.argmax(best[room - sizes[fits]] + value[fits])] if len(fits) else -1
        if i < 0 or best[room - sizes[i]] + value[i] < best[room] - 1e-12:
            break
        use[i] += 1
        room -= int(sizes[i])
    return float(value @ use), use


def configurations(sizes: list[int], have: list[int], capacity: int, most: int = 400) -> list[tuple[list[int], int]]:
    """Configurations (indices of sizes, repeats allowed) and how often to use each, so that few sequences hold all.

    The linear programme over all configurations is solved by column generation: the prices of the sizes
    under the configurations in use say, through a knapsack, which configuration to bring in.  At most as many
    configurations as sizes are in use; each is used as often as the whole part of its share says, and the
    little that is left is packed by filling the largest size's rest best, again and again.
    """
    size, n = np.array(sizes), np.array(have, float)
    k = len(sizes)
    if not k:
        return []
    basis = np.diag(capacity // size).astype(float)  # a column a configuration: one size alone
    share = n / (capacity // size)
    for _ in range(most):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, use = best_pattern(size, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, use.astype(float))
        can = np.flatnonzero(step > 1e-9)
        ratio = share[can] / step[can]
        out = int(can[np.argmin(ratio)])
        times = float(ratio.min())
        share = np.maximum(share - times * step, 0)
        share[out] = times
        basis[:, out] = use
    left, found = list(have), []
    for column, x in zip(basis.T.astype(np.int64), share, strict=True):
        x = min([int(x + 1e-6), *(left[i] // int(column[i]) for i in np.flatnonzero(column))])
        if x > 0:
            found.append(([int(i) for i in np.repeat(np.arange(k), column)], x))
            for i in np.flatnonzero(column):
                left[i] -= int(column[i]) * x
    first = 0
    while True:
        while first < k and not left[first]:
            first += 1
        if first == k:
            return found
        left[first] -= 1
        near = [i for i in range(first, k) if left[i] and sizes[i] <= capacity - sizes[first]]
        config = [first, *(near[i] for i in fill([sizes[i] for i in near], [left[i] for i in near], capacity - sizes[first]))]
        left[first] += 1
        uses = {i: config.count(i) for i in config}
        times = min(left[i] // c for i, c in uses.items())
        for i, c in uses.items():
            left[i] -= c * times
        found.append((config, times))


def linear_grouping(hist: dict[int, int], capacity: int, groups: int, small: int) -> Bins:
    """Pack a histogram of lengths (1 .. capacity).

    1. Lengths over `small` are dealt into `groups` groups of equal cardinality, and each is rounded
       up to the largest of its group.
    2. Configurations of these few sizes, and how often each is used, by `configurations`.
    3. The group's documents take the places of the rounded sizes, in order of length, so equal
       sequences stay runs.
    4. What is small goes where the least room is left that suffices, longest first.

    Only the histogram matters, so the work has a bound that does not depend on the number of
    documents, and so has the number of runs: one a configuration, and one more wherever the length at
    one of its places changes.
    """
    large = sorted((s for s in hist if s > small), reverse=True)
    total = sum(hist[s] for s in large)
    taken = dict.fromkeys(hist, 0)
    bins = Bins()
    # groups of equal cardinality: [rounded size, [(length, first rank, count), ...] longest first]
    dealt: list[list] = []
    if total:
        share, room = -(-total // groups), 0
        for s in large:
            left, rank = hist[s], 0
            while left:
                if not room:
                    dealt.append([s, []])
                    room = share
                n = min(left, room)
                dealt[-1][1].append((s, rank, n))
                rank, left, room = rank + n, left - n, room - n
    # groups that round to one size are one
    merged: dict[int, list] = {}
    for s, parts in dealt:
        merged.setdefault(s, []).extend(parts)
    sizes = sorted(merged, reverse=True)
    have = [sum(n for *_, n in merged[s]) for s in sizes]
    queues = [list(reversed(merged[s])) for s in sizes]  # the longest first, taken from the end
    for config, times in configurations(sizes, have, capacity):
        while times:  # substitute documents; a run lasts while no place changes its length
            heads, counts = [], {}
            for i in config:
                counts[i] = counts.get(i, 0) + 1
            n = times
            for i, k in counts.items():
                n = min(n, max(1, queues[i][-1][2] // k))
            for i in config:
                s, rank, m = queues[i].pop()
                if m < n:  # fewer than the run needs: only where n is 1 can that be
                    raise AssertionError
                heads.append((s, rank))
                if m > n:
                    queues[i].append((s, rank + n, m - n))
            bins.runs.append((n, tuple(heads)))
            times -= n
    # best fit of the small ones
    by_room: dict[int, list] = {}
    for n, heads in bins.runs:
        by_room.setdefault(capacity - sum(s for s, _ in heads), []).append((n, heads))
    rooms = sorted(by_room)
    for s in sorted((s for s in hist if s <= small), reverse=True):
        left, rank = hist[s], taken[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                many, rest = divmod(left, per)
                for n, k in ((many, per), (1, rest)):
                    if n and k:
                        heads = tuple((s, rank + j * n) for j in range(k))
                        rank += n * k
                        room = capacity - k * s
                        if room not in by_room:
                            bisect.insort(rooms, room)
                        by_room.setdefault(room, []).append((n, heads))
                left = 0
                break
            room = rooms[at]
            n, heads = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            k = max(1, min(room // s, left // n)) if left >= n else 1
            use = min(n, left)
            put = [(use, (*heads, *((s, rank + j * use) for j in range(k))), room - k * s)]
            if use < n:
                put.append((n - use, tuple((a, b + use) for a, b in heads), room))
            rank, left = rank + use * k, left - use * k
            for m, h, r in put:
                if r not in by_room:
                    bisect.insort(rooms, r)
                by_room.setdefault(r, []).append((m, h))
    out = Bins()
    out.runs = [x for r in sorted(by_room) for x in by_room[r]]
    return out


#: Numbers of groups, and the parts of the capacity up to which lengths are small, that are tried.
GROUPS, SMALL = (48, 128), (4, 3, 2)


def plan(hist: dict[int, int], capacity: int) -> Bins:
    """The best of a few group counts and bounds of `small`: each costs only as the histogram is wide."""
    full = hist.get(capacity, 0)
    rest = {s: n for s, n in hist.items() if s < capacity and n}
    tries = [linear_grouping(rest, capacity, g, capacity // k) for g in GROUPS for k in SMALL] if rest else [Bins()]
    best = min(tries, key=lambda b: b.count)
    if full:
        best.runs.append((full, ((capacity, 0),)))
    return best


PLACES = T.StructType([T.StructField("length", T.LongType()), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("rank_from", "first_sequence", "offset"))])


def places(bins: Bins) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) of each run."""
    out, sequence = [], 0
    for n, heads in bins.runs:
        offset = 0
        for s, rank in heads:
            out.append((s, rank, rank + n - 1, sequence, offset))
            offset += s
        sequence += n
    return out


def by_length(runs: list[tuple[int, int, int, int, int]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """A row for each length: its runs' first ranks, ascending, and their sequences and offsets."""
    own: dict[int, list] = {}
    for s, a, _, sequence, offset in sorted(runs):
        own.setdefault(s, []).append((a, sequence, offset))
    return [(s, *map(list, zip(*rows, strict=True))) for s, rows in own.items()]


def ranked(pieces: DataFrame, by: str, order: list[str], salts: int) -> DataFrame:
    """`rank`: the place of a row among those of its `by`, from 0.

    A value is dealt over `salts` windows, more the more rows the most frequent has; the rows before each come from a table of counts
    with one row for each value and salt.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n")).select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(by, "_salt").orderBy(*order)
    return salted.withColumn("_own", F.row_number().over(own) - 1).join(counts, [by, "_salt"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the scheme finds.

    A document is its ids and then `end_id`; only documents longer than `capacity` are cut, into
    pieces of `capacity` (the last may be shorter).  Per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    The texts are read once and never shuffled: rows of lengths are written to the shared folder,
    a histogram (at most `capacity` rows) is planned on the driver, and each piece finds its place
    by its length and its rank among the pieces of that length: a binary search among the length's
    runs.  The plan has a row for each length; its runs are as many as `linear_grouping` says, however
    many documents there are, and only if they are few is it broadcast.

    A null or empty text is one piece of one token.  Null ids and repeated rows are pieces of
    their own; an empty table gives no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, path, capacity, end_id), "pieces")
    hist = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = by_length(places(plan(hist, capacity)))
    table = spark.createDataFrame(runs, PLACES)
    if sum(len(r[1]) for r in runs) <= FEW_RUNS:
        table = F.broadcast(table)
    most = max(hist.values(), default=0)
    at = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], max(64, -(-most // WINDOW))).join(table, "length")
    steps = F.array(*(F.lit(1 << k) for k in range(max((len(r[1]) for r in runs), default=1).bit_length() - 1, -1, -1)))
    run = F.aggregate(steps, F.lit(0), lambda k, s: F.when(F.get("rank_from", k + s - 1) <= F.col("rank"), k + s).otherwise(k)) - 1
    found = at.withColumn("run", run)
    of = lambda name: F.get(name, F.col("run"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (of("first_sequence") + F.col("rank") - of("rank_from")).alias("sequence_id"), of("offset").alias("offset"))
