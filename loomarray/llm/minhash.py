"""Operator 4: near duplicates by MinHash with tensored banding."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarray.llm.common import discard, free, give_back, id_text, lean, materialise, partitions, turn_to_other_work
from loomarray.llm.components import components, forest
from loomarray.llm.hashing import U, mix
from loomarray.llm.shingles import shingle_sets

#: MinHash values joined into one entry of a collection; a table's key has one entry of each collection.
BAND = 3
#: Keys that two texts must have in common where nobody else has them, and the chance at most that a pair
#: right at the threshold has fewer in common altogether.
NEED, MISS = 4, 1e-5
#: Members of a cluster, and bytes of their sets, that one task compares at once; members that all its parts get.
CHUNK, CHUNK_BYTES, LEADERS = 2048, 32 << 20, 32
#: Bytes that a task of the last joins and comparisons reads, about.
TASK_BYTES = 64 << 20
#: Keys that meet in one bucket, about.
KEYS = 1 << 20
#: Texts hashed at once.
STEP = 512


def entries(percent: int) -> int:
    """Entries of each collection, so that a pair at the threshold has NEED keys in common with chance 1 - MISS at least."""
    p, m = (percent / 100) ** BAND, math.isqrt(NEED - 1) + 1
    while miss(p, m) > MISS:
        m += 1
    return m


def miss(p: float, m: int) -> float:
    """Chance that fewer than NEED keys agree: of two collections of `m` entries, each agreeing with chance `p`,
    as many keys agree as the numbers of entries that do, multiplied."""
    q = [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]
    return sum(x * y for a, x in enumerate(q) for b, y in enumerate(q) if a * b < NEED)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(4).integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def sketches(flat: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Two collections of `m` entries for each set: only 2 x m x BAND MinHash values for m x m tables."""
    out = np.zeros((len(starts), 2 * m), U)
    for j, a in enumerate(multipliers(2 * m * BAND)):
        k = j // BAND
        out[:, k] = mix(out[:, k] * U(3) + np.minimum.reduceat(flat * a, starts) + U(1))
    return out


def tensored(sketch: np.ndarray) -> np.ndarray:
    """The m x m keys of each set: every entry of the first collection with every one of the second."""
    m = sketch.shape[1] // 2
    number = np.arange(m * m, dtype=U).reshape(m, m) * U(0x9E3779B97F4A7C15)
    return mix((sketch[:, :m, None] * U(5) + sketch[:, None, m:]) ^ number).reshape(len(sketch), m * m)


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def links(unit: np.ndarray, sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one unit with 100 x intersection >= percent x union, on the full sets.

    `unit` ascends.  With `label`, only pairs of different labels count, and pairs that earlier ones
    already join may be left out.  Counts come from lists of the members that have a shingle.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    none = np.empty(0, np.int64)
    if not size.sum():
        return none, none
    own = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.lexsort((own, flat, unit[own]))
    own, flat = own[order], flat[order]
    new = np.ones(len(own), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (unit[own][1:] != unit[own][:-1])
    word = np.cumsum(new) - 1
    df = np.bincount(word)
    keep = df[word] > 1
    own, word = own[keep], word[keep]
    if not len(own):
        return none, none
    begin = np.searchsorted(word, np.arange(len(df)))  # of a word's members, in order
    place = np.arange(len(word)) - begin[word]  # members of the word before this one
    by = np.argsort(own, kind="stable")
    cut = np.searchsorted(own[by], np.arange(len(sets) + 1))
    first = np.searchsorted(unit, unit)
    left, right = [], []
    for i in range(len(sets)):
        mine = by[cut[i] : cut[i + 1]]
        n = place[mine]
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(begin[word[mine]] - (np.cumsum(n) - n), n) + np.arange(total)
        count = np.bincount(own[at] - first[i], minlength=1)
        other = size[first[i] : first[i] + len(count)]
        hit = np.flatnonzero(100 * count >= percent * (size[i] + other - count)) + first[i]
        hit = hit[count[hit - first[i]] > 0]
        if label is not None:
            hit = hit[label[hit] != label[i]]
        if len(hit):
            left.append(np.full(len(hit), i))
            right.append(hit)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _keys(batches, m: int, buckets: int):
    """Sketches of class representatives to keys, a value for each bucket: 6 bytes of key and the place of the id."""
    for batch in batches:
        ids = batch.column("rep").to_numpy()
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), U).reshape(len(ids), 2 * m)
        for at in range(0, len(ids), 2048):
            key = tensored(sketch[at : at + 2048])
            own = np.repeat(np.arange(len(key), dtype=np.uint16), key.shape[1])
            key = key.ravel()
            bucket = (key % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, key, own = bucket[order], key[order], own[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            six = np.ascontiguousarray(key.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:]
            who = ids[at : at + 2048].astype("<i8").tobytes()
            rows = [(int(bucket[a]), six[a:b].tobytes(), own[a:b].astype("<u2").tobytes(), who) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "own", "ids"])


def _meet(table: pa.Table) -> pa.Table:
    """Members of one key, to the least of them (columns a and b, n: how much the edge counts).

    A key that only two have counts one for their edge; one that more have joins them at once.
    """
    keys, ids = [], []
    for k, o, w in zip(table["keys"].to_pylist(), table["own"].to_pylist(), table["ids"].to_pylist(), strict=True):
        full = np.zeros((len(k) // 6, 8), np.uint8)
        full[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
        keys.append(full.reshape(-1).view("<u8"))
        ids.append(np.frombuffer(w, "<i8")[np.frombuffer(o, "<u2")])
    key, who = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(key)
    key, who = key[order], who[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(key)))
    least = np.repeat(np.minimum.reduceat(who, head), size)
    two, some = np.repeat(size == 2, size), who != least
    a, b = forest(who[some & ~two], least[some & ~two])
    x, y = who[some & two], least[some & two]
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(x)))
    return pa.table({"a": pa.array(np.concatenate([a, x[first]]), pa.int64()), "b": pa.array(np.concatenate([b, y[first]]), pa.int64()), "n": pa.array(np.concatenate([np.full(len(a), NEED), n]), pa.int64())})


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of word shingles link them: 100 x intersection >= percent x union.

    1. Every whole text is hashed once to its set of shingles; kept are its size, a digest and the
       MinHash entries of two small collections.  Equal sets are one class, with its least doc_id.
    2. Tensored banding: a table's key joins one entry of each collection.  Keys meet in buckets,
       and members of a key go to the least of them.  Two that meet alone must meet NEED times: that costs
       next to no recall and leaves most chance meetings out, so that clusters do not grow together through
       them.  Components of these candidates are clusters.
    3. The texts of cluster members are read again, and their full sets compared within the
       cluster: through lists of members by shingle, never by pairs of rows.  A cluster over CHUNK
       members or CHUNK_BYTES of sets is dealt over chunks, each with the same few leaders; whoever is then not in the
       cluster's main component is compared with every chunk, so every pair that is not joined yet
       is compared exactly.
    4. Components of the links.

    Two documents with similarity at the threshold become candidates with chance 1 - MISS at least; what
    becomes one is decided exactly (up to 64-bit hashes of shingles).

    Per document: doc_id, n_shingles, component_id (the least doc_id it reaches), kept (doc_id =
    component_id).  Empty and null texts have no shingles and link nothing.  Rows of one doc_id are one
    node, whatever their texts.  A null doc_id is alone: component_id null, kept true.  An empty table gives no rows;
    other columns are dropped.
    """
    spark = docs.sparkSession
    m = entries(percent)
    texts = id_text(docs)

    def sketch(batches):
        turn_to_other_work()
        for batch in batches:
            ids, data = batch.column("doc_id"), _bytes(batch.column("text"))
            n, digest, out = [], [], []
            for at in range(0, len(data), STEP):
                flat, count = shingle_sets(data[at : at + STEP], words)
                cut = np.cumsum(count)
                n.append(count)
                has = np.flatnonzero(count)
                rows = sketches(flat, (cut - count)[has], m) if len(has) else np.empty((0, 2 * m), U)
                found = dict(zip(has.tolist(), rows, strict=True))
                for i, (e, c) in enumerate(zip(cut.tolist(), count.tolist(), strict=True)):
                    digest.append(_digest(flat[e - c : e]) if c else None)
                    out.append(found[i].tobytes() if c else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.empty(0, np.int64), *n])), pa.array(digest, pa.binary()), pa.array(out, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])
            del data, n, digest, out
        give_back()

    hashed = materialise(texts.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, sketch binary"), "sketches")
    usable = hashed.where("doc_id is not null and digest is not null")
    classes = materialise(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("shingles"), F.any_value("sketch").alias("sketch")), "classes")
    buckets = partitions(spark)
    meeting = max(1, -(-classes.count() * m * m // KEYS))
    keyed = classes.select("rep", "sketch").mapInArrow(lambda batches: _keys(batches, m, meeting), "bucket int, keys binary, own binary, ids binary")
    met = keyed.groupBy("bucket").applyInArrow(lean(_meet), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    candidates = materialise(met.where(F.col("n") >= NEED).select("a", "b"), "candidates")
    clusters = components(candidates).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clustered = classes.select("digest", "rep", "shingles").join(clusters, "rep")
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("members"), (F.sum("shingles") * 8).alias("size"))
    parts = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("size") / CHUNK_BYTES)).cast("long")
    members = materialise(clustered.join(sizes, "cluster").select("digest", "rep", "cluster", "members", parts.alias("chunks"), "shingles"), "members")
    set_bytes = (members.agg(F.sum("shingles")).first()[0] or 0) * 8
    tasks = max(8 * buckets, -(-set_bytes // (TASK_BYTES // 8)))
    discard(candidates)

    def compute(batches):
        turn_to_other_work()
        for batch in batches:
            data, digest = _bytes(batch.column("text")), batch.column("digest").to_pylist()
            keep, sets = [], []
            for at in range(0, len(data), STEP):
                flat, count = shingle_sets(data[at : at + STEP], words)
                for i, s in enumerate(np.split(flat, np.cumsum(count)[:-1])):
                    if _digest(s) == digest[at + i]:  # rows of one id can have other texts
                        keep.append(at + i)
                        sets.append(s.tobytes())
            kept = batch.select(["rep", "cluster", "members", "chunks"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], ["rep", "cluster", "members", "chunks", "hashes"])

    n_texts = max(buckets, -(-(hashed.agg(F.sum("n_shingles")).first()[0] or 0) * 8 // TASK_BYTES))  # a shingle a word
    wanted = texts.repartition(n_texts, "doc_id").join(members.withColumnRenamed("rep", "doc_id").drop("shingles").hint("merge"), "doc_id").select(F.col("doc_id").alias("rep"), "cluster", "members", "chunks", "digest", "text")
    sets = materialise(wanted.mapInArrow(compute, "rep long, cluster long, members long, chunks long, hashes binary"), "sets")

    def deal(frame: DataFrame) -> DataFrame:
        """Units to tasks, many small ones to each; as many tasks as the bytes ask for."""
        return frame.withColumn("task", F.pmod(F.xxhash64("cluster", "chunk"), F.lit(tasks))).repartition(max(buckets, -(-set_bytes // TASK_BYTES)), "task")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("chunk", "ascending"), ("rep", "ascending")]).combine_chunks()
        keys = np.stack([table["cluster"].to_numpy(), table["chunk"].to_numpy()])
        unit = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))]) if table.num_rows else np.empty(0, np.int64)
        rep = table["rep"].to_numpy()
        label = table["label"].to_numpy() if "label" in table.column_names else None
        a, b = links(unit, [np.frombuffer(x, U) for x in table["hashes"].to_pylist()], percent, label)
        a, b = forest(rep[a], rep[b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    compare = lean(compare)
    chunks = F.col("chunks")
    own_chunk = F.pmod(F.xxhash64("rep"), chunks).cast("long")
    leads = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("members")) < LEADERS
    dealt = sets.withColumn("chunk", F.explode(F.when((chunks > 1) & leads, F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)).otherwise(F.array(own_chunk))))
    links_1 = materialise(deal(dealt).groupBy("task").applyInArrow(compare, "a long, b long"), "links")
    found, done = links_1, [sets, members]
    large = sets.where(chunks > 1)
    if not large.isEmpty():
        labels = components(links_1)
        labelled = materialise(large.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"), "labelled")
        by_label = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        main = by_label.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        mean = F.ceil(F.col("members") / chunks)  # members of a part
        sided = labelled.join(F.broadcast(main) if main.count() <= 10_000 else main, "cluster").withColumn("aside", F.col("label") != F.col("main"))
        rest = F.greatest(F.ceil((F.col("all") - F.col("most")) / mean), F.lit(1)).cast("long")  # parts of those aside
        part = F.pmod(F.xxhash64("rep", F.lit(2)), rest)
        # chunk numbers a pair (part of those aside, chunk of all members)
        column = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), rest.cast("long") - 1), lambda i: i * chunks + x)
        line = F.transform(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1), lambda i: part * chunks + i)
        both = F.array_distinct(F.concat(column(own_chunk), F.when(F.col("aside"), line).otherwise(F.array().cast("array<bigint>"))))
        again = sided.where("all > most").withColumn("chunk", F.explode(both.cast("array<bigint>"))).select("rep", "cluster", "chunk", "label", "hashes")
        links_2 = materialise(deal(again).groupBy("task").applyInArrow(compare, "a long, b long"), "links")
        found, done = links_1.unionByName(links_2), [*done, labelled]
    discard(*done)
    # rows of one doc_id in several classes, or in one and without shingles, are one node: edges join the classes
    repeated = hashed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = None
    if not repeated.isEmpty():
        stands = materialise(hashed.where("doc_id is not null").select("doc_id", "digest").join(repeated, "doc_id", "left_semi").distinct(), "stands")
        several = stands.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        same = stands.join(several, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = found.unionByName(same)
    joined = components(found).select(F.col("node").alias("rep"), "component")
    of_class = classes.select("digest", "rep").join(joined, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = hashed.drop("sketch").join(of_class, "digest", "left")
    if several is not None:  # their rows without shingles are in no class
        out = out.join(several.join(joined.withColumnRenamed("rep", "doc_id").withColumnRenamed("component", "own"), "doc_id"), "doc_id", "left")
        out = out.withColumn("component", F.coalesce("component", "own"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    out = materialise(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near-duplicates")
    discard(hashed, classes, *([stands] if several is not None else []))
    return out


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, whole, of one document of each near-duplicate group: that with the least doc_id.

    Rows of one doc_id are one document and stay or go together; rows without a doc_id stay, and so do
    null and empty texts, which are like nothing.  Columns of any name come through unchanged.  An empty
    table gives no rows.
    """
    (own,) = free(docs, "kept")
    kept = near_duplicates(docs, words, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").cast("long") == F.col(own), "left_semi").unionByName(docs.where("doc_id is null"))
