"""Operator 12: a Merkle manifest whose upper proofs come from a butterfly exchange between blocks of leaves."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomarray.llm.blocks import pack_batch, unpack_batch
from loomarray.llm.common import bounded_batches, materialise, partitions

#: Nodes that one node is made of.
FANOUT = 3
#: Levels of the tree within a block: FANOUT ** HEIGHT leaves, which one task holds.
HEIGHT = 6
#: Blocks of a tree that share one copy of what stands above the tree.
SHARING = 1024

PATH = "array<struct<level: int, j: int, others: array<string>>>"


def div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def counted(value: Column) -> Column:
    """A value as it goes into a leaf: its UTF-8 bytes, a colon and itself, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[counted(v) for v in values]), 256)


def joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """The leaves with their place (`pos`, from 0) in their tree by `order`, and the leaves of the tree (`total`).

    Leaves are range-partitioned and sorted, and written with the number of each; places follow from
    the first number and the count of each tree in each partition, so no window holds a tree's leaves.
    """
    ranged = leaves.repartitionByRange(partitions(leaves.sparkSession), "tree", *order, F.monotonically_increasing_id())
    laid = materialise(ranged.sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    heads = laid.groupBy("part", "tree").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("part", "tree", (before - F.col("lo")).alias("shift"), F.sum("n").over(tree).alias("total"))
    return laid.join(heads, ["part", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def levels(leaves: list[str], height: int | None) -> list[list[str]]:
    """Leaves and what they are joined to, level by level: `height` times, or (None) until one is left."""
    out = [leaves]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([joined(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def blocks(leaves: DataFrame, *order: str, height: int = HEIGHT) -> DataFrame:
    """Aligned blocks of leaves (tree, leaf, more): tree, block, nb (blocks of the tree), node, data (the leaves, packed)."""
    size = FANOUT**height
    rows = numbered(leaves, *order)
    rows = rows.withColumn("block", div(F.col("pos"), size)).withColumn("nb", div(F.col("total") + size - 1, size))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        nb = table["nb"][0].as_py()
        node = levels(table["leaf"].to_pylist(), height if nb > 1 else None)[-1][0]
        data = pack_batch(table.drop_columns(["tree", "block", "nb", "total"]).to_batches()[0])
        return pa.table({"tree": table["tree"][:1].cast(pa.string()), "block": table["block"][:1], "nb": table["nb"][:1], "node": pa.array([node]), "data": pa.array([data], pa.binary())})

    return rows.groupBy("tree", "block").applyInArrow(build, "tree string, block long, nb long, node string, data binary")


def swap(state: DataFrame, width: int) -> DataFrame:
    """One round: groups of `width` blocks under one ancestor swap their nodes, lane by lane.

    Every block hashes the ancestor itself.  A last group with fewer blocks than lanes has each of
    them answer several lanes.  Three nodes meet at most.
    """
    block, nb = F.col("block"), F.col("nb")
    group, lane = div(block, width), block % width
    own = F.least(F.lit(width).cast("long"), nb - group * width)
    lanes = F.when((own < width) & (group % FANOUT != 0), F.sequence(lane, F.lit(width - 1).cast("long"), own)).otherwise(F.array(lane))
    sent = state.select("tree", "nb", div(group, FANOUT).alias("above"), lane.alias("lane"), (group % FANOUT).cast("int").alias("j"), "node", "block", F.explode(lanes).alias("to"))
    met = sent.groupBy("tree", "nb", "above", "to").agg(F.sort_array(F.collect_list(F.struct("j", "node", "block", (F.col("to") == F.col("lane")).alias("own")))).alias("met"))
    up = F.sha2(F.array_join(F.transform("met", lambda m: m["node"]), ""), 256)
    each = met.select("tree", "nb", "met", up.alias("node"), F.explode(F.filter("met", lambda m: m["own"])).alias("me"))
    others = F.transform(F.filter("met", lambda m: m["j"] != F.col("me.j")), lambda m: m["node"])
    return each.select("tree", "nb", F.col("me.block").alias("block"), "node", F.col("me.j").alias("j"), others.alias("others"))


def butterfly(packed: DataFrame) -> DataFrame:
    """For each block its tree's root and the path to it: tree, block, nb, root, path.

    Round by round, FANOUT groups of blocks swap nodes until a tree's blocks all hold its root; a
    round moves a row a block.
    """
    state = packed.select("tree", "nb", "block", "node")
    most = packed.agg(F.max("nb")).first()[0] or 0
    done, found, width, level = [], [], 1, 0
    while True:
        done.append(state.where(F.col("nb") <= width))
        if width >= most:
            break
        swapped = materialise(swap(state.where(F.col("nb") > width), width), "swapped")
        found.append(swapped.select("tree", "block", F.struct(F.lit(level).alias("level"), "j", "others").alias("step")))
        state, width, level = swapped.select("tree", "nb", "block", "node"), width * FANOUT, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumnRenamed("node", "root")
    if not found:
        return out.withColumn("path", F.array().cast(PATH))
    steps = found[0]
    for more in found[1:]:
        steps = steps.unionByName(more)
    paths = steps.groupBy("tree", "block").agg(F.sort_array(F.collect_list("step")).alias("path"))
    return out.join(paths, ["tree", "block"], "left").withColumn("path", F.coalesce("path", F.array().cast(PATH)))


def climb(node: str, path: list[dict]) -> str:
    for step in path:
        others = step["others"]
        node = joined([*others[: step["j"]], node, *others[step["j"] :]])
    return node


def local_paths(lines: list[list[str]]):
    """For each leaf of a block, whose `levels` these are, its path within."""
    for i in range(len(lines[0])):
        path, k = [], i
        for line in lines[:-1]:
            run = k // FANOUT * FANOUT
            path.append({"j": k - run, "others": line[run:k] + line[k + 1 : run + FANOUT]})
            k //= FANOUT
        yield path


def unpacked(row: dict, height: int):
    table = unpack_batch(row["data"])
    leaves = table["leaf"].to_pylist()
    return table, levels(leaves, height if row["nb"] > 1 else None)


def rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Merkle proofs of all documents, and what they say of tampered texts.

    A leaf hashes doc_id, source, lang, n_chars and text.  The leaves of a source, by doc_id, are
    joined by threes up to its subroot, and the subroots, by source, up to the root.  Blocks of
    FANOUT ** `height` leaves are joined within tasks; above them, blocks learn what stands beside
    their ancestors by `butterfly`, and sources likewise.  A leaf's path to the root is checked from
    its tampered form: of documents whose crc32 of doc_id is even, the text without line feeds.

    Nulls count as such in a leaf, and come first in order; a null doc_id is never tampered with.
    Rows of one doc_id are ordered by leaf; rows alike are leaves of their own.  An empty table gives
    no rows; other columns are dropped.  Texts are hashed where they are read and never shuffled.

    Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    doc_id, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    fields = [doc_id, source, F.col("lang"), F.col("n_chars")]
    tampered = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains(text, F.lit("\n"))
    tree = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # null first
    leaves = docs.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf_of(*fields, text).alias("leaf"), F.when(tampered, leaf_of(*fields, F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"))
    packed = materialise(blocks(leaves, "doc_id", "leaf", height=height), "blocks")
    state = butterfly(packed)
    subroots = state.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf"), F.col("nb").alias("blocks"))
    tops = materialise(blocks(subroots, "source", height=height), "tops")

    def above(batches):
        for row in rows_of(batches):
            table, lines = unpacked(row, height)
            paths = [[*p, *({"j": s["j"], "others": s["others"]} for s in row["path"])] for p in local_paths(lines)]
            n = table.num_rows
            step = pa.list_(pa.struct([("j", pa.int32()), ("others", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([table["source"].combine_chunks().cast(pa.string()), table["blocks"].combine_chunks(), table["leaf"].combine_chunks().cast(pa.string()), pa.array([row["root"]] * n), pa.array(paths, step)], ["tree", "blocks", "subroot", "root", "top"])

    top = tops.drop("node").join(butterfly(tops).drop("nb"), ["tree", "block"]).mapInArrow(above, "tree string, blocks long, subroot string, root string, top array<struct<j: int, others: array<string>>>")
    top = top.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("blocks") - 1, SHARING)))).drop("blocks")
    whole = packed.drop("node").join(state.select("tree", "block", "path").withColumn("chunk", div(F.col("block"), SHARING)).join(top, ["tree", "chunk"]).drop("chunk"), ["tree", "block"])

    def unfold(batches):
        for row in rows_of(batches):
            table, lines = unpacked(row, height)
            upper = [*row["path"], *row["top"]]
            tail = "".join(x for s in upper for x in s["others"]).encode()
            known = {}
            out = []
            for leaf, other, path in zip(lines[0], table["tampered"].to_pylist(), local_paths(lines), strict=True):
                proof = sha256("".join(x for s in path for x in s["others"]).encode())
                proof.update(tail)
                node = climb(leaf if other is None else other, path)
                if node not in known:
                    known[node] = climb(node, upper)
                out.append((proof.hexdigest(), known[node]))
            n = table.num_rows
            folded = [x[1] for x in out]
            same = lambda x: pa.array([x] * n, pa.string())
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(lines[0]), same(row["subroot"]), same(row["root"]), pa.array([x[0] for x in out]), pa.array(folded), pa.array([x == row["root"] for x in folded])], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return whole.mapInArrow(unfold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
