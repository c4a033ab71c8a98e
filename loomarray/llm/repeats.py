"""Operator 8: removal of long repeats through run-length indexes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray.llm.blocks import blocks, unpack_batch
from loomarray.llm.common import clear_shuffles, columns, give_back, lean, lean2, materialise, partitions, quoted, turn_to_other_work
from loomarray.llm.hashing import U, Prefix, grams, sliding_min
from loomarray.llm.rlindex import RunLengthIndex

#: Bytes of a match, of a gram, and the most windows of one snippet.
DEPTH, GRAM, MOST = 50, 24, 22
#: Bytes of text behind each bucket.
BUCKET = 4 << 20
#: No doc_id is above it: stands for null ids, and for places without a match.
NONE = np.iinfo(np.int64).max


def deflate(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.array([a.nbytes], "<i8").tobytes() + a.tobytes() for a in arrays))


def inflate(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        out.append(np.frombuffer(raw[at + 8 : at + 8 + n], kind))
        at += 8 + n
    return out


class Windows:
    """A block's texts, and the runs of neighbouring windows of DEPTH bytes that have one anchor.

    The anchor of a window is the least hash among its grams, so equal windows have equal anchors
    wherever they stand.
    """

    def __init__(self, data: bytes):
        self.table = unpack_batch(data)
        ids, texts = (self.table.column(self.table.num_columns - k).combine_chunks() for k in (2, 1))  # the last two
        self.ids = ids.fill_null(NONE).to_numpy(zero_copy_only=False)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0)
        self.null = texts.is_null().to_pylist()
        self.sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bytes = b"".join(x for x in texts.cast(pa.large_binary()).to_pylist() if x is not None)
        self.flat = np.frombuffer(self.bytes, np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def runs(self, hashed: bool = False) -> tuple[np.ndarray, ...]:
        """First window, number of windows and anchor of each run, and a hash of its bytes if asked for.

        A chunk of the block at a time, so the arrays stay small.
        """
        parts, step = [], 1 << 19
        for at in range(0, max(1, len(self.flat)), step):
            chunk = self.flat[at : at + step + DEPTH - 1]
            h = grams(chunk, GRAM)
            if len(h) < DEPTH - GRAM + 1:
                break
            m = sliding_min(h, DEPTH - GRAM + 1)
            last = np.clip(self.starts + self.sizes - DEPTH + 1 - at, 0, len(m))  # windows past it leave their text
            first = np.clip(self.starts - at, 0, len(m))
            edge = np.zeros(len(m) + 1, np.int8)
            some = last > first
            np.add.at(edge, first[some], 1)
            np.add.at(edge, last[some], -1)
            valid = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
            if not len(valid):
                continue
            a = m[valid]
            new = np.ones(len(valid), bool)
            new[1:] = (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)
            begin = np.zeros(len(m), bool)
            begin[first[some]] = True
            new |= begin[valid]
            head = np.flatnonzero(new)
            new |= (np.arange(len(valid)) - np.repeat(head, np.diff(np.append(head, len(valid))))) % MOST == 0
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(valid)))
            parts.append((valid[head] + at, size, a[head], *((Prefix(chunk).span(valid[head], size + DEPTH - 1),) if hashed else ())))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U), *((np.empty(0, U),) if hashed else ())
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def owner(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def short(anchor: np.ndarray) -> np.ndarray:
    """Anchors as they travel: 47 bits, besides the bucket.  Two that meet by chance only cost work."""
    return anchor >> U(17)


def six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def by_bucket(bucket: np.ndarray):
    """(bucket, slice) of an ascending array."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(cut, cut[1:], strict=False):
        yield int(bucket[a]), slice(int(a), int(b))


def anchors(data: bytes, buckets: int):
    """For each bucket: the block's anchors, ascending, each with a bit that says whether two of its rows have it."""
    w = Windows(data)
    place, _, anchor = w.runs()
    row = w.owner(place)
    bucket, value = (anchor % U(buckets)).astype(np.int64), short(anchor)
    order = np.lexsort((value, bucket))
    bucket, value, row = bucket[order], value[order], row[order]
    if not len(value):
        return
    head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])]))
    many = np.minimum.reduceat(row, head) != np.maximum.reduceat(row, head)
    bucket, value = bucket[head], (value[head] << U(1)) | many.astype(U)
    for b, s in by_bucket(bucket):
        yield b, six(value[s])


def shared_anchors(parts: list[bytes]) -> list[bytes]:
    """Of the anchors that blocks send to a bucket, those in two rows or more, for each block."""
    values = [unsix(p) for p in parts]
    v = np.concatenate(values)
    own = np.repeat(np.arange(len(parts)), [len(x) for x in values])
    order = np.argsort(v >> U(1), kind="stable")
    a, many, own = v[order] >> U(1), (v[order] & U(1)).astype(bool), own[order]
    head = np.concatenate([[True], a[1:] != a[:-1]])
    at = np.cumsum(head) - 1
    count, any_many = np.bincount(at), np.zeros(int(at[-1]) + 1, bool)
    any_many[at[many]] = True
    keep = ((count > 1) | any_many)[at]
    a, own = a[keep], own[keep]
    order = np.argsort(own, kind="stable")
    return [six(x) for x in np.split(a[order], np.searchsorted(own[order], np.arange(1, len(parts))))]


class Snippets:
    """A block's runs with shared anchors, and which of them have the same bytes.

    Equal snippets of a block are one, with the least id; they stand by bucket, in an order that
    depends on the block alone.
    """

    def __init__(self, data: bytes, shared: dict[int, bytes], buckets: int):
        self.w = w = Windows(data)
        place, n, anchor, h = w.runs(hashed=True)
        bucket, value = (anchor % U(buckets)).astype(np.int64), short(anchor)
        known = np.concatenate([np.empty(0, U), *((U(b) << U(47)) | unsix(shared[b]) for b in sorted(shared))])
        both = (bucket.astype(U) << U(47)) | value
        at = np.searchsorted(known, both)
        at[at == len(known)] = 0
        keep = known[at] == both if len(known) else np.zeros(len(place), bool)
        self.place, self.n, self.bucket, self.anchor = place[keep], n[keep], bucket[keep], value[keep]
        self.row = w.owner(self.place)
        h = h[keep]
        order = np.lexsort((h, self.bucket))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (self.bucket[order][1:] != self.bucket[order][:-1])
        self.kind = np.empty(len(order), np.int64)  # of each run
        self.kind[order] = np.cumsum(new) - 1
        self.head = order[new]  # a run of each kind
        self.least = np.full(len(self.head), NONE)
        np.minimum.at(self.least, self.kind, w.ids[self.row])

    def send(self):
        for b, s in by_bucket(self.bucket[self.head]):
            head = self.head[s]
            size = self.n[head] + DEPTH - 1
            text = b"".join([self.w.bytes[p : p + z] for p, z in zip(self.place[head].tolist(), size.tolist(), strict=True)])
            yield b, deflate(size.astype(np.uint8), self.least[s], np.frombuffer(six(self.anchor[head]), np.uint8), np.frombuffer(text, np.uint8))


def match(parts: list[bytes]) -> list[bytes]:
    """A bucket's snippets from all blocks to matches: for each snippet of each block, runs of windows and
    the least id that has them.

    Distinct snippets whose anchor others have too are indexed once, and stream through the index.
    A snippet that is alone with its anchor shares its windows with its own copies only.
    """
    ids: dict[bytes, int] = {}
    kinds, least, anchors_ = [], [], []
    for p in parts:
        size, own, anchor, text = inflate(p, "u1", "<i8", "u1", "u1")
        data, ends = text.tobytes(), np.cumsum(size, dtype=np.int64)
        kinds.append(np.fromiter((ids.setdefault(data[e - n : e], len(ids)) for e, n in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(size)))
        least.append(own)
        anchors_.append(unsix(anchor.tobytes()))
    kind = np.concatenate(kinds)
    first = np.full(len(ids), NONE)
    np.minimum.at(first, kind, np.concatenate(least))
    anchor = np.empty(len(ids), U)
    anchor[kind] = np.concatenate(anchors_)
    _, group, many = np.unique(anchor, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(many[group] > 1)
    texts = list(ids)
    index = RunLengthIndex([texts[j] for j in chosen.tolist()], DEPTH)
    found = index.stream(first[chosen], NONE)
    # windows of each distinct snippet, one after the other, as runs of equal least id
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - DEPTH + 1
    text = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    value = first[text]
    of = np.full(len(windows), -1)
    of[chosen] = np.arange(len(chosen))
    indexed = of[text] >= 0
    value[indexed] = found[index.at[of[text[indexed]]] + within[indexed]]
    head = np.flatnonzero((within == 0) | np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.concatenate([head, [len(text)]]))
    owner, value = text[head], value[head]
    runs = np.bincount(owner, minlength=len(windows))
    begin = np.cumsum(runs) - runs
    out = []
    for k in kinds:
        n = runs[k]
        at = np.repeat(begin[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(deflate(n.astype(np.uint8), size[at].astype(np.uint8), value[at]))
    return out


def removed(data: bytes, shared: dict[int, bytes], found: dict[int, bytes], buckets: int) -> tuple[Windows, np.ndarray]:
    """A block's bytes that matches with smaller ids cover."""
    s = Snippets(data, shared, buckets)
    cover = np.zeros(len(s.w.flat) + 1, np.int32)
    if len(s.head):
        parts = [inflate(found[b], "u1", "u1", "<i8") for b, _ in by_bucket(s.bucket[s.head])]
        n, size, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = n.astype(np.int64)
        begin = np.cumsum(n) - n
        each = n[s.kind]  # runs of matches in every occurrence
        at = np.repeat(begin[s.kind] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        size, value = size[at].astype(np.int64), value[at]
        own = np.repeat(np.arange(len(each)), each)
        ends = np.cumsum(size)
        before = np.concatenate([[0], ends])[np.cumsum(each) - each]
        start = s.place[own] + ends - size - before[own]
        hit = value < s.w.ids[s.row[own]]
        np.add.at(cover, start[hit], 1)
        np.add.at(cover, start[hit] + size[hit] + DEPTH - 1, -1)
    return s.w, np.cumsum(cover[:-1]) > 0


def repeats(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[T.StructField]]:
    """Rows of `docs` with what is removed of their texts (see `remove_repeats`), as blocks and marks ready to join."""
    spark = docs.sparkSession
    held = [f"c{k}" for k in range(len(keep))]  # any names can be given, but not all may go to Python
    fields = [T.StructField(h, docs.schema[c].dataType) for h, c in zip(held, keep, strict=True)]
    kept = [quoted(c).alias(h) for h, c in zip(held, keep, strict=True)]
    own = blocks(docs.select(*kept, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), "text")
    total = own.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET))

    def batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["group", "block", "bucket", "blob"]
    schema = "group long, block int, bucket int, blob binary"

    def send_anchors(batches):
        turn_to_other_work()
        for b in batches:
            for group, block, data in zip(b.column("group").to_pylist(), b.column("block").to_pylist(), b.column("data"), strict=True):
                yield batch([(group, block, k, blob) for k, blob in anchors(data.as_py(), buckets)], names, kinds)
        give_back()

    def answer(with_: object):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("group", "ascending"), ("block", "ascending")])
            out = with_(table["blob"].to_pylist())
            return pa.table([table["group"], table["block"], table["bucket"], pa.array(out, pa.binary())], names)

        return lean(run)

    shared = materialise(own.mapInArrow(send_anchors, schema).groupBy("bucket").applyInArrow(answer(shared_anchors), schema).where(F.length("blob") > 0), "shared")

    clear_shuffles(spark)

    def send_snippets(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for group, block, data, known in joined(left, right):
            if known[0]:
                rows += [(group, block, k, blob) for k, blob in Snippets(data, known[0], buckets).send()]
        return pa.Table.from_batches([batch(rows, names, kinds)])

    snippets = own.select("group", "block", "data").groupBy("group").cogroup(shared.withColumn("kind", F.lit(0)).groupBy("group")).applyInArrow(lean2(send_snippets), schema)
    found = materialise(snippets.groupBy("bucket").applyInArrow(answer(match), schema), "matches")
    del snippets
    clear_shuffles(spark)
    return own, shared.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1))), buckets, fields


def joined(left: pa.Table, right: pa.Table):
    """Blocks of a group with what is known of each: by kind, a blob for each bucket."""
    known: dict = {}
    for block, kind, bucket, blob in zip(*(right[c].to_pylist() for c in ("block", "kind", "bucket", "blob")), strict=True):
        known.setdefault(block, ({}, {}))[kind][bucket] = blob
    for group, block, data in zip(*(left[c] for c in ("group", "block", "data")), strict=True):
        yield group.as_py(), block.as_py(), data.as_py(), known.get(block.as_py(), ({}, {}))


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def apply(docs: DataFrame, finish, fields: list[T.StructField], *keep: str) -> DataFrame:
    """`finish(table, index of the row, bytes, mask of removed bytes)` gives the values of `fields` of each row."""
    own, marks, buckets, kept = repeats(docs, *keep)
    names = [f"f{k}" for k in range(len(fields))]
    schema = T.StructType([*kept, *(T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = [arrow.empty_table()]
        for _, _, data, known in joined(left, right):
            w, mask = removed(data, known[0], known[1], buckets)
            rows = [finish(None if no else w.bytes[a : a + n], mask[a : a + n]) for a, n, no in zip(w.starts.tolist(), w.sizes.tolist(), w.null, strict=True)]
            table = w.table.select(list(range(len(kept))))
            for name, column in zip(names, zip(*rows, strict=True), strict=True):
                table = table.append_column(name, pa.array(column, arrow.field(name).type))
            tables.append(table.cast(arrow))
        return pa.concat_tables(tables)

    return own.select("group", "block", "data").groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(lean2(run), schema).toDF(*keep, *(f.name for f in fields))


SPANS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def _measure(text: bytes | None, mask: np.ndarray):
    data = text or b""
    start, end = spans_of(mask)
    digest, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        digest.update(data[at:a])
        at = b
    digest.update(data[at:])
    return len(data), int(mask.sum()), len(start), digest.hexdigest(), [[a, b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is removed of every whole text: each byte that a string of 50 bytes covers which also starts in a
    document with a smaller doc_id.  Strings are judged on the input; matches never cross documents.

    1. Texts are packed into blocks in the shared folder.
    2. Every window of 50 bytes has an anchor, its least gram hash.  Blocks send their anchors,
       each once, to buckets, which answer with those that two documents have.
    3. Blocks send the bytes around shared anchors, equal ones once, to the anchors' buckets.  A
       bucket builds a run-length index of the distinct ones and streams them through it; matches
       of 50 bytes fall into groups of rows, and the least doc_id of the group comes back.
    4. Blocks mark what matches with smaller ids cover.

    Equal windows always meet, and however often a passage repeats, a block sends it once.

    Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans
    (start and end of each).  A null text is empty; texts under 50 bytes keep all.  Rows of one
    doc_id don't match each other; null ids count as larger than any and equal to each other.  An
    empty table gives no rows; other columns are dropped.
    """
    return apply(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _measure, SPANS, "doc_id")


def whole_characters(text: bytes, mask: np.ndarray) -> str:
    """What stays of a text, where only whole characters go."""
    flat = np.frombuffer(text, np.uint8)
    head = (flat & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    gone = np.bincount(char, mask) == np.bincount(char) if len(flat) else np.empty(0, bool)
    return flat[~gone[char]].tobytes().decode() if len(flat) else ""


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with what stays of their texts (characters that a removal cuts through stay whole)
    and n_chars to match; null texts stay null.  Columns of any name and their order stay.

    Null ids count as larger than any, rows of one doc_id don't match each other, and an empty table gives
    no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("text", "n_chars")]

    def finish(text, mask):
        if text is None:
            return None, 0
        left = whole_characters(text, mask) if mask.any() else text.decode()
        return left, len(left)

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return apply(docs, finish, fields, *kept).select(*columns(docs))
