"""Operator 6: document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomarray.llm.common import id_text, partitions, texts_of
from loomarray.llm.hashing import U, grams, sliding_min

#: Code points of a gram, and grams of a window: two texts that share K + W - 1 code points in a row share an entry.
K, W = 25, 51
#: Code points of the further grams that texts of fewer than 2 K code points have.
SHORT = 5
#: Of an entry's 64 bits, the upper 40 are the gram's hash and the lower 24 its position.
POSITION = U((1 << 24) - 1)


def winnow(texts: list[str], k: int = K, w: int = W) -> list[np.ndarray]:
    """Entries of each text, by position: of every window of `w` grams the least hash, the rightmost of equals.

    A text of fewer grams than a window is one window; one of fewer code points than a gram is one
    gram; an empty text has no entry.  (Positions count modulo 2^24; entries
    stand in order and at most `w` apart, so each place where they fall is 2^24 code points further.)
    """
    out: list = [None] * len(texts)
    some, size = [], 0
    for i, x in enumerate(texts):
        if len(x) < k:
            out[i] = grams(np.frombuffer(x.encode("utf-32-le"), np.uint32), len(x)) & ~POSITION if x else np.empty(0, U)
            continue
        some.append(i)
        size += len(x)
        if size > 1 << 19:
            _winnow(texts, some, k, w, out)
            some, size = [], 0
    if some:
        _winnow(texts, some, k, w, out)
    return out


def adapted(texts: list[str], k: int = K, w: int = W) -> list[np.ndarray]:
    """Entries of each text as by `winnow`, and more for short ones, by a rule of the text's own length n alone.

    From 2 (k + w - 1) code points on there are no more.  Below, the window is smaller, so that texts
    that keep a half of n in a row share an entry; below 2 k, where that half may hold no gram, grams of
    SHORT code points come along.  A smaller window keeps all entries of a larger one, so short texts
    still share with long ones what they shared.  No such promise holds below 2 SHORT code points.
    """
    out = winnow(texts, k, w)
    groups: dict = {}
    for i, x in enumerate(texts):
        n = len(x)
        for g in ((k, SHORT) if SHORT < k and n < 2 * k else (k,)):
            if g <= n < 2 * (k + w - 1):
                groups.setdefault((g, min(w, max(1, (n + 1) // 2 - g + 1))), []).append(i)
    for (g, v), own in groups.items():
        for i, entries in zip(own, winnow([texts[i] for i in own], g, v), strict=True):
            if g != k:
                entries = np.concatenate([out[i], entries])
                entries = entries[np.argsort(entries & POSITION, kind="stable")]
            out[i] = entries
    return out


def _winnow(texts: list[str], some: list[int], k: int, w: int, out: list) -> None:
    data = np.frombuffer("".join([texts[i] for i in some]).encode("utf-32-le"), np.uint32)
    h = grams(data, k)
    sizes = np.array([len(texts[i]) for i in some])
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(h), dtype=np.int64)
    place -= np.repeat(starts, sizes)[: len(h)]
    keys = (h & ~POSITION) | (POSITION - (place.astype(U) & POSITION))
    least = sliding_min(keys, w) if len(keys) >= w else keys[:0]
    for i, s, n in zip(some, starts.tolist(), sizes.tolist(), strict=True):
        m = n - k + 1
        own = least[s : s + m - w + 1] if m >= w else keys[s : s + m].min(keepdims=True)
        new = np.empty(len(own), bool)
        new[0] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out[i] = own[new] ^ POSITION


def text_form(entries: np.ndarray) -> str:
    """Sixteen hexadecimal digits an entry: ten of the hash, six of the position."""
    return entries.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints; two empty ones are alike."""
    x, y = set((a >> U(24)).tolist()), set((b >> U(24)).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by the first as many code points, or all, of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds below an id, found in two steps over about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda array: F.size(F.filter(array, lambda b: b < doc_id))
    lit = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = below(lit([r[-1] for r in rows]))
    fine = F.get(F.array(*(lit(r) for r in rows)), coarse)
    return coarse * step + F.when(fine.isNotNull(), below(fine)).otherwise(0)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprint every whole text and its edited text (its second half taken from the next document).

    The next document is that with the next lower doc_id; after the last comes the first.  Rows go
    once to ranges of doc_id, each with a copy of the row that comes next after it, and stream
    through in order, so no task holds more than a batch.  Short texts have more entries (`adapted`):
    an edited text of 10 code points or more shares an entry with its own; shorter ones may not.

    Per document: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is empty: its fingerprint is the empty string, and two
    empty ones are alike (1.0).  Null ids come last; repeated ids by text.  A lone document
    follows itself.  An empty table gives no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n, least, most, nulls = ids.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    groups = max(1, min(8 * partitions(spark), n // 64))
    bounds: list[int] = []
    if n:
        found = ids.agg(F.percentile_approx("doc_id", [(i + 1) / groups for i in range(groups)], 100 * groups)).first()[0]
        bounds = sorted({*found, most})
    # the range p holds the ids over bounds[p - 1], up to bounds[p]; -1 is for null ids
    rows = id_text(docs)
    p = F.when(F.col("doc_id").isNull(), -1).otherwise(range_of(F.col("doc_id"), bounds)).cast("int")
    lowest = F.lit(-1 if nulls else 0)  # what comes after it is the very first
    first = F.col("doc_id").isin(bounds)  # Spark makes a set of it
    after = F.when(F.col("doc_id") == most, lowest).when(first, F.col("_p") + 1) if n else F.lit(None).cast("int")
    if n and nulls:
        top_null = F.when(F.col("doc_id").isNull(), F.lit(0))  # null ids come next after the lowest range
        after = F.coalesce(after, top_null)
    elif nulls:
        after = F.lit(-1)
    rows = rows.withColumn("_p", p)
    spread = F.array(F.struct(F.col("_p").alias("p"), F.lit(0).alias("copy")), F.struct(after.cast("int").alias("p"), F.lit(1).alias("copy")))
    dealt = rows.select("doc_id", "text", F.explode(F.filter(spread, lambda x: x.p.isNotNull())).alias("_to")).select("doc_id", "text", F.col("_to.p").alias("_p"), F.col("_to.copy").alias("_copy"))
    ordered = dealt.repartition(partitions(spark), "_p").sortWithinPartitions("_p", "_copy", F.desc("doc_id"), "text")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held = None  # (doc_id, text, entries, range, copy) of the row before
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = texts_of(part)
                rows = [*([held] if held else []), *zip(part.column("doc_id").to_pylist(), texts, adapted(texts, k, w), part.column("_p").to_pylist(), part.column("_copy").to_pylist(), strict=True)]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[4] and a[3] == b[3]]
                held = rows[-1] if rows else None
                new = [edited(a[1], b[1]) for a, b in pairs]
                prints = adapted(new, k, w)
                columns = [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
                    pa.array([text_form(a[2]) for a, _ in pairs], pa.string()),
                    pa.array([text_form(x) for x in prints], pa.string()),
                    pa.array([likeness(a[2], x) for (a, _), x in zip(pairs, prints, strict=True)], pa.float64()),
                    pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kind.split(", ")])

    return ordered.mapInArrow(run, kind)
