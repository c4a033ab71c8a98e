"""Operator 11: phrases that stand together, by dynamic itemset counting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomarray.llm.common import bounded_batches, discard, fresh_path, give_back, materialise, texts_of, turn_to_other_work
from loomarray.llm.hashing import U, mix

#: Stands between language and phrase in the key that phrases are grouped by, which begins with their number of words; no phrase has it.
TAB = "\t"
#: Words of the longest phrases.
LONGEST = 4
#: Shards that the scan goes round.  More of them start longer phrases earlier, and sum up what is open more often.
SHARDS = 2
#: Texts of a block of coded words.
BLOCK = 8 << 20
#: Bits of the filter of phrases that have reached the threshold.  Where it fills up, more phrases are counted than
#: need be, and come out the same.
BITS = 1 << 26
#: A language's phrases are ranked in so many parts, and the best of each again.
PARTS = 64

_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] += 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


class Numbers(dict):
    """The number of each word, in the order of their first calls."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def coded(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of the texts, and the line of their numbers; 0 (no word) where a piece ends."""
    data = b"\n".join(t.encode() for t in texts).translate(_TABLE).replace(b"\n", b" \n ")
    numbers = Numbers({b"\n": 0, b"": 1})
    line = np.fromiter(map(numbers.__getitem__, data.split(b" ")), np.int32)
    line = line[line != 1]
    return [w.decode() for w in numbers][2:], np.maximum(line - 1, 0)


def in_shards(docs: DataFrame, shards: int, block: int = BLOCK) -> DataFrame:
    """Texts coded once, in blocks of one language each: shard, lang, n (words), words, line.  A written table, a folder a shard."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def build(batches):
        turn_to_other_work()
        held, size, count, task = {}, 0, 0, TaskContext.get().partitionId()

        def out():
            nonlocal count
            for lang, texts in held.items():
                words, line = coded(texts)
                count += 1
                row = ([xxhash.xxh32_intdigest(f"{task} {count}") % shards], [lang], [int((line > 0).sum())], [words], [len(line)], [pa.compress(line.tobytes(), "zstd", asbytes=True)])
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "lang", "n", "words", "size", "line"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= block:
                    yield from out()
                    size = 0
        yield from out()
        give_back()

    path = fresh_path(spark, "coded")
    kinds = "shard int, lang string, n long, words array<string>, size long, line binary"
    docs.mapInArrow(build, kinds).write.partitionBy("shard").parquet(path)
    out = spark.read.schema(kinds).parquet(path)
    out._shared_path = path
    return out


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), U, len(words))


def longer(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first words and of their last one."""
    return mix(h * U(0x9E3779B97F4A7C15) + w)


def bits_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of a power of two bits."""
    return h & U(bits - 1), (h >> U(32)) & U(bits - 1)


def within(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter may have; never no to one it has."""
    a, b = bits_of(h, len(cells) << 6)
    return ((cells[a >> U(6)] >> (a & U(63))) & (cells[b >> U(6)] >> (b & U(63))) & U(1)).astype(bool)


def filter_of(reached: DataFrame, bits: int = BITS) -> np.ndarray:
    """The filter of these phrases (column key): so many bits, whatever their number; set bits are gathered by cells."""

    def cells(batches):
        for batch in batches:
            out = np.empty(batch.num_rows, U)
            for i, (lang, phrase) in enumerate(x.rsplit(TAB, 1) for x in batch.column("key").to_pylist()):
                words = word_hashes(lang[1:], phrase.split(" "))
                h = words[:1]
                for k in range(1, len(words)):
                    h = longer(h, words[k : k + 1])
                out[i] = h[0]
            at = np.concatenate(bits_of(out, bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], ["cell", "bits"])

    got = reached.select("key").mapInArrow(cells, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, U)
    out[got["cell"].to_numpy()] = got["bits"].to_numpy().view(U)
    return out


def active(line: np.ndarray, hashes: np.ndarray, now: np.ndarray, before: np.ndarray | None, longest: int):
    """(words, first places) of the phrases to count, for each length from 2.

    Those whose subphrases all have reached the threshold by the filter `now`, and had not by the one
    of a cycle `before` (then they are through).  Filters only gain bits, so a phrase is active for
    one cycle in a row, also where a filter says yes to too much.
    """
    at = np.maximum(line - 1, 0)
    h = hashes[at]
    filters = [now] if before is None else [now, before]
    good = [(line > 0) & within(f, hashes)[at] for f in filters]
    here = h
    for n in range(2, longest + 1):
        both = [np.append(g[:-1] & g[1:], False) for g in good]
        place = np.flatnonzero(both[0])
        if not len(place):
            return
        yield n, place if before is None else place[~both[1][place]]
        if n < longest:
            found = longer(here[place], h[place + n - 1])
            here = np.zeros(len(line), U)
            here[place] = found
            for f, b, g in zip(filters, both, good, strict=True):
                g[:] = False
                g[place] = b[place] & within(f, found)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys (not negative) in their order, equal ones as they stand, and which of these begin a new key."""
    low = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + low <= 63:  # values that carry their place sort faster than places
        both = np.sort((key << low) | np.arange(len(key)))
        order, both = both & ((1 << low) - 1), both >> low
    else:
        order = np.argsort(key, kind="stable")
        both = key[order]
    return order, np.concatenate([[True], both[1:] != both[:-1]])[: len(key)]


def counted(line: np.ndarray, words: pa.StringArray, place: np.ndarray, n: int, lang: str) -> tuple[pa.StringArray, np.ndarray]:
    """The keys of the distinct phrases of n words at these places, and how often each stands there."""
    key = line[place].astype(np.int64)
    for k in range(1, n):
        if k > 1:
            order, new = grouped(key)
            key[order] = np.cumsum(new) - 1
        key = key * (len(words) + 1) + line[place + k]
    order, new = grouped(key)
    head = np.flatnonzero(new)
    count = np.diff(head, append=len(key))
    at = place[order[head]]
    phrases = pc.binary_join_element_wise(*(words.take(pa.array(line[at + k] - 1)) for k in range(n)), " ")
    return pc.binary_join_element_wise(pa.scalar(f"{n}{lang}"), phrases, TAB), count


def scan(shard: DataFrame, step: int, shards: int, now: np.ndarray, before: np.ndarray | None, longest: int) -> DataFrame:
    """Counts of the phrases that are active in this step, block by block: key, new."""
    filters = shard.sparkSession.sparkContext.broadcast((now, before))  # BITS bits each

    def run(batches):
        turn_to_other_work()
        now, before = filters.value

        def out(keys, count):
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([keys[i : i + 50_000], pa.array(count[i : i + 50_000], pa.int64())], ["key", "new"])

        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, size, packed = (batch.column(c)[i] for c in ("lang", "words", "size", "line"))
                lang, words = lang.as_py(), words.values
                line = np.frombuffer(pa.decompress(packed.as_buffer(), size.as_py() * 4, "zstd", asbytes=True), np.int32)
                if step <= shards:
                    yield from out(pc.binary_join_element_wise(pa.scalar(f"1{lang}"), words, TAB), np.bincount(line, minlength=len(words) + 1)[1:])
                if step > 1 and len(words):
                    for n, place in active(line, word_hashes(lang, words.to_pylist()), now, before, longest):
                        if len(place):
                            yield from out(*counted(line, words, place, n, lang))
        give_back()

    return shard.select("lang", "words", "size", "line").mapInArrow(run, "key string, new long")


def frequent(docs: DataFrame, least: int = 30, longest: int = LONGEST, shards: int = SHARDS, block: int = BLOCK, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` (9 at most) words with `least` occurrences or more, and the words of each language.

    The corpus is dealt to shards, which are scanned round and round.  Single words are counted from
    the first step on; a longer phrase from the step after both its subphrases (without the last word,
    without the first) have been seen `least` times, through one whole cycle, whatever lengths the
    others in the scan have.  The tasks know the phrases that have reached the threshold from a filter
    of fixed size.  It says yes to some others too; those are counted through one cycle as well, and
    fall short.  What is counted is summed over the shards as they come; a phrase that is through, and
    falls short, goes.  The scan ends a cycle after the last phrase has reached the threshold.

    Returns (lang, phrase, n, a) and (lang, n).
    """
    lines = in_shards(docs, shards, block)
    step, last, closed, open_ = 0, 0, [], None
    words = F.ascii("key") - 48
    filters = [np.zeros(bits >> 6, U)]  # as each step left it; those of the last cycle and the one before
    while step < last + shards or step < shards:
        step += 1
        shard = lines.where(F.col("shard") == (step - 1) % shards)
        rows = scan(shard, step, shards, filters[-1], filters[0] if step > shards else None, longest).select("key", "new", F.lit(0).cast("long").alias("a"), F.lit(step).alias("first"))
        if open_ is not None:
            rows = rows.unionByName(open_.select("key", F.lit(0).cast("long").alias("new"), "a", "first"))
        sums = rows.groupBy("key").agg(F.sum("new").alias("new"), F.sum("a").alias("a"), F.min("first").alias("first"))
        merged = materialise(sums.select("key", (F.col("a") + F.col("new")).alias("a"), "first", (F.col("a") < least).alias("short")), "counts")
        through = F.col("first") + shards - 1 <= step
        through = through | (step >= shards) & (words == 1)
        reached = merged.where((F.col("a") >= least) & F.col("short") & (words < longest))
        closed.append(materialise(merged.where(through & (F.col("a") >= least)).select("key", "a"), "frequent"))
        gained = filter_of(reached, bits)
        if gained.any():
            last = step
        filters = [*filters, filters[-1] | gained][-shards - 1 :]
        if open_ is not None:
            discard(spent)
        spent, open_ = merged, merged.where(~through)
    closed.append(materialise(open_.where(F.col("a") >= least).select("key", "a"), "frequent"))  # through as well: first seen late in their cycle
    discard(spent)
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    phrase = F.substring_index("key", TAB, -1)
    lang = F.substring("key", F.lit(2), F.char_length("key") - F.char_length(phrase) - 2)
    found = found.select(lang.alias("lang"), phrase.alias("phrase"), words.alias("n"), "a")
    return found, lines.groupBy("lang").agg(F.sum("n").alias("n"))


def part(phrase: Column, first: int, size: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, size), " ")


def collocations(docs: DataFrame, least: int = 30, longest: int = LONGEST, best: int = 2000, shards: int = SHARDS, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The phrases of each language whose words stand together most.

    Texts are lowered (A-Z only) and cut at `. , ; : ! ?` and line ends into pieces; words are runs of
    anything but space and tab.  `frequent` counts phrases.  Candidates have 2 to `longest` words; the
    score is the least, over the cuts of a candidate, of 2,000,000 a / (l + r), floored (a tie goes to
    the first cut).  Candidates that lie in a longer one with four fifths of their count are dropped.
    The `best` of each language stay: by score, count and phrase.

    A null text has no words, a null lang is `und`; repeated rows and ids count as they stand; texts
    without words and empty tables give no rows; other columns are dropped.  Rows: lang, rank (from
    1), phrase, a, l, r, n, score.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found, words = frequent(docs, least, longest, shards, block, bits)
    known = found.select("lang", "phrase", "a")
    candidates = found.where("n > 1")
    cuts = candidates.select("lang", "phrase", "n", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.col("phrase"), F.lit(0), F.col("k")).alias("left"), part(F.col("phrase"), F.col("k"), F.col("n") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    scored = cuts.select("lang", "phrase", "n", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "n", "a").agg(F.min("cut").alias("cut"))
    inner = [F.struct(part(F.col("phrase"), F.lit(i), F.lit(m)).alias("phrase")) for m in range(2, longest) for i in range(longest - m + 1)]
    inner = F.filter(F.array(*inner), lambda x: F.size(F.split(x["phrase"], " ")) < F.col("n"))
    longer_ones = candidates.where("n > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("x")).groupBy("lang", F.col("x.phrase").alias("phrase")).agg(F.max("a").alias("within"))
    kept = scored.join(longer_ones, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * 80))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("_part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    ranked = top(top(kept, "lang", "_part").drop("rank"), "lang")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
