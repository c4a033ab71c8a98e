"""Operator 3: exact top-k search by BM25 with block-max pruning."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarray.llm.common import fresh_path, give_back, id_text, materialise, partitions, plan_bytes, turn_to_other_work
from loomarray.llm.hashing import U
from loomarray.llm.shingles import word_hashes
from loomarray.llm.token_files import store

#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75
#: Text behind a shard's index, documents of a block, queries of a chunk and of a step in it.
SHARD, BLOCK, CHUNK, STEP = 40 << 20, 8, 1024, 128
#: Chunks that a task searches a shard for at most; it prepares the shard once.  Tasks for each core at least, if there are chunks for them.
CHUNKS, TASKS = 16, 8
#: Block maxima and impacts by document are kept for terms in this share of a shard's documents or
#: more, the most frequent ones; lists of rarer terms are short and read whole.
COMMON, MOST = 1 / 24, 1024


def save_arrays(base: str, name: str, **arrays: np.ndarray) -> str:
    """Written under a name of its own, then moved: only whole files have the final name."""
    system, path = store(base)
    system.create_dir(path, recursive=True)
    data = io.BytesIO()
    np.savez(data, **arrays)
    own = f"{path}/_{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data.getbuffer())
    system.move(own, f"{path}/{name}")
    return f"{base}/{name}"


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    system, path = store(uri)
    with system.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as z:
        return dict(z)


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of each distinct term of each text, and the words of each text."""
    h, own = word_hashes(texts)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    head = np.flatnonzero(new)
    return own[head], h[head], np.diff([*head, len(h)]), np.bincount(own, minlength=len(texts))


def narrow(tf: np.ndarray) -> np.ndarray:
    """Term frequencies unchanged, in two bytes each where they fit and else in four (a text has under 2^31 words)."""
    return tf.astype(np.uint16 if tf.max(initial=0) < 1 << 16 else np.uint32)


def invert(docs: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> dict[str, np.ndarray]:
    """Postings by term, and in a term in the order given."""
    order = np.argsort(terms, kind="stable")
    terms, docs, tf = terms[order], docs[order], tf[order]
    new = np.ones(len(terms), bool)
    new[1:] = terms[1:] != terms[:-1]
    head = np.flatnonzero(new)
    return {"terms": terms[head], "begin": np.concatenate([head, [len(terms)]]).astype(np.int64), "docs": docs.astype(np.int32), "tf": narrow(tf)}


class Shard:
    """A shard's postings, with the part of BM25 that does not depend on the query.

    Documents stand by length, so those of a block have impacts alike and block maxima are tight.
    """

    def __init__(self, uri: str, mean: float):
        z = load_arrays(uri)
        self.ids, self.terms, self.begin = z["ids"], z["terms"], z["begin"]
        self.docs = z["docs"].astype(np.int64)
        norm = K1 * (1 - B + B * z["lengths"] / mean) if mean else np.ones(len(self.ids))
        tf = z["tf"].astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + norm[self.docs])
        df = np.diff(self.begin)
        common = np.flatnonzero(df >= max(2, COMMON * len(self.ids)))
        common = common[np.argsort(-df[common], kind="stable")[:MOST]]
        self.common = np.full(len(df), -1)
        self.common[common] = np.arange(len(common))
        blocks = max(1, -(-len(self.ids) // BLOCK))
        self.whole = np.zeros((blocks * BLOCK, len(common)))  # a document's impacts side by side, for `exact`
        for c, t in enumerate(common.tolist()):
            s = slice(self.begin[t], self.begin[t + 1])
            self.whole[self.docs[s], c] = self.impact[s]
        self.block_most = self.whole.reshape(blocks, BLOCK, len(common)).max(1)
        self.rough = self.whole.astype(np.float32)

    def top(self, queries: list[np.ndarray], idfs: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best `k` documents (ids, scores) of each query, by score and then id; fewer if fewer share a term.

        Rare terms' lists are read whole.  Common terms can add to a document no more than their
        block's maxima; documents whose bound stays under the k-th best exact score so far are
        passed over.  Where many are left, their common part is first taken in single precision,
        with room for its error.  Whoever is left then gets an exact score.
        """
        n, (width, many) = len(self.ids), self.whole.shape
        weights, rare = np.zeros((len(queries), many)), []
        for q, (query, idf) in enumerate(zip(queries, idfs, strict=True)):
            at = np.searchsorted(self.terms, query)
            at[at == len(self.terms)] = 0
            has = self.terms[at] == query if len(self.terms) else np.zeros(len(query), bool)
            t, w = at[has], idf[has]
            c = self.common[t]
            weights[q, c[c >= 0]] = w[c >= 0]
            rare.append((t[c < 0], w[c < 0]))
        ahead = weights @ self.block_most.T
        out: list = [None] * len(queries)
        heavy = []
        for q, (t, w) in enumerate(rare):
            a, count = self.begin[t], self.begin[t + 1] - self.begin[t]
            at = np.arange(count.sum()) + np.repeat(a - (np.cumsum(count) - count), count)  # the lists, one after the other
            score = np.bincount(self.docs[at], self.impact[at] * np.repeat(w, count), width)
            bound = (score.reshape(-1, BLOCK) + ahead[q][:, None]).ravel()
            first = min(4 * k, n)
            best = np.argpartition(bound, width - first)[width - first :]
            best = best[best < n]
            full = self.exact(q, weights, score, best)
            theta = np.partition(full, len(full) - k)[len(full) - k] if len(full) >= k else 0.0
            left = np.flatnonzero(bound >= theta - 1e-9)
            if len(left) * 16 > n:
                heavy.append((q, score, theta))
            else:
                out[q] = self.best(q, weights, score, left, k)
        if heavy:
            part = weights[[q for q, _, _ in heavy]].astype(np.float32) @ self.rough.T
            for (q, score, theta), common in zip(heavy, part, strict=True):
                guess = score + common
                slack = 1e-4 * (1 + float(common.max(initial=0)))
                left = np.flatnonzero(guess >= theta - slack)
                if len(left) > 8 * k:  # the k-th best guess is a better threshold
                    kth = np.partition(guess, width - k)[width - k]
                    left = left[guess[left] >= kth - 2 * slack]
                out[q] = self.best(q, weights, score, left, k)
        return out

    def exact(self, q: int, weights: np.ndarray, score: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return score[docs] + self.whole[docs] @ weights[q]

    def best(self, q: int, weights: np.ndarray, score: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        docs = docs[docs < len(self.ids)]
        total = np.round(self.exact(q, weights, score, docs), 9)
        keep = total > 0
        docs, total = docs[keep], total[keep]
        order = np.lexsort((self.ids[docs], -total))[:k]
        return self.ids[docs[order]], total[order]


def build(docs: DataFrame, base: str):
    """Write the shards' indexes; returns rows (uri, documents, words) and, in buckets, what terms each has."""

    def run(batches):
        turn_to_other_work()
        parts, words, ids, size, offset = [], [], [], 0, 0

        def out():
            lengths = np.concatenate(words)
            order = np.argsort(lengths, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            own, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            made = invert(place[own], term, tf)
            del own, term, tf
            uri = save_arrays(base, f"shard-{uuid.uuid4().hex}.npz", ids=np.concatenate(ids)[order], lengths=lengths[order], **made)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(lengths)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], ["uri", "documents", "words"])

        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for at in range(0, len(texts), 512):
                some = texts[at : at + 512]
                own, term, tf, length = term_counts(some)
                parts.append(((own + offset).astype(np.int32), term, narrow(tf)))
                words.append(length)
                offset += len(some)
                ids.append(batch.column("doc_id").slice(at, len(some)).to_numpy())
                size += sum(map(len, some))
                if size >= SHARD:
                    yield out()
                    parts, words, ids, size, offset = [], [], [], 0, 0
                    give_back()
        if words:
            yield out()
        give_back()

    return docs.mapInArrow(run, "uri string, documents long, words long")


def task_parts(chunks: int, shards: int, cores: int) -> list[slice]:
    """The chunks of queries that a task takes with a shard: CHUNKS at most, fewer where cores would have no tasks."""
    parts = min(chunks, max(-(-chunks // CHUNKS), -(-TASKS * cores // max(1, shards))))
    return [slice(j * chunks // parts, (j + 1) * chunks // parts) for j in range(parts)]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The best `k` of all `docs` for every query, by BM25 over whole texts, exactly.

    Terms are words (`[^\\x20\\x09-\\x0D]+`, A-Z lowered); each distinct one of a query counts once,
    with idf ln(1 + (N - df + 0.5) / (df + 0.5)).  N, mean length and df are of all documents.

    1. Texts become inverted indexes of shards, files in the shared folder; no text is shuffled.
    2. Queries go in chunks.  Shards and chunks send their terms to buckets, which answer each chunk
       with the terms' document frequencies: global statistics, never gathered in one place.
    3. A task takes one shard and some chunks, and prunes by block maxima (`Shard.top`).
    4. The shards' best are merged by chunk.

    Per query and rank: query_id, rank (from 1), doc_id, score.  Equal scores (to 9 decimals) rank
    by doc_id.  A query finds itself if it is among `docs`; documents that share no term with it
    aren't found.  Null and empty texts have no terms.  Rows without an id are left out; repeated
    ids are documents of their own.  Empty tables give no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    base = fresh_path(spark, "index")
    rows = id_text(docs).where("doc_id is not null")
    size = plan_bytes(rows)
    parts = rows.rdd.getNumPartitions()
    shards = build(rows.coalesce(max(1, min(parts, -(-size // (SHARD // 4))))), base).collect()  # a name and two counts a shard
    n, words = sum(s.documents for s in shards), sum(s.words for s in shards)
    mean = words / n if n else 0.0
    uris = [s.uri for s in shards]
    buckets = partitions(spark)

    def ask(batches):
        held: list = []

        def out():
            own, term, _, _ = term_counts([t for _, t in held])
            name = save_arrays(base, f"queries-{uuid.uuid4().hex}.npz", ids=np.array([i for i, _ in held], np.int64), own=own, terms=term)
            yield from spread(name, np.unique(term), None)

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.append((i, x or b""))
                if len(held) == CHUNK:
                    yield from out()
                    held = []
        if held:
            yield from out()

    def spread(name, terms, count):
        bucket = (terms % U(buckets)).astype(np.int64)
        for b in range(buckets):
            own = bucket == b
            if own.any() or (count is None and b == 0):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b], pa.int32()), pa.array([terms[own].tobytes()], pa.binary()), pa.array([b"" if count is None else count[own].astype("<i8").tobytes()], pa.binary())], ["name", "bucket", "terms", "df"])

    kind = "name string, bucket int, terms binary, df binary"
    queried = materialise(id_text(queries).where("doc_id is not null").coalesce(max(1, min(8, parts))).mapInArrow(ask, kind), "queries")
    chunks = [r.name for r in queried.select("name").distinct().collect()]  # a name a chunk

    def tell(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                z = load_arrays(uris[i])
                yield from spread("", z["terms"], np.diff(z["begin"]))

    def answer(table: pa.Table) -> pa.Table:
        names, terms, df = table["name"].to_pylist(), [np.frombuffer(x, U) for x in table["terms"].to_pylist()], table["df"].to_pylist()
        asked = np.unique(np.concatenate([np.empty(0, U), *(t for name, t in zip(names, terms, strict=True) if name)]))
        total = np.zeros(len(asked), np.int64)
        for name, t, c in zip(names, terms, df, strict=True):
            if not name and len(asked):
                at = np.searchsorted(asked, t)
                at[at == len(asked)] = 0
                hit = asked[at] == t
                total[at[hit]] += np.frombuffer(c, "<i8")[hit]
        rows = [(name, t.tobytes(), total[np.searchsorted(asked, t)].tobytes()) for name, t in zip(names, terms, strict=True) if name]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, x) for c, x in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["name", "terms", "df"])

    told = spark.range(0, len(uris), 1, max(1, len(uris))).mapInArrow(tell, kind)
    known = queried.unionByName(told).groupBy("bucket").applyInArrow(answer, "name string, terms binary, df binary")

    def weigh(table: pa.Table) -> pa.Table:
        z = load_arrays(table["name"][0].as_py())
        terms, df = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in (("terms", U), ("df", "<i8")))
        order = np.argsort(terms)
        df = df[order][np.searchsorted(terms[order], z["terms"])] if len(terms) else np.empty(0)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        uri = save_arrays(base, f"weighed-{uuid.uuid4().hex}.npz", idf=idf, **z)
        return pa.table({"uri": [uri], "queries": pa.array([len(z["ids"])], pa.int64())})

    weighed = [r.uri for r in known.groupBy("name").applyInArrow(weigh, "uri string, queries long").collect()] if chunks else []
    shares = task_parts(len(weighed), len(uris), spark.sparkContext.defaultParallelism)

    def search(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                s, share = divmod(i, len(shares))
                index = Shard(uris[s], mean)
                for name in weighed[shares[share]]:
                    z = load_arrays(name)
                    cut = np.searchsorted(z["own"], np.arange(len(z["ids"]) + 1))
                    spans = list(zip(cut, cut[1:], strict=False))
                    found = [x for j in range(0, len(spans), STEP) for x in index.top([z["terms"][a:b] for a, b in spans[j : j + STEP]], [z["idf"][a:b] for a, b in spans[j : j + STEP]], k)]
                    count = np.array([len(x) for x, _ in found], np.int64)
                    query = np.repeat(np.arange(len(found)), count)
                    arrays = (query, *(np.concatenate([x[j] for x in found]) if found else np.empty(0) for j in (0, 1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in zip(arrays, ("<i8", "<i8", "<f8"), strict=True))], ["name", "query", "doc", "score"])

    def merge(table: pa.Table) -> pa.Table:
        ids = load_arrays(table["name"][0].as_py())["ids"]
        query, doc, score = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("query", "<i8"), ("doc", "<i8"), ("score", "<f8")))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        keep = rank <= k
        return pa.table({"query_id": ids[query[keep]], "rank": pa.array(rank[keep], pa.int32()), "doc_id": doc[keep], "score": score[keep]})

    tasks = len(uris) * len(shares)
    best = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(search, "name string, query binary, doc binary, score binary")
    return best.groupBy("name").applyInArrow(merge, "query_id long, rank int, doc_id long, score double")
