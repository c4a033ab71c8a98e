"""Quality, sharding, search, near duplicates, mixing, fingerprints, repeats and the pipeline, against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


# ---- 1
def labelled(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(900):
        good = k % 3 != 0
        w = ["".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 90))]
        t = " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w) if k % 2 else " | ".join(w)
        docs.append((k, t, "en", "s", len(t)))
        labels.append((k, int(good), 0))
    docs += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "no id", "en", "s", 5)]
    labels += [(5000, None, 0), (None, 1, 0), (0, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, empty):
    from loomarray.llm.quality import keep_good, quality

    docs, labels = labelled(spark)
    got = quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    known = got[got.doc_id.lt(900)]
    assert (known.held_out == [zlib.crc32(str(int(d)).encode()) % 3 == 1 for d in known.doc_id]).all()
    held = known[known.held_out]
    assert (held.predicted == [truth[int(d)] for d in held.doc_id]).mean() > 0.97
    assert quality(docs, labels).toPandas().sort_values("doc_id").score.tolist() == got.sort_values("doc_id").score.tolist()
    assert quality(docs, labels.where("false")).toPandas().score.eq(0.5).all() and quality(empty, labels).count() == 0
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and set(r.doc_id for r in kept.collect()) == set(x for x in got[got.predicted == 1].doc_id.where(lambda s: s.notna(), None))


def test_gam_learns_a_pair():
    from loomarray.llm.quality import Gam

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    gam = Gam.fit(x, y)
    assert (0, 1) in [tuple(sorted(p[:2])) for p in gam.pairs]
    fresh = rng.normal(size=(1000, 5))
    assert ((gam.score(fresh) > 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0))).mean() > 0.9


# ---- 2
def test_shard(spark, docs, rows, odd, empty, tmp_path):
    from loomarray.llm.sharding import SlotMap, shard

    path = str(tmp_path / "map")
    got = shard(docs, 7, path=path).toPandas()
    text = {d: (t or "").encode() for d, t, *_ in rows}
    for r in got.to_dict("records"):
        assert r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "bytes"
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    maps = [SlotMap.load(spark, path, v) for v in (0, 1)]
    assert maps[1].version == 1 and {s for _, s, _ in maps[1].edits} == set(np.flatnonzero(maps[0].shard_of != maps[1].shard_of))
    for r in got.to_dict("records"):
        assert maps[1].shard_of[r["virtual_slot"]] == r["shard"]
    bytes_ = got.groupby("shard")["size"].sum()
    assert bytes_.max() - bytes_.min() <= got["size"].nlargest(2).sum()
    assert shard(empty, 3).count() == 0
    as_rows = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    got = shard(odd, 3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == as_rows(odd.collect())
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_shard_with_hot_ids_and_rows(spark, monkeypatch):
    """Rows without an id, and rows alike, spread like others; large counts are written out in parts."""
    from loomarray.llm import sharding

    monkeypatch.setattr(sharding, "ALIKE", 100)
    rows = [(None, "no id %d" % k, "en") for k in range(2000)] + [(7, "the same", "en")] * 1500 + [(k, "x" * (k % 90), "en") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sharding.shard(docs, 4).toPandas()
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and bytes_.max() - bytes_.min() <= 120
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert got.virtual_slot.value_counts().max() < 20


def test_slot_map_balances_and_grows():
    from loomarray.llm.sharding import SlotMap

    load = np.random.default_rng(0).lognormal(9, 1, 8192)
    m = SlotMap.fresh(40).rebalanced(load)
    total = np.bincount(m.shard_of, load, 40)
    assert total.max() / total.min() < 1.001
    grown = m.rebalanced(load, 41)
    total = np.bincount(grown.shard_of, load, 41)
    assert grown.version == 2 and total.max() / total.min() < 1.01 and (grown.shard_of != m.shard_of).mean() < 0.1


# ---- 3
def test_search(docs, rows, odd, empty):
    from loomarray.llm.search import top_k

    queries = docs.where("doc_id % 5 = 0")
    got = collections.defaultdict(list)
    for r in top_k(docs, queries, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    bags = {d: collections.Counter(words(t)) for d, t, *_ in rows}
    n, size = len(bags), {d: sum(b.values()) for d, b in bags.items()}
    mean, df = sum(size.values()) / n, collections.Counter(w for b in bags.values() for w in b)
    for q in [d for d in bags if d % 5 == 0]:
        score = {}
        for d, b in bags.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w in bags[q] if w in b)
            if s:
                score[d] = s
        best = sorted(((-round(s, 9), d) for d, s in score.items()))[:5]
        assert [round(-s, 6) for s, _ in best] == [round(s, 6) for _, s in got[q]]
        assert [d for _, d in best] == [d for d, _ in got[q]]
    assert top_k(odd, odd, k=2).count() > 0 and top_k(empty, queries).count() == 0 and top_k(docs, empty).count() == 0


def test_search_prunes_exactly(tmp_path):
    """Every path of a shard's search, on a larger one with few words."""
    from loomarray.llm.search import Shard, invert, save_arrays, term_counts

    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}".encode() for k in range(600)]
    p = 1 / np.arange(1, 601)
    texts = [b" ".join(vocabulary[i] for i in rng.choice(600, rng.integers(1, 60), p=p / p.sum())) for _ in range(1500)]
    own, term, tf, length = term_counts(texts)
    order = np.argsort(length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    uri = save_arrays(str(tmp_path), "s.npz", ids=np.arange(1500)[order], lengths=length[order], **invert(place[own], term, tf))
    shard = Shard(uri, length.mean())
    df = dict(zip(*np.unique(term, return_counts=True), strict=True))
    asked = [np.unique(term[own == q]) for q in range(0, 1500, 30)]
    idf = [np.array([math.log(1 + (1500 - df[t] + 0.5) / (df[t] + 0.5)) for t in q]) for q in asked]
    for q, w, (ids, score) in zip(asked, idf, shard.top(asked, idf, 10), strict=True):
        total = np.zeros(1500)
        for t, x in zip(q, w, strict=True):
            rows = term == t
            total[own[rows]] += x * tf[rows] * 2.2 / (tf[rows] + 1.2 * (0.25 + 0.75 * length[own[rows]] / length.mean()))
        best = np.lexsort((np.arange(1500), -np.round(total, 9)))[:10]
        best = best[total[best] > 0]
        assert ids.tolist() == best.tolist() and np.allclose(score, total[best])


def test_search_counts_frequent_words_in_full(spark):
    """More than 65,535 of a word in a text: scores and ranks by the true count."""
    from loomarray.llm.search import top_k

    bags = {1: {"x": 70_000, "y": 30_000}, 2: {"x": 100_000, "z": 1}, 3: {"x": 1}} | {k: {"w": 1} for k in range(10, 500)}
    docs = spark.createDataFrame([(d, " ".join(" ".join([w] * n) for w, n in b.items())) for d, b in bags.items()], "doc_id long, text string")
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    idf = math.log(1 + (n - 3 + 0.5) / 3.5)
    score = {d: idf * bags[d]["x"] * 2.2 / (bags[d]["x"] + 1.2 * (0.25 + 0.75 * sum(bags[d].values()) / mean)) for d in (1, 2, 3)}
    got = top_k(docs, docs.where("doc_id = 3"), k=3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == sorted(score, key=lambda d: -score[d])
    assert np.allclose([r.score for r in got], [score[r.doc_id] for r in got], rtol=0, atol=1e-8)


# ---- 4
def groups(rows, n, percent):
    sets, parent = {}, {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, n, percent):
    from loomarray.llm.minhash import keep_one, near_duplicates

    got = {r.doc_id: r for r in near_duplicates(docs, n, percent).collect()}
    expected = groups(rows, n, percent)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == expected
    assert all(r.kept == (d == r.component_id) for d, r in got.items())
    kept = keep_one(docs, n, percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in expected.items() if c == d)


def test_near_duplicates_in_chunks(docs, rows, monkeypatch):
    """Clusters dealt over chunks, and components by rounds, give the same."""
    from loomarray.llm import components, minhash

    monkeypatch.setattr(minhash, "CHUNK", 2)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    original = components.components
    monkeypatch.setattr(minhash, "components", lambda edges: original(edges, one_task=0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == groups(rows, 3, 85)


def test_near_duplicates_edges(odd, empty):
    from loomarray.llm.minhash import near_duplicates

    got = near_duplicates(odd, 3, 85).collect()
    assert len(got) == odd.count() and [r.kept for r in got if r.doc_id is None] == [True]
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_join_rows_of_one_id(spark, odd, rows, monkeypatch):
    """Rows of one doc_id are one node: what either text reaches is one group, by few edges and by rounds."""
    from loomarray.llm import components, minhash

    rng = random.Random(8)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcd")
    texts = [(3, a), (7, a), (7, b), (7, ""), (9, b), (12, b + " more"), (13, "alone in the world"), (4, c), (5, c), (5, None), (None, b), (20, d), (20, d), (21, ""), (21, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    expected = sorted((k, {7: 3, 9: 3, 12: 3, 5: 4}.get(k, k)) for k, _ in texts if k is not None)
    original = components.components
    for one in (0, 1000):
        monkeypatch.setattr(minhash, "components", lambda edges, one=one: original(edges, one_task=one))
        got = minhash.near_duplicates(docs, 3, 85).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == expected
        assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got) and len(got) == len(texts)
    assert sorted(r.doc_id for r in minhash.keep_one(docs, 3, 85).where("doc_id is not null").collect()) == [3, 4, 13, 20, 20, 21, 21]
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(k, t) for k, t, *_ in rows[40:44]] + [(rows[43][0], rows[5][1])], "doc_id long, text string"))
    got = collections.defaultdict(set)
    for r in minhash.near_duplicates(more, 3, 85).collect():
        got[r.doc_id].add(r.component_id)
    assert all(len(x) == 1 for x in got.values()) and got[rows[43][0]] == got[rows[5][0]]


def test_near_duplicates_by_pairs_of_keys(spark, monkeypatch):
    """Chance meetings of two don't make a cluster, and pairs right at the threshold still meet."""
    from loomarray.llm import minhash

    assert all(minhash.miss((p / 100) ** minhash.BAND, minhash.entries(p)) <= minhash.MISS for p in (50, 80, 85, 99, 100))
    rng = random.Random(12)
    rows = []
    for k in range(60):
        w = [f"w{rng.randrange(10**9)}" for _ in range(210)]
        rows += [(k * 10, " ".join(w)), (k * 10 + 5, " ".join(w[:194] + [f"v{rng.randrange(10**9)}" for _ in range(16)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == groups(rows, 3, 85) and sum(d != c for d, (_, c) in got.items()) == 60


def test_components(spark):
    from loomarray.llm.components import components

    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for one in (0, 1000):
        got = {r.node: r.component for r in components(df, one).collect()}
        assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# ---- 5
def test_mix(docs, rows, odd, empty):
    from loomarray.llm.mixing import mix, mixed, targets

    got = mix(docs).toPandas()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows}
    assert len(got) == len(rows) and all(size[r["doc_id"]] == r["size"] for r in got.to_dict("records"))
    assert (got.taken == got.copies * got["size"]).all() and (got.taken <= 3 * got["size"]).all()
    for _, s in got.groupby("source", dropna=False):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= max(3, 0.01 * s.target.iloc[0]) and s.source_size.iloc[0] == s["size"].sum()
    assert math.isclose(got.groupby("source", dropna=False).target.first().sum(), sum(size.values()))
    again = mix(docs.repartition(5)).toPandas().sort_values("doc_id")
    assert again.copies.tolist() == got.sort_values("doc_id").copies.tolist()
    assert mix(empty).count() == 0
    counted = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r["size"]) for r in mix(odd).collect()) == sorted(map(counted, odd.collect()))
    assert mixed(docs).columns == docs.columns and mixed(docs).count() == got.copies.sum()
    assert targets({"a": 100, "b": 1, None: 0}) == {"a": 98.0, "b": 3.0, None: 0.0}


def test_mix_in_a_tree(docs, monkeypatch):
    from loomarray.llm import mixing

    monkeypatch.setattr(mixing, "LEAF", 3)
    monkeypatch.setattr(mixing, "FAN", 2)
    monkeypatch.setattr(mixing, "RESERVE", 1)
    got = mixing.mix(docs).toPandas()
    for _, s in got.groupby("source", dropna=False):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= s["size"].max() and (s.taken <= 3 * s["size"]).all()


def test_pivot_keeps_the_sum():
    from loomarray.llm.mixing import pivot

    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 400), rng.random(400)
    mean = np.zeros(400)
    for k in range(300):
        out, held, q = pivot(size, p, np.random.default_rng(k))
        assert set(np.unique(out)) <= {0.0, 1.0}
        assert abs((out * size).sum() + (size[held] * q if held >= 0 else 0) - (size * p).sum()) < 1e-4
        mean += out
    assert abs(mean / 300 - p).mean() < 0.05


def test_settle_keeps_sum_and_mean():
    from loomarray.llm.mixing import nearer, settle

    rng = np.random.default_rng(0)
    size, p0 = rng.integers(1, 90, 60), rng.random(60)
    total, mean, ends = 0.0, np.zeros(60), []
    for k in range(2000):
        p = p0.copy()
        q = settle(500, 0.3, size, p, np.random.default_rng(k))
        assert abs(q * 500 + (size * p).sum() - 150 - (size * p0).sum()) < 1e-6 and (p > -1e-9).all() and (p < 1 + 1e-9).all()
        total, mean = total + q, mean + p
        ends.append(q)
    assert abs(total / 2000 - 0.3) < 0.04 and abs(mean / 2000 - p0).max() < 0.03
    copies = rng.integers(0, 2, 60)
    got = nearer(size, copies, 321.0, np.zeros(60, int), np.full(60, 3))
    assert abs(321 + (size * (got - copies)).sum()) <= 1 and got.min() >= 0 and got.max() <= 3


def test_targets_against_rounds():
    """The one pass gives what stopping sources round after round gives."""
    from fractions import Fraction

    from loomarray.llm.mixing import targets

    rng = random.Random(4)
    for _ in range(200):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(rng.randint(1, 12))} | ({None: 7} if rng.random() < 0.5 else {})
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
        left, open_, want = Fraction(sum(sizes.values())), set(order), {}
        while open_:
            over = {s for s in open_ if left * w[s] > 3 * sizes[s] * sum(w[x] for x in open_)}
            if not over:
                want |= {s: float(left * w[s] / sum(w[x] for x in open_)) for s in open_}
                break
            want |= {s: 3.0 * sizes[s] for s in over}
            left, open_ = left - sum(3 * sizes[s] for s in over), open_ - over
        assert targets(sizes) == want


# ---- 6
def test_fingerprints(spark, docs, rows, odd, empty):
    from loomarray.llm.winnowing import fingerprints, winnow

    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    for k, (d, t, *_) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
    same = collections.defaultdict(set)
    for d, t, *_ in rows:
        same[t or ""].add(got[d].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert fingerprints(odd).count() == odd.count() and fingerprints(empty).count() == 0
    lone = fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert winnow([""])[0].size == 0


def test_winnowing_guarantee():
    from loomarray.llm.hashing import U, grams
    from loomarray.llm.winnowing import winnow

    rng = random.Random(2)
    for k, w in ((3, 4), (5, 1), (4, 9)):
        texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, 5, 12, 300)]
        for t, entries in zip(texts, winnow(texts, k, w), strict=True):
            if len(t) < k:
                continue
            h = (grams(np.frombuffer(t.encode("utf-32-le"), np.uint32), k) >> U(24)).tolist()
            expected = []
            for s in range(max(1, len(h) - w + 1)):
                low = min(h[s : s + w])
                at = max(i for i in range(s, min(len(h), s + w)) if h[i] == low)
                if not expected or expected[-1] != (low, at):
                    expected.append((low, at))
            assert [(int(e >> U(24)), int(e & U((1 << 24) - 1))) for e in entries] == expected


def test_half_kept_short_texts_share_an_entry():
    from loomarray.llm.winnowing import adapted, edited, likeness, winnow

    rng = random.Random(6)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [draw(n) for n in range(300)]
    changed = [edited(t, draw(rng.choice([0, 3, 30, 400]))) for t in texts]
    a, b = adapted(texts), adapted(changed)
    assert all(likeness(x, y) > 0 for x, y in zip(a[10:], b[10:], strict=True))
    for t, entries, plain in zip(texts, a, winnow(texts), strict=True):
        assert set(plain.tolist()) <= set(entries.tolist())
        if len(t) >= 150:
            assert entries.tolist() == plain.tolist()


# ---- 8
def remaining(rows):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone, new = np.zeros(len(b), bool), set()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            if s in seen:
                gone[p : p + 50] = True
            new.add(s)
        seen |= new
        out[d] = (len(b), int(gone.sum()), int((np.diff([0, *gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_repeats(spark, docs, rows, odd, empty):
    from loomarray.llm.repeats import remove_repeats, without_repeats

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert got == remaining(rows)
    assert sum(x[1] for x in got.values()) > 1000
    assert remove_repeats(empty).count() == 0
    alone = {r.doc_id: r.n_removed for r in remove_repeats(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    once = odd.where("doc_id is not null").groupBy("doc_id").count().where("count = 1").select("doc_id").collect()
    both = {r.doc_id: r.n_removed for r in remove_repeats(odd).collect()}
    assert all(both[r.doc_id] >= alone[r.doc_id] for r in once) and both[None] == 0
    assert not spark.catalog.listTables()
    kept = without_repeats(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert (r.text is None) == (r.doc_id == 1000) and r.n_chars == len(r.text or "")


def test_repeats_in_small_blocks(docs, rows, monkeypatch):
    from loomarray.llm import blocks, repeats

    monkeypatch.setattr(blocks.blocks, "__defaults__", (2000,))
    monkeypatch.setattr(repeats, "BUCKET", 1000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == remaining(rows)


def test_index_of_many_rows(monkeypatch):
    """Suffixes come in the same order where there are too many rows to sort two ranks and a place in one word."""
    from loomarray.llm.rlindex import RunLengthIndex

    rng = random.Random(8)
    for letters in ("ab", "abcdefghij"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 71))).encode() for _ in range(200)] + [b"ab" * 35] * 3
        few = RunLengthIndex(texts, 50)
        with monkeypatch.context() as m:
            m.setattr(RunLengthIndex, "PACKED", 0)
            many = RunLengthIndex(texts, 50)
        suffixes = sorted((t[k:], j, k) for j, t in enumerate(texts) for k in range(len(t) + 1))
        rows = np.array([many.at[j] + k for _, j, k in suffixes])
        assert (many.sample_first == rows[many.run_start]).all()
        for name in ("run_start", "run_symbol", "run_to", "sample_first", "sample_last", "sampled", "above", "shared"):
            assert (getattr(few, name) == getattr(many, name)).all()


def test_run_length_index():
    from loomarray.llm.rlindex import RunLengthIndex

    rng = random.Random(0)
    for _ in range(120):
        depth, letters = rng.choice([1, 2, 3, 5, 8, 50]), rng.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(90))
        texts = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(0, 60)
            s = bytearray(base[a : rng.randint(a, 90)])
            if s and rng.random() < 0.5:
                s[rng.randrange(len(s))] = rng.choice(letters)
            texts.append(bytes(s))
        index, value = RunLengthIndex(texts, depth), np.array([rng.randint(0, 50) for _ in texts])
        got, best = index.stream(value, 99), {}
        for s, v in zip(texts, value, strict=True):
            for p in range(len(s) - depth + 1):
                best[s[p : p + depth]] = min(best.get(s[p : p + depth], 99), v)
        for k, s in enumerate(texts):
            assert got[index.at[k] : index.at[k] + len(s) + 1].tolist() == [best[s[p : p + depth]] if p + depth <= len(s) else 99 for p in range(len(s) + 1)]
            if s:
                a = rng.randrange(len(s))
                part = s[a : a + rng.randint(1, 6)]
                n, at = index.find(part)
                assert n == sum(x[i : i + len(part)] == part for x in texts for i in range(len(x) - len(part) + 1))
                assert texts[at[0]][at[1] : at[1] + len(part)] == part
        assert index.find(b"\xff\x00nothing")[0] in (0, 1)
        ordered = sorted(([x + len(texts) for x in s[i:]] + [k], int(index.at[k]) + i) for k, s in enumerate(texts) for i in range(len(s) + 1))
        length, above = index.statistics()
        for (a, p), (b, q) in zip(ordered, ordered[1:], strict=False):
            same = next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
            assert (length[q], above[q]) == (min(same, depth), p)
        assert length[ordered[0][1]] == 0
        assert len(index.sampled) <= index.runs + len(texts)
    empty = RunLengthIndex([], 50)
    assert empty.n == 0 and len(empty.stream(np.empty(0, np.int64), 99)) == 0


# ---- all
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name


CLASHING = "score predicted _text kept _kept _id id text_ copies _copies _copy copy group block data bucket cluster digest rep target node p size held_out label chunk task members n".split()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Every stage gives back the columns it was given, with their values, whatever their names; empty tables too."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs, labels = labelled(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    passage = "a passage of many words that several documents share, and that is longer than fifty bytes"
    docs = docs.where("doc_id < 60 or doc_id >= 5000 or doc_id is null").unionByName(spark.createDataFrame([(6000, passage + " one", "en", None, 1), (6001, passage + " two", "en", "s", 1), (6001, passage + " two", "en", "s", 1)], docs.schema))
    wide = docs
    for k, name in enumerate(CLASHING):
        wide = wide.withColumn(name, F.coalesce(F.col("doc_id"), F.lit(-1)) * 100 + k)
    wide = wide.withColumn("with.a dot", F.lit("d")).cache()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, str(tmp_path))
        plain = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert sorted(map(tuple, got.select("doc_id", "piece", "length").na.fill(-1).collect())) == sorted(map(tuple, plain.select("doc_id", "piece", "length").na.fill(-1).collect()))
        else:
            assert got.columns == wide.columns, name
            rows = got.collect()
            assert len(rows) == plain.count(), name
            assert all(r[n] == (-1 if r.doc_id is None else r.doc_id) * 100 + k for r in rows for k, n in enumerate(CLASHING)), name
        assert stage(spark, wide.where("false"), str(tmp_path)).count() == 0, name


def test_mix_reaches_the_best_sum():
    """Sources of few documents miss their target by no more than any numbers of copies must."""
    from itertools import product

    from loomarray.llm.mixing import reached

    rng = np.random.default_rng(4)
    for _ in range(40):
        size = rng.integers(0, 60, 5)
        copies = np.where(size > 0, rng.integers(0, 4, 5), 0)
        want = float(rng.uniform(0, 3 * size.sum()))
        best = min(abs(float(np.dot(k, size)) - want) for k in product(range(4), repeat=5))
        got = reached(size, copies, float((size * copies).sum()) - want, 3)
        assert got.min() >= 0 and got.max() <= 3
        assert abs(float((size * got).sum()) - want) <= best + 0.5  # whole words are aimed at
