import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomarray.llm import collocations as co
from loomarray.llm import divergence as dv
from loomarray.llm import merkle
from loomarray.llm import sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_hand(rows, least, longest, best):
    count, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {key: a for key, a in count.items() if a >= least}
    out = []
    for (lang, p), a in found.items():
        if len(p) < 2:
            continue
        score, _, k = min((2_000_000 * a // (found[lang, p[:k]] + found[lang, p[k:]]), k, k) for k in range(1, len(p)))
        inside = any(lg == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (lg, q), b in found.items())
        if not inside:
            out.append((lang, " ".join(p), a, found[lang, p[:k]], found[lang, p[k:]], words[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:best]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("shards", [1, 3])
def test_phrases(docs, odd, shards):
    for df in (docs, odd):
        df = df.withColumn("lang", F.when(F.length("text") % 7 == 0, None).otherwise(F.col("lang")))
        want = phrases_by_hand([(r.lang, r.text) for r in df.collect()], 4, 4, 60)
        got = sorted(tuple(r) for r in co.collocations(df, least=4, best=60, shards=shards, block=3000).collect())
        assert got == want and len(got) > 60


def test_phrases_full_filter(docs):
    """A filter that says yes to everything changes what is counted, not what comes out."""
    want = phrases_by_hand([(r.lang, r.text) for r in docs.collect()], 6, 3, 50)
    assert sorted(tuple(r) for r in co.collocations(docs, least=6, longest=3, best=50, shards=2, bits=64).collect()) == want


def test_phrases_none(spark, empty):
    assert co.collocations(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " \t.\n", "en", "s", 4)], empty.schema)
    assert co.collocations(blank, least=1).count() == 0


def manifest_by_hand(rows):
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, t))))

    def tree(nodes):
        lines = [nodes]
        while len(lines[-1]) > 1:
            lines.append([H("".join(lines[-1][i : i + 3])) for i in range(0, len(lines[-1]), 3)])
        return lines

    def path(lines, k):
        for line in lines[:-1]:
            run = k // 3 * 3
            yield line[run:k], line[k + 1 : run + 3]
            k //= 3

    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = [tree([leaf(r, r.text) for r in groups[s]]) for s in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for i, s in enumerate(order):
        for k, r in enumerate(groups[s]):
            steps = [*path(trees[i], k), *path(top, i)]
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for a, b in steps:
                node = H("".join([*a, node, *b]))
            out.append((r.doc_id, trees[i][0][k], trees[i][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_grouped():
    """Keys that leave room for their places, and keys that don't, are grouped as NumPy does it."""
    from loomarray.llm.collocations import grouped

    rng = np.random.default_rng(4)
    for top in (1, 5, 10**6, 1 << 62):
        for n in (0, 1, 7, 3000):
            key = rng.integers(0, top, n)
            key[n // 2 :] = key[: n - n // 2]
            order, new = grouped(key)
            assert (order == np.argsort(key, kind="stable")).all()
            assert (order[new] == np.unique(key, return_index=True)[1]).all()


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(docs, odd, height):
    for df in (docs, odd) if height == 1 else (docs,):
        got = sorted((tuple(r) for r in merkle.manifest(df, height=height).collect()), key=str)
        assert got == manifest_by_hand(df.collect())
        assert {r[-1] for r in got} == {True, False}


def test_manifest_small(spark, empty, docs):
    assert merkle.manifest(empty).count() == 0
    one = docs.limit(1)
    assert [tuple(r) for r in merkle.manifest(one).collect()] == manifest_by_hand(one.collect())
    many = spark.createDataFrame([(k, "a\nb", None, f"source {k}", 3) for k in range(40)], docs.schema)
    assert sorted((tuple(r) for r in merkle.manifest(many, height=1).collect()), key=str) == manifest_by_hand(many.collect())


@pytest.mark.parametrize("width", range(1, 12))
def test_butterfly_ragged(spark, width):
    """Blocks of trees of any size all learn the root and their own path."""
    leaves = spark.createDataFrame([(f"t{n}", k, hashlib.sha256(f"{n} {k}".encode()).hexdigest()) for n in (width, 3 * width + 1) for k in range(n)], "tree string, k int, leaf string")
    state = merkle.butterfly(merkle.blocks(leaves, "k", height=0)).collect()
    for n in (width, 3 * width + 1):
        lines = merkle.levels([hashlib.sha256(f"{n} {k}".encode()).hexdigest() for k in range(n)], None)
        own = [r for r in state if r.tree == f"t{n}"]
        assert len(own) == n and {r.root for r in own} == {lines[-1][0]}
        for r in own:
            assert merkle.climb(lines[0][r.block], [s.asDict() for s in r.path]) == r.root


def rules_by_sql(df, tmp_path):
    path = str(tmp_path / "documents.parquet")
    df.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.sql(sql.DIVERGENCE).fetchall(), key=str)


def test_rules(docs, odd, empty, tmp_path):
    for k, df in enumerate((docs, odd)):
        df = df.withColumn("lang", F.when(F.length("text") % 7 == 0, None).otherwise(F.col("lang")))
        got = sorted((tuple(r) for r in dv.divergence_rules(df).collect()), key=str)
        assert got == rules_by_sql(df, tmp_path / str(k))
    assert dv.divergence_rules(empty).count() == 0


def test_rules_reject(spark, docs):
    """Text with other characters, and text without the language's words, is far from it; prose is not; short text is not judged."""
    prose = [(r.doc_id, r.text, "en", "s", 0) for r in docs.where("doc_id < 1000 and length(text) > 700").collect()]
    odd = [(10**6, " ".join(f"w{k}###" for k in range(300)), "en", "s", 0), (10**6 + 1, " ".join("abcdefghij"[k % 7 :] + "xyz"[k % 3] + "q" * (k % 11) for k in range(300)), "en", "s", 0), (10**6 + 2, "a few words " * 4, "en", "s", 0)]
    got = {r.doc_id: r for r in dv.divergence_rules(spark.createDataFrame(prose + odd, docs.schema)).collect()}
    assert all(got[r[0]].kept for r in prose)
    assert not got[10**6].kept and got[10**6].char_distance > 0.2
    assert got[10**6 + 1].word_distance > 0.32 and not got[10**6 + 1].kept
    assert got[10**6 + 2].char_distance is None and got[10**6 + 2].word_distance is None


def test_rules_of_every_language(spark, docs, tmp_path, monkeypatch):
    """Languages with under a thousandth of the documents have no distances, as by the SQL, and are judged as well where that is asked for."""
    texts = [r.text for r in docs.where("length(text) between 700 and 3000").orderBy("doc_id").limit(6).collect()]
    texts[3] = " ".join(f"w{k}###" for k in range(300))
    rows = [(k, texts[k % 4], f"l{k // 4}", "s", 0) for k in range(40)] + [(k, "a few words", "large", "s", 0) for k in range(40, 4_100)]
    df = spark.createDataFrame(rows, docs.schema)
    plain, whole = (sorted((tuple(r) for r in dv.divergence_rules(df, every_language=e).collect()), key=str) for e in (False, True))
    assert plain == rules_by_sql(df, tmp_path / "plain")
    monkeypatch.setattr(sql, "DIVERGENCE", sql.DIVERGENCE.replace("count(*) * 1000 >=", "count(*) * 1000000 >="))
    assert whole == rules_by_sql(df, tmp_path / "whole") != plain
    assert all(r[8] is None for r in plain) and sum(r[8] is not None for r in whole) == 40
    assert all(r[7] for r in plain if r[0] == 3) and not any(r[7] for r in whole if r[0] < 40 and r[0] % 4 == 3)


def test_repeated_windows(spark):
    rng = random.Random(5)
    lines = [[rng.choice("abc") for _ in range(rng.randint(5, 60))] for _ in range(80)] + [["a"] * 9, list("abcdefgh")]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, w array<string>").select("k", "w", dv.windows_of(F.col("w"), 5).alias("h"))
    df = df.select("k", "w", dv.numbered(F.col("h")).alias("o"), dv.low_bits(F.col("h")).alias("low"))
    got = df.select("k", dv.covered(F.col("o"), F.col("w"), F.col("low"), 5).alias("n"), dv.covered_by_words(F.col("w"), 5).alias("m"))
    for r in got.collect():
        w = lines[r.k]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {g for g, c in Counter(grams).items() if c > 1}
        assert r.n == r.m == len({i + j for i, g in enumerate(grams) if g in twice for j in range(5)})


def test_windows_under_one_hash(spark):
    """Different windows that share the high bits are told, so that words decide."""
    df = spark.createDataFrame([(list("abcdefgh"),)], "w array<string>")
    same = F.array(*[F.lit(k).cast("long") for k in range(4)])
    assert df.select(dv.covered(same, F.col("w"), F.lit(3), 5)).first()[0] == -1
