"""Values on rows without an id, repeated rows and ids; the classifier on labelled documents."""

import os
from collections import Counter

import pytest
from test_tokens import BYTE, WORD, crc, ids_of

DATA = "/root/testdata/sf0.01"


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_counts(odd):
    from loomarray.llm.token_count import token_counts

    rows = texts(odd)
    want = Counter((d, len(t.encode()), len(ids)) for (d, t), ids in zip(rows, ids_of(BYTE, [t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(odd, BYTE).collect()) == want


def test_token_files(odd):
    from loomarray.llm.token_files import token_files

    rows = texts(odd)
    want = Counter((d, len(ids) + 1, crc([*ids, 2])) for (d, _), ids in zip(rows, ids_of(BYTE, [t for _, t in rows]), strict=True))
    got = sorted(token_files(odd, BYTE, 2).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_pack(odd):
    from loomarray.llm.packing import pack

    rows = texts(odd)
    pieces = [(d, k // 32, k, len(x[k : k + 32]), crc(x[k : k + 32])) for (d, _), ids in zip(rows, ids_of(WORD, [t for _, t in rows]), strict=True) for x in ([*ids, 0],) for k in range(0, len(x), 32)]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pack(odd, WORD, capacity=32).collect()) == Counter(pieces)


def test_fingerprints(odd, docs):
    from loomarray.llm.winnowing import fingerprints

    of_text = {}
    for df in (docs, odd):
        rows = Counter(texts(df))
        got = fingerprints(df).collect()
        assert len(got) == sum(rows.values())
        text_of = {}
        for (d, t), _ in rows.items():
            text_of.setdefault(d, []).append(t)
        for r in got:
            assert r.n_chars in {len(t) for t in text_of[r.doc_id]}
            if len(text_of[r.doc_id]) == 1:
                assert of_text.setdefault(text_of[r.doc_id][0], r.fingerprint) == r.fingerprint


def test_near_duplicates_of_copies(odd):
    from loomarray.llm.minhash import near_duplicates

    rows = texts(odd)
    same = {}
    for d, t in rows:
        if d is not None and len(t.split()) > 2:
            same.setdefault(t, set()).add(d)
    of = {}
    for r in near_duplicates(odd, 3, 85).collect():
        of.setdefault(r.doc_id, set()).add(r.component_id)
    for ids in same.values():
        assert len(set().union(*(of[d] for d in ids))) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_quality_on_held_out_labels(spark):
    from loomarray.llm.quality import quality

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality(spark.read.parquet(f"{DATA}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = (got[got.quality == k].score.to_numpy() for k in (1, 0))
    auc = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) if len(bad) else 1.0
    assert len(got) > 80 and auc > 0.97 and (got.predicted == got.quality).mean() > 0.95


