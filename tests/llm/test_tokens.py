"""Token counts, token files and packing against the library itself."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def ids_of(path, texts):
    return [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_safe(rows, path):
    from loomarray.llm.tokens import Ids, Lengths

    texts = [t or "" for _, t, *_ in rows] + ["don't  stop\r\n\n  now ", "  lead", "trail  ", "á é", "1234 5a6", "　wide　", "x<|endoftext|>y <|endoftext|>", "﻿mark", "İSTANBUL ΣΑΣ", "H\u0331 h\u0331 A\u030a, Stop. It's, A.b, C", "<|ENDOFTEXT|> Up"]
    expected = ids_of(path, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in Ids(path)(texts)] == expected
    assert Lengths(path)(texts).tolist() == [len(x) for x in expected]


def test_new_words_go_together():
    """Words not seen before reach the library many in a text, and come apart as it has them one by one."""
    from loomarray.llm.tokens import Ids

    rng = np.random.default_rng(4)
    words = ["".join(chr(rng.choice([*range(97, 123), 0xE9, 0x6F22, 39, 49])) for _ in range(rng.integers(1, 12))) + f"{k:x}" for k in range(3000)]
    texts = [" ".join(words[:1500]) + "\n\n" + "\n".join(words[1500:1550]), " " + " ".join(words[1550:]) + " "]
    ids, given = Ids(BYTE, "<u2"), []
    library = ids.tok
    ids.memo, ids.held = {}, [0]

    class Counting:
        def encode_batch_fast(self, some, **kind):
            given.extend(some)
            return library.encode_batch_fast(some, **kind)

    ids.tok = Counting()
    assert [np.frombuffer(x, "<u2").tolist() for x in ids(texts)] == ids_of(BYTE, texts)
    assert len(given) < 60
    given.clear()
    assert [np.frombuffer(x, "<u2").tolist() for x in ids(texts)] == ids_of(BYTE, texts) and not given


def test_cuts_join_up():
    from loomarray.llm.tokens import cut

    text = "some words  and\nmore " * 500
    parts = list(cut(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert list(cut("x" * 1000, 100)) == ["x" * 1000]


def test_random_texts_cut_safely():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from loomarray.llm.tokens import Ids

    both = {p: (tokenizers.Tokenizer.from_file(p), Ids(p)) for p in (BYTE, WORD)}

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r\x0b\x1c\x85  'sdx.!<|>endoftext0Áé漢")), st.characters(codec="utf-8")), max_size=60))
    def check(text):
        for tok, ids in both.values():
            assert np.frombuffer(ids([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids

    check()


def test_counts(docs, rows, odd, empty):
    from loomarray.llm.token_count import token_counts

    got = {r.doc_id: r for r in token_counts(docs, BYTE, limit=100).collect()}
    for (d, t, *_), ids in zip(rows, ids_of(BYTE, [r[1] for r in rows]), strict=True):
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 100)
    assert token_counts(odd, BYTE).count() == odd.count() and token_counts(empty, BYTE).count() == 0


def test_sentencepiece(docs, rows):
    spm = pytest.importorskip("sentencepiece")
    from loomarray.llm.token_count import token_counts

    path = P.path("piece_bpe_32k.model")
    sp = spm.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()}
    assert got == {d: len(sp.encode(t or "")) for d, t, *_ in rows}


def test_token_files(spark, docs, rows, odd, empty):
    from loomarray.llm.token_files import TokenFile, token_files, write_token_files

    got = {r.doc_id: r for r in token_files(docs, BYTE, 2).collect()}
    start = 0
    ordered = sorted(rows)
    for (d, *_), ids in zip(ordered, ids_of(BYTE, [r[1] for r in ordered]), strict=True):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids) + 1, crc([*ids, 2]))
        start += len(ids) + 1
    files = write_token_files(docs, BYTE, 2, length=128)
    assert files.total == start
    flat = []
    for uri in files.uris:
        f = TokenFile(uri)
        for k in range(len(f)):
            ids, mask = f.sequence(k)
            assert len(ids) == 128
            flat += ids[mask].tolist()
        f.close()
    assert flat == [i for ids in ids_of(BYTE, [r[1] for r in ordered]) for i in [*ids, 2]]
    assert token_files(odd, BYTE, 2).count() == odd.count() and token_files(empty, BYTE, 2).count() == 0


def test_pack(docs, rows, odd, empty):
    from loomarray.llm.packing import pack

    got = pack(docs, WORD, capacity=64).toPandas().sort_values(["doc_id", "piece"])
    expected = [(d, k // 64, k, len(x[k : k + 64]), crc(x[k : k + 64])) for (d, *_), ids in sorted(zip(rows, ids_of(WORD, [r[1] for r in rows]), strict=True)) for x in ([*ids, 0],) for k in range(0, len(x), 64)]
    assert [tuple(x) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()] == expected
    for table, n in ((got, None), (pack(odd, WORD, capacity=32).toPandas(), None)):
        for _, s in table.sort_values("offset").groupby("sequence_id"):
            assert (s.length.cumsum() - s.length == s.offset).all()
        del n
    least = -(-int(got.length.sum()) // 64)
    assert got.sequence_id.nunique() <= least * 1.05 + 1
    assert pack(empty, WORD).count() == 0


def test_plan_places_every_piece_once():
    from loomarray.llm.packing import places, plan

    rng = np.random.default_rng(0)
    for n in (1, 7, 300, 20000):
        length = np.minimum(2048, np.maximum(1, rng.lognormal(6.5, 1.0, n).astype(int)))
        hist = dict(zip(*(x.tolist() for x in np.unique(length, return_counts=True)), strict=True))
        bins = plan(hist, 2048)
        seen = {}
        for s, a, z, *_ in places(bins):
            seen.setdefault(s, []).append((a, z))
        for s, c in hist.items():
            spans = sorted(seen[s])
            assert spans[0][0] == 0 and spans[-1][1] == c - 1 and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert all(sum(s for s, _ in heads) <= 2048 for _, heads in bins.runs)
        assert bins.count <= -(-int(length.sum()) // 2048) * 1.02 + 1
