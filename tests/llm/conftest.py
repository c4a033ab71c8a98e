import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone under cloud green walking never seven brightly harbour old new left to be or not a in it was".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(".,;!") if rng.random() < 0.15 else "") for _ in range(n)).capitalize()


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, empty, null, very short and long texts."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = sentence(rng, 40)
    out = []
    for k in range(160):
        t = rng.choice(texts) if k % 3 == 0 else sentence(rng, rng.randint(1, 150))
        if k % 4 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if k % 10 == 7:
            t = t + "\n" + passage + "\n" + sentence(rng, 5)
        out.append((k * 3, t, "en", f"s{k % 5}" if k % 9 else None, len(t)))
    special = [None, "", " \t\n", "one", "two words", "É ü 漢字 \U0001f600 " * 20, "ab" * 400, "x", "<|endoftext|> in a text", sentence(rng, 9000), "a\x1cb  c  d"]
    out += [(1000 + k, t, "fr", "s1", 0) for k, t in enumerate(special)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """A null id, repeated rows and ids, and columns with names that operators might use."""
    more = rows[:40] + rows[:3] + [(None, "a text without an id, of some words", None, None, None), (rows[0][0], "another text of the first id", "en", "s0", 5)]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in more], KINDS + ", score int, _p int, rank string").repartition(2).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
