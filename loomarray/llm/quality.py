"""Operator 1: quality classifier, a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray.llm.common import bounded_batches, columns, free, id_text, quoted, texts_of, turn_to_other_work

#: Rows that the model is fitted on at most, those whose hashed doc_id is least.
FIT_ROWS = 12_000
#: Cut points of a feature's table, and of each side of a pair's table.
CUTS, PAIR_CUTS = 63, 15

NAMES = (
    "log_chars", "log_words", "word_length", "upper", "exclaims", "bars", "symbols", "digits", "repeats", "distinct",
    "commonest", "ends", "commas", "lines", "same_lines", "capitals", "short_words", "not_ascii", "longest_repeat", "longest_word",
)

_CLASS = np.zeros((256, 6), np.int64)  # of bytes: lower, upper, digit, exclamation mark, comma, symbol
_CLASS[97:123, 0] = _CLASS[65:91, 1] = _CLASS[48:58, 2] = _CLASS[ord("!"), 3] = _CLASS[ord(","), 4] = 1
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"], 5] = 1


def features(text: str) -> list[float]:
    """Of a whole text, in the order of NAMES; all are finite, for empty texts too."""
    data = text.encode()
    low, up, digit, bang, comma, symbol = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS).tolist()
    words, lines = data.split(), data.split(b"\n")
    n, chars = max(1, len(words)), max(1, len(text))
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    counts = Counter(words)
    heads = bytes(w[0] for w in words)
    tails = bytes(w[-1] for w in words)
    capitals = sum(map(heads.count, (bytes([c]) for c in range(65, 91)))) if heads else 0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sizes.sum() / n, up / max(1, low + up), bang / n, counts.get(b"|", 0) / n, symbol / chars, digit / chars, sum(same) / n, len(counts) / n,
        max(counts.values(), default=0) / n, (tails.count(b".") + tails.count(b"?") + tails.count(b"!")) / n, comma / n, len(lines) / n, 1 - len(set(lines)) / len(lines), capitals / n, float((sizes <= 3).sum()) / n, (len(data) - len(text)) / chars, longest / n, np.log1p(sizes.max(initial=0)),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(x) for x in texts], float).reshape(len(texts), len(NAMES))


def bins(x: np.ndarray, most: int) -> np.ndarray:
    """Cut points between distinct values, at equal shares of the rows."""
    values = np.unique(x)
    if len(values) <= 1:
        return np.empty(0)
    between = (values[1:] + values[:-1]) / 2
    if len(between) <= most:
        return between
    q = np.quantile(x, np.linspace(0, 1, most + 2)[1:-1])
    return np.unique(between[np.clip(np.searchsorted(between, q), 0, len(between) - 1)])


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, smooth: float) -> np.ndarray:
    """Values of a tree over ordered bins, grown leaf by leaf where the gain is largest."""
    G, H, N = (np.concatenate([[0], np.cumsum(a)]) for a in (g, h, n))
    score = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + smooth)

    def best(a: int, b: int):
        at = np.arange(a + 1, b)
        ok = at[(N[at] - N[a] >= least) & (N[b] - N[at] >= least)]
        if not len(ok):
            return 0.0, 0
        gain = score(a, ok) + score(ok, b) - score(a, b)
        k = int(gain.argmax())
        return float(gain[k]), int(ok[k])

    spans = [(0, len(g))]
    while len(spans) < leaves:
        gain, cut, i = max(((*best(*s), i) for i, s in enumerate(spans)), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        a, b = spans.pop(i)
        spans += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + smooth)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree over a grid that cuts one side once and each half of the other once."""
    best, values = 0.0, np.zeros(g.shape)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, a.shape[0]):
            gain, parts = -a.sum() ** 2 / (b.sum() + smooth), []
            for rows in (slice(0, cut), slice(cut, None)):
                gs, hs = a[rows].sum(0), b[rows].sum(0)
                G, H = np.cumsum(gs), np.cumsum(hs)
                each = G**2 / (H + smooth) + (G[-1] - G) ** 2 / (H[-1] - H + smooth)
                k = int(each.argmax())
                gain += each[k]
                parts.append((rows, k + 1, G[k] / (H[k] + smooth), (G[-1] - G[k]) / (H[-1] - H[k] + smooth)))
            if gain > best + 1e-9:
                best, v = gain, np.zeros(a.shape)
                for rows, k, left, right in parts:
                    v[rows, :k], v[rows, k:] = left, right
                values = v.T if turn else v
    return best, values


@dataclass
class Gam:
    """A table of scores for each feature and each chosen pair, and a constant; they add up to a logit."""

    constant: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1, leaves: int = 4, least: int = 10, smooth: float = 1.0) -> Gam:
        """Cyclic boosting: each round visits every feature with one shallow tree on the gradient, added to
        that feature's table; then the pairs with the largest gain on what is left, the same way."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self = cls(float(np.log(share / (1 - share))))
        if not len(y):
            return self
        self.cuts = [bins(c, CUTS) for c in x.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        at = [np.searchsorted(c, v) for c, v in zip(self.cuts, x.T, strict=True)]
        n = [np.bincount(a, minlength=len(t)) for a, t in zip(at, self.tables, strict=True)]
        logit = np.full(len(y), self.constant)

        def gradient():
            p = 1 / (1 + np.exp(-logit))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for a, t, m in zip(at, self.tables, n, strict=True):
                if len(t) > 1:
                    g, h = gradient()
                    step = rate * shallow_tree(np.bincount(a, g, len(t)), np.bincount(a, h, len(t)), m, leaves, least, smooth)
                    t += step
                    logit += step[a]
        coarse = [bins(c, PAIR_CUTS) for c in x.T]
        at = [np.searchsorted(c, v) for c, v in zip(coarse, x.T, strict=True)]

        def grid(i, j, v):
            shape = len(coarse[i]) + 1, len(coarse[j]) + 1
            return np.bincount(at[i] * shape[1] + at[j], v, shape[0] * shape[1]).reshape(shape)

        g, h = gradient()
        gains = [(quadrants(grid(i, j, g), grid(i, j, h), smooth)[0], i, j) for i in range(x.shape[1]) for j in range(i)]
        for gain, i, j in sorted(gains, reverse=True)[:pairs]:
            if gain > 0:
                self.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
        for _ in range(pair_rounds):
            for i, j, _, _, t in self.pairs:
                g, h = gradient()
                step = rate * quadrants(grid(i, j, g), grid(i, j, h), smooth)[1]
                t += step
                logit += step[at[i], at[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.constant)
        for c, t, v in zip(self.cuts, self.tables, x.T, strict=False):
            logit += t[np.searchsorted(c, v)]
        for i, j, a, b, t in self.pairs:
            logit += t[np.searchsorted(a, x[:, i]), np.searchsorted(b, x[:, j])]
        return 1 / (1 + np.exp(-logit))


def id_crc(doc_id):
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, folds: int = 3, held_out: int = 1) -> Gam:
    """Fit on at most `rows` labelled documents outside the held-out fold: those with the least hash.

    Null labels and ids count for nothing.  Without labels the model scores 0.5.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y")).where("doc_id is not null and _y is not null")
    chosen = own.where(id_crc(F.col("doc_id")) % folds != held_out).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)

    def prepare(batches):
        for batch in batches:
            x = matrix(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_y").mapInArrow(prepare, "doc_id long, y int, x array<double>")
    table = found.toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(table.num_rows, len(NAMES))
    y = table["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y, table["doc_id"].to_numpy()])
    return Gam.fit(x[order], y[order])


def score_quality(docs: DataFrame, gam: Gam, *keep: str, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep`, and score and predicted (under `names`), of every whole text; no shuffle."""
    held = [f"c{k}" for k in range(len(keep))]  # any names can be given, but not all may go to Python
    fields = [T.StructField(h, docs.schema[c].dataType) for h, c in zip(held, keep, strict=True)]

    def score(batches):
        turn_to_other_work()
        for batch in batches:
            texts = texts_of(batch)
            p = np.concatenate([np.empty(0), *(gam.score(matrix(texts[k : k + 512])) for k in range(0, len(texts), 512))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*held, "score", "predicted"])

    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    kept = [quoted(c).alias(h) for h, c in zip(held, keep, strict=True)]
    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(score, schema).toDF(*keep, *names)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of `docs` for quality as `labels` marks it.

    Inputs of a score come from the text alone.  Per document: doc_id, held_out (crc32 of the id as
    text, mod 3, is 1: never fitted on), score (0 to 1), predicted (1 if score >= 0.5).  Null and
    empty texts have a score like others; a null id is not held out; repeated rows are scored each;
    an empty table gives no rows; other columns are dropped.
    """
    gam = fit_quality(docs, labels)
    out = score_quality(id_text(docs), gam, "doc_id")
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, whole, that the classifier does not reject.

    Null and empty texts are scored like others, null ids and repeated rows each by their text; columns of
    any name, `score` or `predicted` too, come through unchanged.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    gam = fit_quality(docs, labels)
    score, predicted = free(docs, "score", "predicted")
    return score_quality(docs, gam, *docs.columns, names=(score, predicted)).where(F.col(predicted) == 1).select(*columns(docs))
