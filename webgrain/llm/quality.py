"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import map_rows, numbered, pick

#: Hashed vectors and their width; character n-gram sizes in bytes; bytes of texts that are scored at a time.
BUCKETS, DIM, GRAMS, AT_ONCE = 1 << 16, 16, (3, 4), 1 << 18
#: Bounds of what is learned from: labelled rows of each class, and characters of a text.
TRAIN_ROWS, TRAIN_CHARS = 1500, 20_000
#: Steps of gradient descent, one row each: the rows are gone through as often as that takes.
STEPS, RATE, SEED = 9000, 0.5, 7


#: An odd number whose powers modulo 2**64 weigh the bytes of a word, and its inverse.
WEIGHT = 0x9E3779B97F4A7C15
_INVERSE = pow(WEIGHT, -1, 1 << 64)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(base: int, which: int, n: int) -> np.ndarray:
    """A base to the powers 0 to n at least, modulo 2**64; remembered up to a size."""
    have = _POWERS[which]
    if len(have) <= n:
        have = np.full(max(n + 1, 2 * len(have)), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * AT_ONCE:
            _POWERS[which] = have
    return have


def bucket(values: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of 64-bit values; each kind of feature is hashed its own way."""
    return ((values + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)


def spaced(text: str | None) -> bytes:
    """The words of a text, a space before and behind each; an empty text is one empty word."""
    return f" {' '.join((text or '').split())} ".encode()


def features(raw: bytes, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and buckets of spaced words, pairs of words, and n-grams of words with the spaces at both ends as marks.

    All words at once: n-grams are numbers of their bytes, words differences of weighted
    prefix sums. An n-gram with a space inside it is none, nor is what lies before the
    ``first`` bytes of texts.
    """
    b = np.frombuffer(raw, np.uint8)
    space = b == 32
    wide = b.astype(np.uint64)
    for n in GRAMS:
        if len(b) >= n:
            inside = space[1 : len(b) - n + 2].copy()
            for i in range(2, n - 1):
                inside |= space[i : len(b) - n + 1 + i][: len(inside)]
            at = np.flatnonzero(~inside[: len(b) - n + 1])
            value = wide[at]
            for i in range(1, n):
                value = value << np.uint64(8) | wide[at + i]
            yield at, bucket(value, n)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((wide + np.uint64(1)) * powers(WEIGHT, 0, len(b))[: len(b)], out=sums[1:])
    cuts = np.flatnonzero(space)
    start, end = cuts[:-1] + 1, cuts[1:]
    begins = np.zeros(len(b) + 1, bool)
    begins[first] = True
    own = ~begins[start]
    start, end = start[own], end[own]
    word = (sums[end] - sums[start]) * powers(_INVERSE, 1, len(b))[start]
    yield start, bucket(word, 0)
    # Two words in a row by the difference of their values. Of all words said twice it is the same, so that
    # immediate repetition, a sign of bad text in any language, is learned once and not for each word anew.
    beside = np.flatnonzero(end[:-1] + 1 == start[1:])
    yield start[beside], bucket(word[beside + 1] - word[beside], 1)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    return np.unique(np.concatenate([found for _, found in features(spaced(text), np.zeros(1, np.int64))]), return_counts=True)


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket vectors, output weights and biases by stochastic gradient descent on the softmax loss.

    Both classes weigh the same. With no rows of one class the model says the other.
    """
    rng = np.random.default_rng(SEED)
    vectors = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
    weights, bias = np.zeros((DIM, 2)), np.zeros(2)
    if not labels:
        return vectors, weights, bias
    bags = [bag(t) for t in texts]
    share = np.bincount(labels, minlength=2) / len(labels)
    passes = -(-STEPS // len(bags))
    steps, step = passes * len(bags), 0
    for _ in range(passes):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, n = bags[i]
            part = (n / n.sum())[:, None]
            hidden = (vectors[at] * part).sum(0)
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= 0.5 / share[labels[i]]
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= rate * p
            # A document's step is shared by its buckets; the factor makes up for the averaging.
            vectors[at] -= rate * np.sqrt(len(at)) * part * back
    return vectors, weights, bias


class Scorer:
    """Scores texts with a trained model: the average over features is linear, so each bucket adds a number."""

    def __init__(self, by_bucket: np.ndarray, bias: float):
        self.by_bucket, self.bias = by_bucket.astype(np.float64), bias

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """Probability of label 1 for each whole text, about ``AT_ONCE`` bytes or one longer text at a time."""
        out: list[float] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(spaced(text))
            size += len(held[-1])
            if size >= AT_ONCE:
                out += self._scored(held)
                held, size = [], 0
        return out + self._scored(held) if held else out

    def _scored(self, raw: list[bytes]) -> list[float]:
        size = np.array([len(r) for r in raw])
        first = np.cumsum(size) - size
        total, n = np.zeros(len(raw)), np.zeros(len(raw))
        for at, found in features(b"".join(raw), first):
            # Each text adds up its own features in their order, so its score doesn't depend on the texts beside it.
            cut = np.searchsorted(at, first)
            count = np.diff(np.append(cut, len(at)))
            some = count > 0
            n += count
            if len(at):
                total[some] += np.add.reduceat(self.by_bucket[found], cut[some])
        z = np.clip(total / n + self.bias, -700, 700)
        return (1 / (1 + np.exp(-z))).tolist()


def held_out(key: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Scorer:
    """Learn from at most ``TRAIN_ROWS`` labelled rows of each class, those of the smallest hash of their id.

    Texts longer than ``TRAIN_CHARS`` are scored but not learned from, so what reaches
    the driver is bounded; ids without a shorter text take no part in the choice. Of rows
    of one id the least text counts, chosen before they meet. Held-out rows, rows with
    nulls or other labels, and ids with both labels are not learned from.
    """
    marked = pick(labels, key=key, label=label).where(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out("key"))
    marked = marked.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    marked = marked.select("key", "label", F.xxhash64("key").alias("order"))
    rows = pick(docs, key=key, text=text).where(F.length("text") <= TRAIN_CHARS)
    marked = marked.join(rows.select("key"), "key", "left_semi")
    chosen = None
    for k in (0, 1):
        part = marked.where(F.col("label") == k).orderBy("order", "key").limit(TRAIN_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    got = rows.join(F.broadcast(chosen), "key").groupBy("order", "key", "label").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r["order"], r["key"]))
    vectors, weights, bias = train([r["text"] for r in got], [int(r["label"]) for r in got])
    return Scorer((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep: float = 0.7) -> DataFrame:
    """``key, held_out, score, predicted`` of every row; only the text goes into a score.

    Null texts count as empty. Repeated rows are scored alike. ``predicted`` is 1 from a
    score of ``keep`` on.
    """
    model = fit(docs, labels, text, key, label)
    weights, bias = model.by_bucket, model.bias

    def start():
        scorer = Scorer(weights, bias)

        def apply(x: dict[str, list]) -> dict[str, list]:
            scores = scorer.scores(x["text"])
            return {"key": x["key"], "score": scores, "held_out": x["held_out"], "predicted": [int(s >= keep) for s in scores]}

        return apply

    rows = pick(docs, key=key, text=text).withColumn("held_out", held_out("key"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, held_out boolean, score double, predicted int", start).withColumnRenamed("key", key)


def keep_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep: float = 0.7) -> DataFrame:
    """The rows whose whole text scores ``keep`` or more, with all their columns and no shuffle.

    Null texts count as empty; repeated rows stay or go together; other columns, whatever
    their names, are left as they are.
    """
    model = fit(docs, labels, text, key, label)
    weights, bias = model.by_bucket, model.bias

    def accepted(batches):
        import pandas as pd

        scorer = Scorer(weights, bias)
        for texts in batches:
            yield pd.Series([s >= keep for s in scorer.scores(texts)], dtype=bool)

    import pandas as pd

    accepted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    plain, at = numbered(docs)
    return plain.where(F.pandas_udf(accepted, "boolean")(F.col(at(text)))).toDF(*docs.columns)
