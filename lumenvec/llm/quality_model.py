"""Quality classifier: supervised subword embeddings averaged per document.

Features of a document are its words, the character n-grams of each word with its borders marked,
and a mark for each word that repeats the one before it. Each feature is hashed to a row of a
learned matrix; the document is the mean of its rows, and a softmax over two classes follows. Both
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the
output is linear in the mean, scoring needs only each row's product with the output weights.

Null and empty texts have no feature and get the score of the bias alone. Repeated rows get equal
scores; long texts are read whole. If no row is labelled, the score is 0.5 everywhere. Extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import arrow_map, small_batches

BUCKETS = 1 << 18
DIMENSION = 12
GRAMS = (2, 3, 4)
#: Bounds of the labelled rows that training takes, and of their length.
MOST_LABELLED, MOST_CHARS = 4000, 20_000
REPEAT = b"<repeat>"


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of the n-grams of their code points, borders marked; and whose they are."""
    marked = [f"<{w.decode(errors='replace')}>" for w in words]
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    buckets = [np.fromiter((xxhash.xxh32_intdigest(w) % BUCKETS for w in words), np.int64, len(words))]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        if len(codes) < n:
            continue
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        mixed = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(16777619)
        buckets.append(((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)[inside])
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = Counter(words)
    if repeats := sum(map(bytes.__eq__, words, words[1:])):
        counts[REPEAT] += repeats
    buckets, owner = word_features(list(counts))
    at, inverse = np.unique(buckets, return_inverse=True)
    share = np.bincount(inverse, np.array(list(counts.values()), float)[owner])
    return at, share / share.sum()


class Model:
    """The bias, and the value of each bucket: its vector's product with the output weights."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias

    def sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the values of each word's features, and their number."""
        buckets, owner = word_features(words)
        return np.bincount(owner, self.values[buckets], len(words)), np.bincount(owner, minlength=len(words))


class Scorer:
    """Scores texts; remembers the sums of a bounded number of words."""

    def __init__(self, model: Model, most_known: int = 500_000):
        self.model, self.most_known = model, most_known
        (total,), (n,) = model.sums([REPEAT])
        self.repeat = total, n
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.total, self.n = np.zeros(0), np.zeros(0, np.int64)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        if len(self.known) > self.most_known:
            self.forget()
        get = self.known.get
        found = [[get(w, -1) for w in words] for words in split]
        new = list(dict.fromkeys(w for words, f in zip(split, found, strict=True) for w, k in zip(words, f, strict=True) if k < 0))
        if new:
            self.known |= dict(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            total, n = self.model.sums(new)
            self.total, self.n = np.concatenate([self.total, total]), np.concatenate([self.n, n])
        out = np.full(len(texts), self.model.bias)
        for k, (words, f) in enumerate(zip(split, found, strict=True)):
            if words:
                at = np.array(f)
                if at.min() < 0:
                    at = np.array([get(w) for w in words])
                repeats = sum(map(bytes.__eq__, words, words[1:]))
                out[k] += (self.total[at].sum() + repeats * self.repeat[0]) / (self.n[at].sum() + repeats * self.repeat[1])
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(texts: list[bytes], labels: np.ndarray, rate: float = 0.4, steps: int = 8_000, seed: int = 1) -> Model:
    """Softmax regression on learned averages, one document a step, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSION)), np.zeros(2)
    if len(set(labels.tolist())) < 2:
        sure = 0.0 if not len(labels) else (10.0 if labels[0] else -10.0)
        return Model(np.zeros(BUCKETS, np.float32), sure)
    data = [document_features(t) for t in texts]
    epochs = max(3, -(-steps // len(data)))
    # Classes weigh alike, so the rarer one is learned as well.
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    total, step = epochs * len(data), 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            now = rate * (1 - step / total)
            step += 1
            at, share = data[k]
            rows = table[at]
            hidden = share @ rows
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]]
            if len(at):
                # The share of a row is small; scaling by the largest keeps the steps of useful size.
                table[at] = rows - (now * share / share.max())[:, None] * (p @ out)
            out -= now * np.outer(p, hidden)
            bias -= 0.1 * now * p
    difference = out[1] - out[0]
    return Model((table @ difference).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Rows that training must not see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_chars: int = MOST_CHARS) -> pa.Table:
    """At most ``most`` labelled rows that are not held out, with texts of at most ``most_chars``: ``doc_id, _quality, text``.

    Which rows are taken depends on hashes of id and text only. The ids, bounded by ``most``, are
    broadcast to find their texts; the bound holds again after that, as ids may repeat.
    """
    key = F.md5(F.col("doc_id").cast("string"))
    seen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col("quality").cast("int").alias("_quality"))
        .orderBy(key, "_quality").limit(most)
    )
    small_batches(docs)
    return (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
        .filter(F.length("text") <= most_chars).join(F.broadcast(seen), "doc_id").select("doc_id", "_quality", "text")
        .orderBy(key, "_quality", F.xxhash64("text")).limit(most).toArrow()
        .sort_by([("doc_id", "ascending"), ("_quality", "ascending"), ("text", "ascending")])
    )


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_chars: int = MOST_CHARS) -> Model:
    """Train on ``training_rows`` of ``docs (doc_id, text)`` and ``labels (doc_id, quality)``."""
    rows = training_rows(docs, labels, most, most_chars)
    return train(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("_quality").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``; one pass, no shuffle, the model's megabyte is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(texts))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, score double")
