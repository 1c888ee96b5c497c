"""A quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document, with a softmax output.

A document is the mean of the vectors of its words, of their character 3- to
5-grams (bytes, with a mark on each side), and of its pairs of neighbouring
words; a word beside itself is one shared pair. Training is stochastic gradient
descent in numpy over a bounded, documented sample of labelled documents, those
with the smallest hash of their id; scoring reads every whole text. As the
output is linear in the mean, each vector comes down to one number at scoring.

A null or empty text has no feature and gets the score of the bias alone.
Repeated rows get a row each; a null id is no row's label and is neither held out
nor not, its `held_out` is null. Without a labelled row every score is 0.5; with
one class only, the score of that class's share.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import apart, batches_of, lean, texts_of
from voxloom.llm.words import Growing, WordMemory, runs_at

BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 8
STEPS = 12_000  # at least so many, however few the labelled rows
RATE = 0.6
SAMPLE = 4_000
THRESHOLD = 0.3
NGRAMS = (3, 4, 5)
SEED = 17

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return ((x >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word one after another, how many each has, and a 64-bit hash of each word."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8).astype(np.uint64)
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(total)  # bytes from here to the end of the word
    owner = np.repeat(np.arange(len(raw)), sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(max(int(sizes.max(initial=1)), 1), _A, np.uint64))
        whole = np.add.reduceat(flat[:total] * powers[np.arange(total) - np.repeat(starts, sizes)], starts) if total else np.empty(0, np.uint64)
        whole ^= whole >> np.uint64(32)
        ids, owners = [_bucket(whole * _A + np.uint64(1), buckets)], [np.arange(len(raw))]
        gram = flat[:total].copy()
        for n in range(2, max(NGRAMS) + 1):
            gram |= flat[n - 1 : n - 1 + total] << np.uint64(8 * (n - 1))
            if n in NGRAMS:
                at = np.flatnonzero(left >= n)
                ids.append(_bucket((gram[at] + np.uint64(n)) * _A, buckets))
                owners.append(owner[at])
    every, whose = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return every[order], np.bincount(whose, minlength=len(raw)), whole


def pair_features(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Features of neighbouring words; bucket 0 is a word beside itself."""
    a, b = hashes[:-1], hashes[1:]
    with np.errstate(over="ignore"):
        return np.where(a == b, 0, _bucket((a * _B + b) * _A, buckets))


class Features:
    def __init__(self, buckets: int):
        self.buckets = buckets
        self.flat, self.starts, self.sizes, self.hashes = Growing(np.int32), Growing(np.int64), Growing(np.int64), Growing(np.uint64)
        self.memory = WordMemory(self._learn, self._forget, 200_000)

    def _learn(self, words: list[str]) -> None:
        ids, sizes, hashes = word_features(words, self.buckets)
        self.starts.extend(self.flat.size + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.flat.extend(ids)
        self.hashes.extend(hashes)

    def _forget(self) -> None:
        for x in (self.flat, self.starts, self.sizes, self.hashes):
            x.clear()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of a text and how often each stands in it."""
        words = text.split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        n = self.memory.numbers(words)
        own = self.flat.values[runs_at(self.starts.values[n], self.sizes.values[n])]
        counts = np.bincount(own, minlength=self.buckets) + np.bincount(pair_features(self.hashes.values[n], self.buckets), minlength=self.buckets)
        ids = np.flatnonzero(counts)
        return ids.astype(np.int32), counts[ids].astype(np.int32)


@dataclass
class Model:
    """What scoring needs: a number for each feature, and the bias."""

    weight: np.ndarray
    bias: float


def trained(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over (features, counts, label)."""
    random = np.random.default_rng(SEED)
    vectors = (random.random((buckets, dimensions), np.float32) - 0.5) / dimensions
    output = np.zeros((2, dimensions), np.float32)
    n = np.array([sum(1 for r in rows if r[2] == c) for c in (0, 1)], np.float64)
    bias = np.log((n + 1e-6) / (n.sum() + 2e-6)).astype(np.float32) if n.sum() else np.zeros(2, np.float32)
    epochs = max(epochs, -(-STEPS // max(1, len(rows))))
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            ids, counts, label = rows[i]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= now * np.outer(p, mean)
            bias -= now * np.float32(0.02) * p
            # a feature of many in a text moves by its share; the length of the text is made up for
            vectors[ids] -= now * np.sqrt(np.float32(len(ids))) * np.outer(share, back)
    return Model(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.buckets = model, len(model.weight)
        self.sums, self.sizes, self.hashes = Growing(np.float64), Growing(np.int64), Growing(np.uint64)
        self.memory = WordMemory(self._learn, self._forget, 250_000)

    def _learn(self, words: list[str]) -> None:
        ids, sizes, hashes = word_features(words, self.buckets)
        self.sums.extend(np.add.reduceat(self.model.weight[ids].astype(np.float64), np.cumsum(sizes) - sizes))
        self.sizes.extend(sizes)
        self.hashes.extend(hashes)

    def _forget(self) -> None:
        for x in (self.sums, self.sizes, self.hashes):
            x.clear()

    def score(self, text: str) -> float:
        words = text.split()
        z = self.model.bias
        if words:
            n = self.memory.numbers(words)
            pairs = pair_features(self.hashes.values[n], self.buckets)
            z += float(self.sums.values[n].sum() + self.model.weight[pairs].sum(dtype=np.float64)) / float(self.sizes.values[n].sum() + len(pairs))
        return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0


def held_out(key: Column, folds: int = 5) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """A model of at most `sample` labelled rows outside the held-out fold. One
    task trains on their features, at most `buckets` a row; the driver gets the
    model, a number for each bucket."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    # a key that repeats with both labels counts by the larger; the sample is small and so broadcast
    chosen = usable.groupBy(key).agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, F.col(text).alias("_t")).join(F.broadcast(chosen), key).select(F.col(key).alias("_k"), "_label", "_t")

    @lean
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches_of(batches, "_t"):
            pairs = [features.of(t) for t in texts_of(batch.column("_t"))]
            yield pa.record_batch(
                [batch.column("_k"), batch.column("_label"), pa.array([a.tobytes() for a, _ in pairs], pa.binary()), pa.array([b.tobytes() for _, b in pairs], pa.binary())],
                ["_k", "_label", "ids", "counts"],
            )

    @lean
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for k, y, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("_k", "_label", "ids", "counts")), strict=True):
                got.append((k, ids, counts, int(y > 0)))
        got.sort(key=lambda r: r[:2])
        model = trained([(np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32), y) for _, ids, counts, y in got], buckets)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    kind = docs.schema[key].dataType.simpleString()
    features = rows.mapInArrow(found, f"_k {kind}, _label int, ids binary, counts binary")
    return pickle.loads(features.repartition(1).mapInArrow(train, "model binary").first()["model"])


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs and `_score`, from 0 to 1: how likely label 1 is. More
    underscores stand before it where docs has names that begin with one."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), apart(docs) + "score"

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches_of(batches, text):
            scores = pa.array([scorer.score(t) for t in texts_of(batch.column(text))], pa.float64())
            yield pa.record_batch([*batch.columns, scores], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, {name} double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )
