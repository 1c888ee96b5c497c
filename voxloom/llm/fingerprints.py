"""I-Match document fingerprints over a lexicon of middling document frequency.

A term is a word in lower case without punctuation around it. The lexicon keeps
terms that stand in at least `low` and at most `high` of all documents, so it
has at most (mean distinct terms of a document) / `low` entries whatever the
size of the corpus: that is the bound of what is broadcast. Randomised subsets
of it keep a term with a chance of 1/2, 1/8, ... for several seeds each. A
document's sorted distinct terms within a subset are hashed to three hexadecimal
digits; the first sixteen digits hash the whole text.

Likeness looks at the sparsest rate at which half of the subsets or more hold a
term of either document, and is the share of those subsets whose hashes are
equal; equal fingerprints are alike by 1, and documents without terms of the
lexicon by 0 unless they are equal. A null text is empty; repeated rows get a
row each; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import batches_of, long_array, parts_for, range_of, ranged, texts_of
from voxloom.llm.words import Growing, WordMemory

LOW, HIGH = 1e-4, 0.1
SEEDS = 16
DIGITS = 3
NONE = "-" * DIGITS
RATES = (1, 3, 5, 7, 9, 11)  # a term is kept with a chance of 2 to the power of minus this
PUNCTUATION = ".,;:!?\"'()[]{}|-_*/\\<>«»…"
FLUSH = 2_000_000


class Terms:
    """Term hashes of texts; 0 for a word without letters or digits, or outside the lexicon."""

    def __init__(self, lexicon: np.ndarray | None = None):
        self.lexicon, self.hashes = lexicon, Growing(np.uint64)
        self.memory = WordMemory(self._learn, self.hashes.clear)

    def _learn(self, words: list[str]) -> None:
        hashes = np.fromiter((xxhash.xxh64_intdigest(t) if (t := w.lower().strip(PUNCTUATION)) else 0 for w in words), np.uint64, len(words))
        if self.lexicon is not None and len(hashes):
            if len(self.lexicon):
                at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
                hashes = np.where(self.lexicon[at] == hashes, hashes, np.uint64(0))
            else:
                hashes = np.zeros_like(hashes)
        self.hashes.extend(hashes)

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct term hashes."""
        words = text.split()
        if not words:
            return np.empty(0, np.uint64)
        numbers = self.memory.numbers(words)
        found = np.unique(self.hashes.values[numbers])
        return found[1:] if len(found) and found[0] == 0 else found


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """term (hash), n_docs over all documents; counted within each task before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, keys, sums = Terms(), [], []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, weight = np.concatenate(keys), np.concatenate(sums)
            found, place = np.unique(every, return_inverse=True)
            return found, np.bincount(place, weights=weight, minlength=len(found)).astype(np.int64)

        def out(pair):
            return pa.record_batch([pa.array(pair[0].view(np.int64)), pa.array(pair[1])], ["term", "n_docs"])

        for batch in batches_of(batches, text):
            every = [terms.of(t) for t in texts_of(batch.column(text))]
            found, n = np.unique(np.concatenate(every), return_counts=True)
            keys.append(found)
            sums.append(n.astype(np.int64))
            if sum(map(len, keys)) > FLUSH:
                pair = merged()
                if len(pair[0]) > FLUSH // 2:
                    yield out(pair)
                    keys, sums = [], []
                else:
                    keys, sums = [pair[0]], [pair[1]]
        if keys:
            yield out(merged())

    return df.select(text).mapInArrow(counted, "term bigint, n_docs bigint").groupBy("term").agg(F.sum("n_docs").alias("n_docs"))


def lexicon_of(df: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The sorted term hashes within the band. Their number is bounded by `low`, not by the corpus."""
    n = df.count()
    band = document_frequencies(df, text).where(F.col("n_docs").between(max(1, int(np.ceil(n * low))), max(2, int(n * high))))
    return np.sort(band.select("term").toArrow().column(0).to_numpy().view(np.uint64))


_SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1 for seed in range(SEEDS)], np.uint64)
_HEX = [f"{i:0{DIGITS}x}" for i in range(16**DIGITS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def fingerprint(text: str, terms: np.ndarray) -> str:
    """Sixteen digits of the text, then three for each rate and seed; --- where a
    subset holds no term. The subsets of a seed lie in one another, so each rate
    looks only at what the one before it kept; terms come sorted and distinct,
    and a subset's hash is that of the sum of theirs and their number."""
    chance = _mixed(terms[None, :] ^ _SEEDS[:, None]).ravel()
    seed = np.repeat(np.arange(SEEDS), len(terms))
    parts = [f"{xxhash.xxh64_intdigest(text):016x}"]
    with np.errstate(over="ignore"):
        for rate in RATES:
            keep = chance < np.uint64(1 << (64 - rate))
            chance, seed = chance[keep], seed[keep]
            held = np.bincount(seed, minlength=SEEDS)
            sums = np.r_[np.uint64(0), np.cumsum(chance, dtype=np.uint64)]
            ends = np.cumsum(held)
            digits = _mixed(sums[ends] - sums[ends - held] + held.astype(np.uint64)) >> np.uint64(64 - 4 * DIGITS)
            parts += [_HEX[d] if n else NONE for d, n in zip(digits.tolist(), held.tolist(), strict=True)]
    return "".join(parts)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    for rate in reversed(range(len(RATES))):
        low = 16 + DIGITS * SEEDS * rate
        pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(low, low + DIGITS * SEEDS, DIGITS)]
        held = [x == y for x, y in pairs if (x, y) != (NONE, NONE)]
        if 2 * len(held) >= SEEDS or not rate and held:
            return sum(held) / len(held)
    return 0.0


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """key, fingerprint of every document."""
    lexicon = df.sparkSession.sparkContext.broadcast(lexicon_of(df, text, low, high))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(lexicon.value)
        for batch in batches_of(batches, text):
            texts = texts_of(batch.column(text))
            yield pa.record_batch([batch.column(key), pa.array([fingerprint(t, terms.of(t)) for t in texts], pa.string())], [key, "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(made, f"`{key}` {kind}, fingerprint string")


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by ranges of the integer key (null: first of all), each range
    closed by a copy of the first row of the next one, the last by the first of
    all; copies are marked in `_over`. Only a head for each range passes the driver."""
    rows = df.select(F.col(key).cast("bigint").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_o", F.coalesce(F.col("_k"), F.lit(-(1 << 63))))
    dealt, _ = ranged(rows, "_o", 4 * parts_for(df))
    firsts = sorted((r["_range"], r["_o"]) for r in dealt.groupBy("_range").agg(F.min("_o").alias("_o")).collect())
    own = F.struct("_range", F.lit(0).alias("_over"))
    if not firsts:
        copies = F.array(own)
    else:
        heads = [o for _, o in firsts]
        place = range_of(F.col("_o"), heads)
        to = F.get(long_array([firsts[i - 1][0] for i in range(len(firsts))]), place).cast("int")
        is_head = F.get(long_array(heads), place) == F.col("_o")
        copies = F.when(is_head, F.array(own, F.struct(to.alias("_range"), F.lit(1).alias("_over")))).otherwise(F.array(own))
    return dealt.select("_k", "_o", "_t", F.explode(copies).alias("_c")).select("_k", "_o", "_t", "_c._range", "_c._over")


def edited_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """For each document in ascending order of the key: fingerprints of its text
    and of its edited text, whose last quarter is the start of the next text."""
    import hashlib

    lexicon = df.sparkSession.sparkContext.broadcast(lexicon_of(df, text, low, high))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, last = Terms(lexicon.value), None
        for batch in batches_of(batches, "_t"):
            out = []
            for k, t, r, over in zip(batch.column("_k").to_pylist(), texts_of(batch.column("_t")), batch.column("_range").to_pylist(), batch.column("_over").to_pylist(), strict=True):
                print_ = fingerprint(t, terms.of(t)) if last is not None and last[2] == r or not over else None
                if last is not None and last[2] == r:
                    lk, lt, _, lp = last
                    quarter = len(lt) // 4
                    edited = lt[: len(lt) - quarter] + t[:quarter]
                    ep = fingerprint(edited, terms.of(edited)) if edited != lt else lp
                    out.append((lk, len(lt), hashlib.sha256(edited.encode()).hexdigest(), lp, ep, likeness(lp, ep), likeness(lp, print_)))
                last = None if over else (k, t, r, print_)
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch(
                [pa.array(c, kind) for c, kind in zip(columns, (batch.schema.field("_k").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                ["_k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    ready = with_next(df, key, text).repartition(parts_for(df), "_range").sortWithinPartitions("_range", "_over", "_o", "_t")
    schema = "_k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ready.mapInArrow(made, schema).withColumnRenamed("_k", key)
