"""Benchmark decontamination by latent semantic retrieval.

Texts become rows of word hashes once; every later pass reads those. TF-IDF
passages of all documents go through a distributed randomised SVD: each task
adds up its share of (A'A)R for a random R, the shares are summed by row chunks,
and the driver turns the summed sketch, a matrix of fixed size, into the right
singular vectors (Nystroem form). Passages and benchmark items are compared in
the whitened latent space. As the map is linear, windows of any length are
differences of running sums, so each item meets windows near its own length,
however short or long it is, at a stride of a sixth of it, over every document.
A window is checked with half of itself on each side, at least 1.5 times the item. Pairs whose cosine reaches
`near` are candidates, and all of them are checked by the longest common
subsequence with the item: a share of `copied` or more is a leak, a share of
`reworded` or more is one if the item's answer stands there too, its last
sentence. There is no cap on candidates.

A long text is read in spans that overlap by the longest stretch checked, and
running sums start anew in each, so a text of any length takes bounded memory.

Null and empty texts match nothing; an item without words, or a null one, is no
query; equal items are found each. Repeated rows yield a row for their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import batches_of, texts_of, written
from voxloom.llm.words import Growing, WordMemory, runs_at

BITS = 15
RANK = 64
PASSAGE = 32
SHORT, GROWTH = 10, 11**0.2  # windows from SHORT words on: 10, 16, 26, 42, 68, 110, 178 and so on
STRIDE = 6
NEAR = 0.65
COPIED, REWORDED, ANSWER = 0.75, 0.6, 0.8
CHUNKS = 64
SEED = 41
MANY = 16  # passages of a slice from which on a bucket's are summed by a product
RUN = 31  # words of a block of running sums
SLICE = 64_000  # words handled at a time, a multiple of PASSAGE
PUNCTUATION = ".,;:!?\"'()[]{}|-_*/\\<>«»…"


class Words:
    """32-bit hashes of the words of a text, in lower case and without punctuation around them."""

    def __init__(self):
        self.hashes = Growing(np.uint32)
        self.memory = WordMemory(self._learn, self.hashes.clear, 250_000)

    def _learn(self, words: list[str]) -> None:
        self.hashes.extend(np.fromiter((xxhash.xxh32_intdigest(w.lower().strip(PUNCTUATION) or w) for w in words), np.uint32, len(words)))

    def of(self, text: str) -> np.ndarray:
        numbers = self.memory.numbers(text.split())
        return self.hashes.values[numbers]


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """_k, words: each text as its word hashes, written to the shared folder."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches_of(batches, "_t"):
            yield pa.record_batch([batch.column("_k"), pa.array([words.of(t).tobytes() for t in texts_of(batch.column("_t"))], pa.binary())], ["_k", "words"])

    kind = df.schema[key].dataType.simpleString()
    return written(df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInArrow(made, f"_k {kind}, words binary"), "word-hashes")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The number of words of each text, and all their words, some texts or a span of a long one at a time."""
    for batch in batches_of(batches, "words", 4 * SLICE):
        texts = [np.frombuffer(b, np.uint32) for b in batch.column("words").to_pylist()]
        for _, _, lengths, words in spans(texts, 0):
            yield lengths, words


def spans(texts: list[np.ndarray], overlap: int, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts' words, some texts at a time and those of a long text in spans of
    `most` words besides the overlap: the first text's number, the place of its
    first word in it, and each text's number of words and all words."""
    first, held = 0, 0
    for i, t in enumerate([*texts, None]):
        if i > first and (t is None or held + len(t) > most):
            yield first, 0, np.array([len(x) for x in texts[first:i]], np.int64), np.concatenate(texts[first:i])
            first, held = i, 0
        if t is None:
            return
        held += len(t)
        if len(t) > most + overlap:
            for low in range(0, len(t) - overlap, most):
                part = t[low : low + most + overlap]
                yield i, low, np.array([len(part)], np.int64), part
            first, held = i + 1, 0


def _chunked(total: np.ndarray) -> pa.RecordBatch:
    """A matrix as rows (chunk, bytes)."""
    parts = np.array_split(np.ascontiguousarray(total), CHUNKS)
    return pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "part"])


def summed(shares: DataFrame, kind: str) -> list[bytes]:
    """The sums of the tasks' shares, chunk by chunk: each is added up as it streams in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
                found = np.frombuffer(part, kind)
                if chunk in totals:
                    totals[chunk] += found
                else:
                    totals[chunk] = found.copy()
        for chunk, total in totals.items():
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "part"])

    rows = shares.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, part binary").collect()
    return [r["part"] for r in sorted(rows, key=lambda r: r["chunk"])]


def inverse_frequencies(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """ln((1 + passages) / (1 + passages with the word)) by word bucket, over all passages."""
    size = 1 << bits

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + CHUNKS, np.int64)
        for lengths, words in slices(batches):
            rows = passages(lengths, words, bits)
            total[:size] += np.bincount(rows.ravel(), minlength=size + 1)[:size]
            total[size] += len(rows)
        yield _chunked(total)

    parts = summed(docs.mapInArrow(share, "chunk int, part binary"), "int64")
    total = np.concatenate([np.frombuffer(p, np.int64) for p in parts]) if parts else np.zeros(size + CHUNKS, np.int64)
    return np.log((1 + total[size]) / (1 + total[:size])).astype(np.float32)


def passages(lengths: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """A row of PASSAGE places for each passage of the texts: the buckets of its
    different words, and 2 ** bits in the places that are left."""
    each = -(-lengths // PASSAGE)
    before = np.cumsum(each) - each
    rows = np.full(int(each.sum()) * PASSAGE, 1 << bits, np.int32)
    rows[runs_at(before * PASSAGE, lengths)] = words >> np.uint32(32 - bits)
    rows = rows.reshape(-1, PASSAGE)
    rows.sort(axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = 1 << bits
    return rows


def row_sums(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of `values`, whose last row is zero, over the buckets of each passage; place by place, for all passages."""
    total = np.zeros((len(rows), values.shape[1]), values.dtype)
    for place in np.ascontiguousarray(rows.T):
        total += np.take(values, place, axis=0)
    return total


def spread(rows: np.ndarray, seen: np.ndarray, total: np.ndarray) -> None:
    """Adds what is `seen` of each passage to the `total` of each of its buckets: those
    of many passages by a product with their incidence, all others by their first passage, their second and so on."""
    flat = rows.ravel()
    held = np.flatnonzero(flat < len(total))
    counts = np.bincount(flat[held], minlength=len(total))
    kind = np.uint16 if len(total) <= 1 << 16 else np.int32
    at = held[np.argsort(flat[held].astype(kind), kind="stable")] // PASSAGE
    first = np.cumsum(counts) - counts
    many = np.flatnonzero(counts > MANY)
    step = max(1, (1 << 22) // max(1, len(rows)))
    for low in range(0, len(many), step):
        part = many[low : low + step]
        incidence = np.zeros((len(part), len(rows)), seen.dtype)
        incidence[np.repeat(np.arange(len(part)), counts[part]), at[runs_at(first[part], counts[part])]] = 1
        total[part] += incidence @ seen
    few = np.flatnonzero((counts > 0) & (counts <= MANY))
    few = few[np.argsort(-counts[few], kind="stable")]
    for nth in range(int(counts[few[0]]) if len(few) else 0):
        few = few[: int((counts[few] > nth).sum())]
        total[few] += seen[at[first[few] + nth]]


def running_sums(values: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The sums of the first 0, 1, 2, ... words' values, within blocks of words and
    then over the blocks, so that rounding grows with neither as it would along all words."""
    blocks = -(-len(buckets) // RUN)
    sums = np.zeros((blocks * RUN + 1, values.shape[1]), values.dtype)
    np.take(values, buckets, axis=0, out=sums[1 : len(buckets) + 1], mode="clip")
    inside = sums[1:].reshape(blocks, RUN, values.shape[1])
    for i in range(1, RUN):
        inside[:, i] += inside[:, i - 1]
    inside[1:] += np.cumsum(inside[:-1, -1], axis=0)[:, None]
    return sums


def latent_map(docs: DataFrame, weights: np.ndarray, rank: int = RANK, bits: int = BITS) -> np.ndarray:
    """What a word of each bucket adds to a passage's place in the whitened latent space."""
    size = 1 << bits
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def probe() -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((size, rank), np.float32)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        test = np.concatenate([probe() * weight[:, None], np.zeros((1, rank), np.float32)])
        total = np.zeros((size, rank), np.float32)
        for lengths, words in slices(batches):
            # a word counts once in a passage, so that runs of one word do not lead the axes
            rows = passages(lengths, words, bits)
            spread(rows, row_sums(rows, test), total)
        yield _chunked(total * weight[:, None])

    parts = summed(docs.mapInArrow(share, "chunk int, part binary"), "float32")
    if not parts:
        return np.zeros((size, rank), np.float32)
    sketch = np.concatenate([np.frombuffer(p, np.float32) for p in parts]).reshape(size, rank).astype(np.float64)
    core = probe().T.astype(np.float64) @ sketch
    value, vector = np.linalg.eigh((core + core.T) / 2)
    use = value > max(value.max(), 0) * 1e-9
    if not use.any():
        return np.zeros((size, rank), np.float32)
    factor = sketch @ (vector[:, use] / np.sqrt(value[use]))
    left, strength, _ = np.linalg.svd(factor, full_matrices=False)
    kept = strength > strength.max() * 1e-6
    return (weights[:, None] * left[:, kept] / strength[kept]).astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, by bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, every = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def window_for(n: int) -> int:
    """The window for an item of n words: as long for a short one, else the nearest step, at most 1.3 times longer or shorter."""
    return n if n < SHORT else round(SHORT * GROWTH ** round(np.log(n / SHORT) / np.log(GROWTH)))


def answer_of(text: str) -> str:
    """The last sentence of an item that has several, or its second half."""
    cut = max(text.rstrip(".!? \n").rfind(mark) for mark in (". ", ".\n", "? ", "?\n", "! ", "!\n"))
    if cut >= 0:
        return text[cut + 1 :]
    words = text.split()
    return " ".join(words[len(words) // 2 :])


class Query:
    def __init__(self, item_id, text: str, words: Words):
        self.item_id = item_id
        self.words = words.of(text)
        self.list, self.answer = self.words.tolist(), words.of(answer_of(text)).tolist()


def leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rank: int = RANK, near: float = NEAR,
    copied: float = COPIED, reworded: float = REWORDED, bits: int = BITS,
) -> DataFrame:
    """key, item, share, answer_share, at of each document and item that it leaks:
    the share of the item's words that stand there in order, and the first word of
    the window. The benchmark is a query set and goes to every task whole."""
    docs = hashed(df, key, text)
    weights = inverse_frequencies(docs, bits)
    mapped = latent_map(docs, weights, rank, bits)
    words = Words()
    queries = [q for r in benchmark.select(item, item_text).orderBy(item, item_text).collect() if (q := Query(r[0], r[1] or "", words)).list]
    scale = [window_for(len(q.list)) for q in queries]
    placed = np.array([mapped[(q.words >> np.uint32(32 - bits)).astype(np.int64)].sum(axis=0) for q in queries], np.float32).reshape(len(queries), mapped.shape[1])
    placed /= np.maximum(np.linalg.norm(placed, axis=1, keepdims=True), 1e-12)
    by_scale = [(s, np.flatnonzero(np.array(scale) == s)) for s in sorted(set(scale))]
    sent = df.sparkSession.sparkContext.broadcast((mapped, placed, queries, by_scale))
    kinds = df.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors, asked, scales = sent.value
        # whatever is checked lies whole in a span, with its window and what stands beside it
        overlap = max((size + 2 * max(4, size // 2) for size, _ in scales), default=0)
        for batch in batches_of(batches, "words", 4 * SLICE):
            kind, keys = batch.schema.field("_k").type, batch.column("_k").to_pylist()
            best: dict[tuple, tuple] = {}
            for first, low, lengths, hashes in spans([np.frombuffer(b, np.uint32) for b in batch.column("words").to_pylist()], overlap):
                for d, q, share, told, at in within(lengths, hashes, own, vectors, asked, scales):
                    now = (share, told, -(low + at))
                    best[first + d, q] = max(best.get((first + d, q), now), now)
            if best:
                found = [(keys[d], asked[q].item_id, share, told, -at) for (d, q), (share, told, at) in best.items()]
                columns = list(zip(*found, strict=True))
                yield pa.record_batch([pa.array(columns[0], kind), pa.array(columns[1]), *[pa.array(c, t) for c, t in zip(columns[2:], (pa.float64(), pa.float64(), pa.int64()), strict=True)]], ["_k", "_item", "share", "answer_share", "at"])

    def within(lengths, hashes, own, vectors, asked, scales):
        if not len(hashes):
            return
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sums = running_sums(own, (hashes >> np.uint32(32 - bits)).astype(np.int64))
        best: dict[tuple, tuple] = {}
        for size, which in scales:
            stride = max(1, size // STRIDE)
            room = np.maximum(lengths - size, 0)
            each = np.where(lengths > 0, -(-room // stride) + 1, 0)
            doc = np.repeat(np.arange(len(lengths)), each)
            at = starts[doc] + np.minimum(runs_at(np.zeros(len(each), np.int64), each) * stride, room[doc])
            to = np.minimum(at + size, ends[doc])
            place = sums[to] - sums[at]
            norm = np.sqrt(np.einsum("ij,ij->i", place, place))
            alike = place @ vectors[which].T
            rows, columns = np.divmod(np.flatnonzero(alike >= near * np.maximum(norm, 1e-12)[:, None]), len(which))
            wide = max(4, size // 2)
            for row, column in zip(rows.tolist(), columns.tolist(), strict=True):
                query, d = asked[which[column]], int(doc[row])
                low, high = max(int(at[row]) - wide, int(starts[d])), min(int(to[row]) + wide, int(ends[d]))
                here = hashes[low:high].tolist()
                share = common_subsequence(query.list, here) / len(query.list)
                if share < reworded:
                    continue
                told = common_subsequence(query.answer, here) / len(query.answer) if query.answer else 1.0
                if share >= copied or told >= ANSWER:
                    name = d, int(which[column])
                    now = (share, told, -(low - int(starts[d])))
                    best[name] = max(best.get(name, now), now)
        for (d, q), (share, told, at_) in best.items():
            yield d, q, share, told, -at_

    found = docs.mapInArrow(search, f"_k {kinds[0]}, _item {kinds[1]}, share double, answer_share double, at bigint")
    return found.withColumnsRenamed({"_k": key, "_item": item})
