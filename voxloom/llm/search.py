"""Ranked lexical search over all documents: hybrid term-at-a-time and document-at-a-time evaluation.

The index is cut by documents into shards of bounded size. In a shard the short
lists of an item are read term at a time: their contributions are summed into
accumulators. These then count as one more list, with a bound of its own in each
block of documents, beside the long lists, which are read document at a time: a
block whose bounds do not add up to the item's tenth best score so far is
skipped in all long lists, and inside a block a document is given up as soon as
what it has and what the lists left may add is too little. Bounds are exact
integers, so nothing that ranks is lost. A task keeps ten documents an item over
all its shards, whose scores raise the bar for the next ones.

Items are taken in blocks of `block_bytes` of text, so what is sent to the tasks,
a block's terms and weights, is bounded, however many items there are. Counts of
documents and terms are sums over all documents.

A null or empty text, or one without a term, is not a document of the search and
is never found. Each row is a document: equal ids and repeated rows are ranked
row by row. Equal scores rank by ascending id, null ids last. Each row of the
items is an item; null or empty ones find nothing. Other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import batches_of, written
from voxloom.llm.words import runs_at

K = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: A list is short if it holds less than one in so many documents of the shard.
SHORT = 16
#: Documents that a long list steps over at once.
SPAN = 128
#: Groups in which an item's candidates are cut to K before they meet.
SALTS = 32

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = "ids array<{kind}>, sizes binary, terms array<int>, lengths array<int>, docs binary, tfs binary, n_docs bigint, n_terms bigint"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def raw_texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def indexed(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """A row for each shard: its documents' ids and numbers of terms, and for each
    term of the vocabulary that it holds, a list of documents with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary, 1)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches_of(batches, "_t", SHARD_BYTES):
            found, sizes = [], np.empty(batch.num_rows, np.int64)
            for i, raw in enumerate(raw_texts(batch.column("_t"))):
                words = terms_of(raw)
                sizes[i] = len(words)
                found.append(np.fromiter(filter(None, map(number, words)), np.int64))
            owner = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            pairs, tfs = np.unique(np.concatenate(found) * batch.num_rows + owner if found else np.empty(0, np.int64), return_counts=True)
            terms, lengths = np.unique(pairs // max(1, batch.num_rows), return_counts=True)
            where = (pairs % max(1, batch.num_rows)).astype(np.int32)
            yield pa.record_batch(
                [pa.array([batch.column("_k").to_pylist()], pa.list_(batch.column("_k").type)), pa.array([sizes.tobytes()], pa.binary()),
                 pa.array([(terms - 1).astype(np.int32)], pa.list_(pa.int32())), pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([where.tobytes()], pa.binary()), pa.array([tfs.astype(np.int64).tobytes()], pa.binary()),
                 pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())],
                ["ids", "sizes", "terms", "lengths", "docs", "tfs", "n_docs", "n_terms"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return written(rows.mapInArrow(index, INDEX.format(kind=kind)), "search-index")


class Shard:
    """The lists of a shard with the documents' shares of a term's weight, their
    most in each block, and where each block starts in each list."""

    def __init__(self, row: dict, n_all: int, terms_all: int, vocabulary: int):
        self.ids = row["ids"]
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.n = len(sizes)
        self.docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.full(vocabulary, -1, np.int64)
        self.place[np.array(row["terms"], np.int64)] = np.arange(len(self.lengths))
        # the product may pass 64 bits on a large corpus before it is divided
        m = np.array([25 + 75 * s * n_all // terms_all for s in sizes.tolist()], np.int64)
        self.shares = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[self.docs])
        self.blocks = -(-self.n // SPAN)
        self._long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long_list(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Of list `at`: the most that a document gets in each block, and the first posting of each block and the end."""
        if at not in self._long:
            start, end = self.starts[at], self.starts[at] + self.lengths[at]
            block = self.docs[start:end] // SPAN
            most = np.zeros(self.blocks, np.int64)
            np.maximum.at(most, block, self.shares[start:end])
            self._long[at] = most, start + np.searchsorted(block, np.arange(self.blocks + 1))
        return self._long[at]


@dataclass
class Query:
    item: object
    terms: np.ndarray
    weights: np.ndarray  # of a term times how often the item says it


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    @property
    def bar(self) -> int:
        """The least score that may still enter; an equal score may win by its id."""
        return max(1, -self.held[-1][0]) if len(self.held) == self.k else 1

    def offer(self, ids: list, docs: np.ndarray, scores: np.ndarray) -> None:
        self.held += [(-int(s), ids[d] is None, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        self.held.sort(key=lambda h: h[:2] if h[1] else h)
        del self.held[self.k :]


def search_shard(shard: Shard, query: Query, best: Best) -> None:
    at = shard.place[query.terms]
    here = (at >= 0) & (query.weights > 0)
    at, weights = at[here], query.weights[here]
    short = shard.lengths[at] * SHORT < shard.n
    # term at a time: the short lists become one list of sums
    few, w = at[short], weights[short]
    runs = runs_at(shard.starts[few], shard.lengths[few])
    sums = np.zeros(shard.blocks * SPAN, np.int64)
    np.add.at(sums, shard.docs[runs], shard.shares[runs] * np.repeat(w, shard.lengths[few]))
    # document at a time: the sums and the long lists, those that may add most first
    many = [(int(w), *shard.long_list(a)) for a, w in zip(at[~short].tolist(), weights[~short].tolist(), strict=True)]
    many.sort(key=lambda x: -x[0] * int(x[1].max()))
    bounds = sums.reshape(shard.blocks, SPAN).max(axis=1) if shard.blocks else np.empty(0, np.int64)
    for weight, most, _ in many:
        bounds = bounds + weight * most
    for block in np.flatnonzero(bounds >= best.bar).tolist():
        bar = best.bar
        if bounds[block] < bar:
            continue
        low = block * SPAN
        score = sums[low : low + SPAN].copy()
        left = sum(weight * int(most[block]) for weight, most, _ in many)
        for weight, most, first in many:
            if int(score.max()) + left < bar:
                break
            if most[block]:
                s, e = first[block], first[block + 1]
                score[shard.docs[s:e] - low] += weight * shard.shares[s:e]
                left -= weight * int(most[block])
        else:
            good = np.flatnonzero(score >= bar)
            if len(good):
                best.offer(shard.ids, good + low, score[good])


def queries_of(items: list[tuple[object, bytes]], counts: dict[int, int], number: dict[bytes, int], n_all: int) -> list[Query]:
    out = []
    for item, raw in items:
        said = Counter(t for t in terms_of(raw) if counts.get(number[t]))
        terms = np.array([number[t] for t in said], np.int64)
        weights = [math.floor(1000 * math.log((2 * n_all + 2) / (2 * counts[number[t]] + 1))) * c for t, c in said.items()]
        out.append(Query(item, terms, np.array(weights, np.int64)))
    return out


def _block(docs: DataFrame, items: list[tuple[object, bytes]], item_kind: str, k: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    vocabulary = sorted({t for _, raw in items for t in terms_of(raw)})
    index = indexed(docs, vocabulary, key, text)
    n_all, terms_all = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy("x.terms").agg(F.sum("x.lengths").alias("df"))
    counts = dict(zip(*held.toArrow().to_pydict().values(), strict=True))  # one row a term of the block
    sent = spark.sparkContext.broadcast(queries_of(items, counts, {t: i for i, t in enumerate(vocabulary)}, n_all))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "sizes", "terms", "lengths", "docs", "tfs")}
                shard = Shard(row, n_all, max(1, terms_all), len(vocabulary))
                for query, own in zip(sent.value, best, strict=True):
                    search_shard(shard, query, own)
        rows = [(at, q.item, h[2], -h[0]) for at, (q, own) in enumerate(zip(sent.value, best, strict=True)) for h in own.held]
        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), item_type, key_type, pa.int64()))], ["_at", "item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type, item_type = to_arrow_type(docs.schema[key].dataType), to_arrow_type(spark.createDataFrame([], f"x {item_kind}").schema["x"].dataType)
    found = index.mapInArrow(search, f"_at int, item_id {item_kind}, doc_id {kind}, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    apart = found.withColumn("_salt", F.spark_partition_id() % SALTS)
    apart = apart.withColumn("rank", F.row_number().over(Window.partitionBy("_at", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = apart.withColumn("rank", F.row_number().over(Window.partitionBy("_at").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items, the best first."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).alias("item_id"), F.col(item_text).cast("binary").alias("_q")).where("octet_length(_q) > 0")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("_q")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    item_kind = items.schema[item_key].dataType.simpleString()
    found = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item_id", "_q"), F.lit(blocks)) == b).orderBy("item_id", "_q").toArrow().to_pydict()
        part = _block(docs, list(zip(held["item_id"], held["_q"], strict=True)), item_kind, k, key, text)
        found = part if found is None else found.unionByName(part)
    return found
