"""Near-duplicate join: Jaccard similarity of word shingles, with Bayesian pruning of candidate pairs.

Texts with equal shingle sets are one node of the join and weighed by their
number. Nodes that agree in a band of MinHash values are candidates. Nodes that
candidates connect are dealt into blocks of bounded size, and each two blocks of
a connected set meet once, in a task of their own. There the pairs that agree in
a band compare their MinHash values step by step; a pair is dropped as soon as
the posterior probability, under a uniform prior, that its similarity reaches
the threshold is below the tolerance. All that are left are verified exactly.
Only sums and a spanning star leave a task, so pairs are never rows.

With 25 bands of 5 values a pair at the threshold of 0.8 is missed as candidate
with a chance of 5e-5, and one above it with less; pruning adds `tolerance`.

Words are the lower-case text cut at white space. A text of fewer words than a
shingle has one shingle, all its words; null texts, empty ones and white space
are one set without shingles, alike to one another and to nothing else. Null
ids, equal ids and repeated rows get a row each, judged by its own text; a class
of null ids alone has a null class_id. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import batches_of, lean, parts_for, settled, texts_of
from voxloom.llm.graph import components
from voxloom.llm.words import Growing, WordMemory

WORDS = 5
THRESHOLD = (4, 5)  # 0.8, as a fraction, so that the check is exact
BANDS, ROWS = 25, 5
STEP = 25
TOLERANCE = 1e-6
BLOCK = 256
SEED = 29

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, Growing(np.uint64)
        self.memory = WordMemory(self._learn, self.hashes.clear, 250_000)

    def _learn(self, words: list[str]) -> None:
        self.hashes.extend(np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)))

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        numbers = self.memory.numbers(words)
        h = self.hashes.values[numbers]
        n = max(1, len(h) - self.words + 1)
        with np.errstate(over="ignore"):
            out = np.zeros(n, np.uint64)
            for i in range(min(self.words, len(h))):
                out = (out ^ h[i : i + n]) * _MIX
                out ^= out >> np.uint64(29)
        return np.unique(out)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.full(len(by), 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(out, (shingles[at : at + 512, None] * by).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(values: int, step: int, threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the least matches for which the posterior
    that the similarity reaches the threshold is not below the tolerance. With a
    uniform prior that posterior is the chance of at most m hits in n + 1 trials."""
    out = {}
    for n in range(step, values + 1, step):
        chance, m = 0.0, -1
        while chance < tolerance and m < n:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def sketches(df: DataFrame, key: str, text: str, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """_k, _h (hash of the text), node (hash of the shingle set), n_shingles, sig and the hashes of its bands."""

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, by = Shingles(words), multipliers(bands * rows)
        for batch in batches_of(batches, "_t"):
            nodes, counts, sigs, cut = [], [], [], []
            for t in texts_of(batch.column("_t")):
                own = shingles.of(t)
                sig = signature(own, by)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                counts.append(len(own))
                sigs.append(sig.tobytes())
                cut.append([xxhash.xxh64_intdigest(sig[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)] if len(own) else [])
            yield pa.record_batch(
                [batch.column("_k"), batch.column("_h"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary()),
                 pa.array([np.array(c, np.uint64).view(np.int64) for c in cut], pa.list_(pa.int64()))],
                ["_k", "_h", "node", "n_shingles", "sig", "bands"],
            )

    kind = df.schema[key].dataType.simpleString()
    made = _texts(df, key, text).mapInArrow(sketch, f"_k {kind}, _h bigint, node bigint, n_shingles int, sig binary, bands array<bigint>")
    return settled(made)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """_k, _t and _h, which together with _k names the text where keys repeat or are null."""
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return rows.withColumn("_h", F.xxhash64("_t"))


def linked_in_blocks(members: DataFrame, words: int, bands: int, rows: int, threshold: tuple[int, int], step: int, tolerance: float, block: int) -> DataFrame:
    """node, links, root for each node of members(node, root, copies, sig, _t)
    and each meeting of two blocks: the weight of its links there, and the least
    node that they connect it to."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    dealt = members.join(sizes, "root").withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    meetings = dealt.select(
        "root", "node", "copies", "sig", "_t", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o")
    ).select("root", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "node", "copies", "sig", "_t")
    least = least_matches(bands * rows, step, threshold[0] / threshold[1], tolerance)

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        held, at = [], None
        for batch in batches_of(batches, "_t"):
            for root, i, j, b, node, copies, sig, t in zip(*(batch.column(c).to_pylist() for c in ("root", "_i", "_j", "_b", "node", "copies", "sig", "_t")), strict=True):
                if (root, i, j) != at:
                    if held:
                        yield from emitted(met(held, at, bands, rows, threshold, step, least))
                    held, at = [], (root, i, j)
                held.append((node, copies, b, np.frombuffer(sig, np.uint32), shingles.of(t)))
        if held:
            yield from emitted(met(held, at, bands, rows, threshold, step, least))

    ready = meetings.repartition(2 * parts_for(members), "root", "_i", "_j").sortWithinPartitions("root", "_i", "_j", "node")
    return ready.mapInArrow(meet, "node bigint, links bigint, root bigint")


def emitted(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(found[0]):
        yield pa.record_batch([pa.array(x) for x in found], ["node", "links", "root"])


def met(held: list, at: tuple, bands: int, rows: int, threshold: tuple[int, int], step: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among the nodes of one block (i = j), or between those of two."""
    _, i, j = at
    nodes = np.array([h[0] for h in held], np.int64)
    copies = np.array([h[1] for h in held], np.int64)
    side = np.array([h[2] for h in held])
    sigs = np.stack([h[3] for h in held])
    sets = [h[4] for h in held]
    left = np.flatnonzero(side == i)
    right = np.flatnonzero(side == j)
    cut = sigs.reshape(len(held), bands, rows)
    agree = np.zeros((len(left), len(right)), bool)
    for b in range(bands):
        _, number = np.unique(cut[:, b], axis=0, return_inverse=True)
        number = number.ravel()
        agree |= number[left][:, None] == number[right][None, :]
    if i == j:
        agree &= left[:, None] < right[None, :]
    a, b = np.nonzero(agree)
    a, b = left[a], right[b]
    matches = np.zeros(len(a), np.int64)
    for low in range(0, bands * rows, step):
        matches += (sigs[a, low : low + step] == sigs[b, low : low + step]).sum(axis=1)
        keep = matches >= least[low + step]
        a, b, matches = a[keep], b[keep], matches[keep]
    shared = overlaps(sets, a, b)
    sizes = np.array([len(s) for s in sets], np.int64)
    upper, lower = threshold
    is_link = (lower + upper) * shared >= upper * (sizes[a] + sizes[b])
    a, b = a[is_link], b[is_link]
    links = np.bincount(a, copies[b], len(held)).astype(np.int64) + np.bincount(b, copies[a], len(held)).astype(np.int64)
    root = np.arange(len(held))
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(held), np.int64)
    rank[order] = np.arange(len(held))
    root = rank.copy()
    while len(a):  # the least rank spreads along links until nothing moves
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = np.minimum(root, root[order[root]])
        if np.array_equal(before, root):
            break
    some = np.flatnonzero(links)
    return nodes[some], links[some], nodes[order[root[some]]]


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    found, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = counts[number] > 1
    column = np.cumsum(counts > 1) - 1
    owner, number = owner[keep], column[number[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        s, e = np.searchsorted(number, [low, low + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[s:e], number[s:e] - low] = 1
        out += held @ held.T
    return out[a, b].astype(np.int64)


def jaccard_join(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    step: int = STEP, tolerance: float = TOLERANCE, block: int = BLOCK,
) -> DataFrame:
    """key, class_id, n_links, n_copies for each row: the least key of all that links
    connect it to, how many other rows it is linked to, and how many have its set."""
    every = sketches(df, key, text, words, bands, rows)
    nodes = every.groupBy("node").agg(F.min("_k").alias("_k"), F.min(F.struct("_k", "_h")).alias("_rep"), F.count(F.lit(1)).alias("copies"))
    # one row of those that have the set, by its key and its text
    named = nodes.select(F.col("node").alias("_node"), "copies", F.col("_rep._k").alias("_rk"), F.col("_rep._h").alias("_rh"))
    repeats = _repeats(every)
    kept = every.join(named, F.expr("node = _node AND _k <=> _rk AND _h = _rh")).select("node", "_rk", "_rh", "copies", "sig", "bands")
    kept = kept.dropDuplicates(["node"]) if repeats else kept
    banded = kept.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    candidates = components(banded.join(buckets, "band").select(F.col("node").alias("u"), "v"))
    members = kept.join(candidates, "node").select("node", "root", "copies", "sig", "_rk", "_rh")
    whole = _texts(df, key, text).join(members, F.expr("_k <=> _rk AND _h = _rh")).select("node", "root", "copies", "sig", "_t")
    whole = whole.dropDuplicates(["node"]) if repeats else whole
    links = settled(linked_in_blocks(whole, words, bands, rows, threshold, step, tolerance, block))
    groups = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links")).join(groups, "node", "left")
    seen = nodes.join(sums, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = seen.groupBy("root").agg(F.min("_k").alias("class_id"))
    result = seen.join(classes, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return every.select("_k", "node").join(result, "node").select(F.col("_k").alias(key), "class_id", "n_links", "n_copies")


def _repeats(every: DataFrame) -> bool:
    """Whether a key and a text stand in more than one row, so that they name more than one."""
    return bool(every.groupBy("_k", "_h").count().where("count > 1").limit(1).count())
