"""Packing documents into sequences by minimum bin slack.

A document longer than a sequence is cut into full sequences and a rest. What is
packed is the histogram of rest lengths, at most `capacity` - 1 numbers whatever
the corpus. For each window the longest rest left is taken, and a subset-sum
over bits finds the multiset of other rests that comes closest to the room left;
the bits are walked back to counts, and the window is repeated as often as the
counts allow, so the number of different windows is bounded by the number of
lengths and not by the rows. Once no multiset fills a sequence, the rests left
are set into sequences of a power of two where one can be filled exactly, which
need no padding either, and otherwise as close to the capacity as they come.

Within a length, pieces are ranked by salted buckets, so a length that a third
of all pieces have is ranked by many tasks. A null text is an empty one, whose
only id is the end; repeated rows are packed each; an empty table gives no
pieces. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import batches_of, settled, texts_of
from voxloom.llm.encoders import encoder

CAPACITY = 4096
END = 2
SALTS = 64


def best_multiset(counts: dict[int, int], room: int, lengths: list[int]) -> dict[int, int]:
    """Counts of lengths whose sum is the largest possible up to `room`.
    `lengths` is descending. The search ends at the first exact sum."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(counts[length], room // length)
        before, left, size = reach, most, 1
        while left:
            take = min(size, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach != before:
            steps.append((length, before, most))
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before, most in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            taken[length] = n
    return taken


def windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(multiset, times) of windows that use up the histogram of lengths below the capacity."""
    counts = {k: v for k, v in histogram.items() if v}
    out: list[tuple[dict[int, int], int]] = []

    def take(chosen: dict[int, int]) -> None:
        times = min(counts[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]

    late: list[int] = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        chosen = best_multiset(counts, capacity - longest, [x for x in lengths if counts[x]])
        counts[longest] += 1
        chosen = dict(chosen)
        chosen[longest] = chosen.get(longest, 0) + 1
        filled = sum(k * n for k, n in chosen.items())
        if filled < capacity and not late:
            # nothing fills a whole sequence around this rest: try the powers of two below
            late = [1 << b for b in range(capacity.bit_length() - 2, -1, -1)]
        if filled < capacity:
            for goal in (g for g in late if g >= longest):
                counts[longest] -= 1
                smaller = dict(best_multiset(counts, goal - longest, [x for x in lengths if counts[x]]))
                counts[longest] += 1
                smaller[longest] = smaller.get(longest, 0) + 1
                if sum(k * n for k, n in smaller.items()) == goal:
                    chosen = smaller
                    break
        take(chosen)
    return out


def pieces_of(df: DataFrame, key: str, text: str, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """_k, start, length, ids_crc32, doc_tokens, _row of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail = encoder(tokenizer), np.array([end], np.uint32)
        for batch in batches_of(batches, "_t", 2 << 20):
            out = {"_k": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for k, t in zip(batch.column("_k").to_pylist(), texts_of(batch.column("_t")), strict=True):
                ids = np.concatenate([own.ids(t), tail]).astype("<u4", copy=False)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    for name, value in zip(out, (k, start, len(part), zlib.crc32(part), len(ids)), strict=True):
                        out[name].append(value)
            yield pa.record_batch([pa.array(out["_k"], batch.schema.field("_k").type), *[pa.array(out[x], pa.int64()) for x in list(out)[1:]]], list(out))

    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(cut, f"_k {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


class Plan:
    """Where the rank of a rest among those of its length puts it: sorted arrays, searched by task."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for chosen, times in windows(histogram, capacity):
            offset = 0
            for length in sorted(chosen, reverse=True):
                n = chosen[length]
                rows.append((length, used.get(length, 0), n, sequence, offset))
                used[length] = used.get(length, 0) + n * times
                offset += n * length
            sequence += times
        table = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], np.int64)
        self.table, self.sequences = table, sequence
        self.place = table[:, 0] << 44 | table[:, 1]

    def put(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.place, length << 44 | rank, side="right") - 1]
        since = rank - row[:, 1]
        return row[:, 3] + since // row[:, 2], row[:, 4] + since % row[:, 2] * length


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END, salts: int = SALTS
) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = df.sparkSession
    pieces = settled(
        pieces_of(df, key, text, tokenizer, capacity, end).withColumn("_salt", F.pmod(F.xxhash64("_k", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    )
    rests = pieces.where(F.col("length") < capacity)
    sizes = rests.groupBy("length", "_salt").count()
    # at most capacity x salts rows, which is all that reaches the driver
    held = sizes.collect()
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in sorted(held, key=lambda r: (r["length"], r["_salt"])):
        base[r["length"], r["_salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]
    plan = Plan(histogram, capacity)
    bases = np.zeros((capacity, salts), np.int64)
    for (length, salt), n in base.items():
        bases[length, salt] = n
    sent = spark.sparkContext.broadcast((plan, bases))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, firsts = sent.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = own.put(length, batch.column("_rank").to_numpy() + firsts[length, batch.column("_salt").to_numpy()])
            names = ["_k", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.record_batch([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"_k {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_k", "start", "ids_crc32")) - 1
    packed = rests.withColumn("_rank", rank.cast("bigint")).mapInArrow(put, schema)
    # full pieces are numbered after the others: rank within a salt, from the count of the salts before
    full = pieces.where(F.col("length") == capacity)
    before, total = {}, plan.sequences
    for r in sorted(full.groupBy("_salt").count().collect(), key=lambda r: r["_salt"]):
        before[r["_salt"]], total = total, total + r["count"]
    first = F.element_at(F.array(*[F.lit(before.get(s, 0)).cast("bigint") for s in range(salts)]), F.col("_salt") + 1)
    number = F.row_number().over(Window.partitionBy("_salt").orderBy("_k", "start", "ids_crc32")) - 1
    whole = full.withColumn("sequence_id", first + number).select("_k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(whole).withColumnRenamed("_k", key)
