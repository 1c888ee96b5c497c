"""Signals as rows of (keys, block, x): `size` samples of a file in each block
but its last, which may be shorter.

A block is a row, so a sample is never one: what a block can tell by itself is
told where it is read, and only what lies within reach of a block's edges is
shuffled. Blocks of a file are dense from 0; a block of 2^16 samples is 256 KB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from voxloom.functions.arrays import part
from voxloom.operators.intervals import whole
from voxloom.operators.scan import FANOUT, running

KINDS = {
    "bigint": (LongType(), pa.int64()),
    "array<double>": (ArrayType(DoubleType()), pa.list_(pa.float64())),
    "array<bigint>": (ArrayType(LongType()), pa.list_(pa.int64())),
}


def reblocked(chunks: DataFrame, keys: Sequence[str], size: int, order: str = "ord") -> DataFrame:
    """chunks(keys, order, x), of any length and in the order of integers unique
    in a file, to (keys, block, x). A null or empty chunk adds nothing; a file
    of no samples has no block. A chunk is cut where it meets a block's edge, and
    the pieces, never the samples, are put together by (file, block)."""
    held = chunks.where(F.size("x") > 0).select(*keys, order, "x")
    placed = running(
        held, keys, [order], F.floor(F.col(order) / FANOUT), before={"_from": ("sum", F.size("x").cast("long"))}
    )
    first, last = F.col("_from"), F.col("_from") + F.size("x")
    cut = placed.withColumn("block", F.explode(F.sequence(whole(first, F.lit(size)), whole(last - 1, F.lit(size)))))
    low = F.greatest(F.col("block") * size, first)
    high = F.least((F.col("block") + 1) * size, last)
    pieces = cut.select(*keys, "block", low.alias("_at"), part(F.col("x"), low - first, high - first).alias("x"))
    return pieces.groupBy(*keys, "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "x"))), lambda p: p["x"])).alias("x")
    )


def sizes_of(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_samples) of each file."""
    return blocks.groupBy(*keys).agg(F.sum(F.size("x")).cast("long").alias("n_samples"))


def with_neighbours(blocks: DataFrame, keys: Sequence[str], reach: int, names: Sequence[str]) -> DataFrame:
    """`blocks` with the last `reach` elements of the block before, as
    `_before_<name>`, and the first of the one after, as `_after_<name>`, for each
    array column named; null at a file's ends."""
    keys = list(keys)

    def edge(side: str, step: int) -> DataFrame:
        ends = {name: F.slice(name, 1, reach) if step < 0 else _last(F.col(name), reach) for name in names}
        return blocks.select(*keys, (F.col("block") + step).alias("block"), *[v.alias(f"_{side}_{n}") for n, v in ends.items()])

    return blocks.join(edge("before", 1), [*keys, "block"], "left").join(edge("after", -1), [*keys, "block"], "left")


def seams(blocks: DataFrame, keys: Sequence[str], reach: int, size: int) -> DataFrame:
    """(keys, edge, tail, head): the last `reach` samples before each block's edge
    and the first after it. `tail` is null at a file's start and `head` at its
    end; a last block shorter than `reach` is all in `head` and has no seam after it."""
    none = F.lit(None).cast(blocks.schema["x"].dataType)
    first = F.col("block") * size
    heads = blocks.select(*keys, first.alias("edge"), none.alias("tail"), F.slice("x", 1, reach).alias("head"))
    tails = blocks.where(F.size("x") >= reach).select(
        *keys, (first + F.size("x")).alias("edge"), _last(F.col("x"), reach).alias("tail"), none.alias("head")
    )
    return heads.unionByName(tails).groupBy(*keys, "edge").agg(
        F.any_value("tail", True).alias("tail"), F.any_value("head", True).alias("head")
    )


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def map_arrays(
    df: DataFrame, keep: Sequence[str], arrays: Sequence[str], numbers: Sequence[str], out: Mapping[str, str],
    kernel: Callable[..., tuple],
) -> DataFrame:
    """`keep` and the columns `out` (name to type) that `kernel` gives from a row's
    `arrays`, as float64 arrays (None for null), and `numbers`. Arrow hands over a
    bounded count of bytes at a time, and the arrays of a batch are views of it."""
    inputs = [*arrays, *numbers]
    kept = [f.name for f in df.schema.fields if f.name in keep]
    shape = StructType(df.select(*kept).schema.fields.copy())
    for name, kind in out.items():
        shape = shape.add(name, KINDS[kind][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_views(batch.column(name)) for name in arrays] + [batch.column(name).to_pylist() for name in numbers]
            made = [kernel(*row) for row in zip(*columns)]
            values = [pa.array([row[i] for row in made], KINDS[kind][1]) for i, kind in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in kept], *values], [*kept, *out])

    return df.select(*kept, *[c for c in inputs if c not in kept]).mapInArrow(run, shape)


def _views(column: pa.Array) -> list[np.ndarray | None]:
    values = column.values.to_numpy(zero_copy_only=False)
    edges = column.offsets.to_numpy()
    return [
        values[a:b].astype(np.float64, copy=False) if known else None
        for a, b, known in zip(edges, edges[1:], column.is_valid().to_numpy(zero_copy_only=False))
    ]
