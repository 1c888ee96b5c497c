"""Running values over long ordered series without putting a key in one task.

A window partitioned by file alone sends the whole file to one task, so one
file holding a third of the corpus would hold up the job. Here a series is cut
into blocks of its own order column. Rows are windowed within (key, block); one
summary row per block carries what came before it. The series is shuffled
once, on (key, block), and both the windows and the summaries read that one
shuffle; the summaries are smaller than the series by the block's size. `levels` repeats
the same idea over the summaries where even those are too many for one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
FANOUT = 4096


def _summary(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    ordered = F.struct(*[F.col(name) for name in order], value.alias("_v"))
    if kind == "last":
        return F.max(F.when(value.isNotNull(), ordered))["_v"]
    if kind == "first":
        return F.min(F.when(value.isNotNull(), ordered))["_v"]
    raise ValueError(f"unknown running value {kind!r}")


def _windowed(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind in ("max", "min"):
        return getattr(F, kind)(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def _combined(kind: str, inside: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if kind == "max":
        return F.greatest(inside, carried)
    if kind == "min":
        return F.least(inside, carried)
    return F.coalesce(inside, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    before: Mapping[str, tuple[str, Column]] | None = None,
    after: Mapping[str, tuple[str, Column]] | None = None,
    levels: int = 1,
) -> DataFrame:
    """`df` with one column per name: a value over the rows of the same key
    strictly before (`before`: sum, max, last non-null) or strictly after
    (`after`: min, first non-null) in `order`.

    `order` must be a total order within a key and `block` must not decrease
    along it. Sums are 0 where there is no row, everything else null.
    """
    before, after = dict(before or {}), dict(after or {})
    keys, order = list(keys), list(order)
    # Both branches below read one shuffle of the data. The exchange is reused
    # only if they need the same columns of it, so the summary touches them all
    # through a hash; otherwise whatever made `df` would run twice, and a chain
    # of these would run it 2^n times.
    data = df.withColumn(BLOCK, block.cast("long")).repartition(*keys, BLOCK)
    forward = (
        Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # The mirror of a following frame: a frame that ends at the last row is
    # recomputed for every row, one that starts at the first is not.
    backward = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*[F.col(name).desc() for name in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = data.select(
        "*",
        *[_windowed(kind, value, forward).alias(f"_in_{name}") for name, (kind, value) in before.items()],
        *[_windowed(kind, value, backward).alias(f"_in_{name}") for name, (kind, value) in after.items()],
    )
    blocks = data.groupBy(*keys, BLOCK).agg(
        *[_summary(kind, value, order).alias(f"_of_{name}") for name, (kind, value) in {**before, **after}.items()],
        F.max(F.xxhash64(*df.columns)).alias("_touched"),
    )
    carry = _carry(blocks.where(F.col("_touched").isNotNull()), keys, before, after, levels)
    joined = inside.join(carry, [*keys, BLOCK])
    return joined.select(
        *[F.col(name) for name in df.columns],
        *[
            _combined(kind, F.col(f"_in_{name}"), F.col(f"_by_{name}")).alias(name)
            for name, (kind, _value) in {**before, **after}.items()
        ],
    )


def _carry(blocks: DataFrame, keys: Sequence[str], before: Mapping, after: Mapping, levels: int) -> DataFrame:
    """Per (key, block), the same values over the key's earlier or later blocks."""
    if levels > 1:
        fine = blocks.withColumnRenamed(BLOCK, "_fine")
        carried = running(
            fine,
            keys,
            ["_fine"],
            F.floor(F.col("_fine") / FANOUT),
            before={f"_by_{n}": (kind, F.col(f"_of_{n}")) for n, (kind, _v) in before.items()},
            after={f"_by_{n}": (kind, F.col(f"_of_{n}")) for n, (kind, _v) in after.items()},
            levels=levels - 1,
        ).withColumnRenamed("_fine", BLOCK)
    else:
        forward = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        backward = (
            Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = blocks.select(
            "*",
            *[_windowed(kind, F.col(f"_of_{n}"), forward).alias(f"_by_{n}") for n, (kind, _v) in before.items()],
            *[_windowed(kind, F.col(f"_of_{n}"), backward).alias(f"_by_{n}") for n, (kind, _v) in after.items()],
        )
    return carried.select(*keys, BLOCK, *[f"_by_{name}" for name in (*before, *after)])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "pos") -> DataFrame:
    """`df` with its 0-based rank within the key, as row_number() - 1 gives it."""
    return running(df, keys, order, block, before={name: ("sum", F.lit(1).cast("long"))})


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, halo: int, size: int) -> tuple[DataFrame, Column]:
    """Rows of dense integer `pos`, each also copied into a neighbouring block
    it lies within `halo` of, and the predicate that keeps the originals. A
    frame of at most `halo` rows either side is then whole within (key, block)."""
    if halo >= size:
        raise ValueError("a block must be longer than its halo")
    p = F.col(pos)
    homes = F.array_distinct(
        F.array(F.floor((p - halo) / size), F.floor(p / size), F.floor((p + halo) / size))
    )
    copied = df.withColumn(BLOCK, F.explode(homes))
    return copied, F.col(BLOCK) == F.floor(p / size)
