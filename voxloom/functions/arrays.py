"""Small helpers for expressions over arrays held in one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once. The optimizer may copy a
    projected expression into a lambda, where it would run once per element;
    a lambda variable is bound to its value and cannot be copied."""
    return F.transform(F.array(value), body)[0]


def indices(length: Column) -> Column:
    """0 .. length-1, empty when length is 0."""
    return F.when(length > 0, F.sequence(F.lit(0).cast("int"), (length - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def at(values: Column, index: Column) -> Column:
    """The element at a 0-based index, null past either end."""
    return F.when((index >= 0) & (index < F.size(values)), F.get(values, index.cast("int")))


def part(values: Column, start: Column, stop: Column) -> Column:
    """Elements start (0-based) up to but not including stop."""
    return F.slice(values, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def unroll(df: DataFrame, keep: Sequence[str], values: Column, index: str = "i", item: str = "item") -> DataFrame:
    """One row per array element with its 0-based index. The outer form is used
    because the plain one makes the optimizer add a filter on the array's size,
    which computes the whole array expression a second time."""
    return df.select(*keep, F.posexplode_outer(values).alias(index, item)).where(F.col(index).isNotNull())


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with computed columns that stay computed. Projected expressions are
    copied into every filter and field access above them, so one read four
    times runs four times; what a generator gives is not copied."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, F.explode_outer(F.array(row)).alias("_pin")).select(*kept, *[F.col(f"_pin.{n}").alias(n) for n in columns])
