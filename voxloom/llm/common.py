"""What the corpus operators share: tables, a shared work folder, Arrow text columns, deals by key range."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it; one of the
    machine's own only where none is set and the session is a single process."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder by a reliable checkpoint. Used on narrow
    rows only: what is read more than once, or costs Python time to make."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files, which would else stay until the driver's memory is next cleared."""
    was = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if was is None else spark.conf.set(CLEANUP_KEY, was)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back; what was shuffled for it goes."""
    spark = df.sparkSession
    place = work_folder(spark, what)
    with shuffles_dropped(spark):
        df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def apart(df: DataFrame) -> str:
    """Underscores to put before a new column's name so that it is none of df's."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def texts_of(column: pa.Array) -> list[str]:
    """A text column as Python strings, a null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `most_bytes` of `column`, or one row."""
    for batch in batches:
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def lean(task: Callable) -> Callable:
    """A function over batches whose worker gives the memory of a finished task
    back to the system. Workers wait for their next task, of this stage or
    another's, and would hold it meanwhile."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def parts_for(df: DataFrame) -> int:
    """Partitions for an explicit deal, from the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, key: str, parts: int) -> tuple[DataFrame, list[int]]:
    """`df` with `_range`, the number of its key range, and the first key of each
    range. The bounds are quantiles of the key column alone; they are as many as
    the partitions asked for, whatever the data."""
    ends = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] if parts > 1 else [0.5], max(10_000, 10 * parts))).first()[0] or []
    bounds = sorted(set(ends)) if parts > 1 else []
    return df.withColumn("_range", range_of(F.col(key), bounds)), bounds


def long_array(values: list[int]) -> Column:
    """One literal, however long: it is read from text when the plan is folded."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted `bounds` are less than the key, by halving: keys up to bounds[0] are range 0."""
    held = long_array(bounds)
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def halve(at: Column, _step: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        less = F.coalesce(F.get(held, middle) < key, F.lit(False))
        open_ = at["low"] < at["high"]
        return span(F.when(open_ & less, middle + 1).otherwise(at["low"]), F.when(open_ & ~less, middle).otherwise(at["high"]))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, span(F.lit(0), F.lit(len(bounds))), halve)["low"]
