"""Work packed into padded batches for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.scan import ordinal

# Default caps.
MAX_ROWS = 4
MAX_PADDED = 300 * 16_000
SLICE_ROWS = 1024  # arrivals packed in one row; not one of the fixed values


def pack_batches(
    pieces: DataFrame, *, max_rows: int = MAX_ROWS, max_padded: int = MAX_PADDED, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """pieces(model, shard, ord, n) to the same with `batch`: consecutive rows of
    one model, at most `max_rows`, rows x longest at most `max_padded`, the
    first row always admitted; a null length is 0.

    A shard's arrivals are cut by their ordinals into slices of `slice_rows`, each
    packed by itself in one row, so a model with most of the work is packed by many
    tasks; a slice may leave its last batch short. Batches are numbered within a
    shard, a slice's from its first ordinal on."""
    state = F.struct(
        F.lit(-1).cast("long").alias("batch"), F.lit(0).alias("rows"), F.lit(0).cast("long").alias("longest"),
        F.array().cast("array<struct<ord:bigint,n:bigint,batch:bigint>>").alias("out"),
    )

    def admit(acc, row):
        n = F.coalesce(row["n"], F.lit(0))
        longest = F.greatest(acc["longest"], n)
        full = (acc["rows"] == 0) | (acc["rows"] >= max_rows) | ((acc["rows"] + 1) * longest > max_padded)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            batch.alias("batch"),
            F.when(full, F.lit(1)).otherwise(acc["rows"] + 1).alias("rows"),
            F.when(full, n).otherwise(longest).alias("longest"),
            F.array_append(acc["out"], F.struct(row["ord"].alias("ord"), row["n"].alias("n"), batch.alias("batch"))).alias("out"),
        )

    # The key is one struct, since fields of it may be null where a join's key may not.
    narrow = pieces.select(F.struct("model", "shard").alias("_k"), F.col("ord").cast("long").alias("ord"), F.col("n").cast("long").alias("n"))
    block = F.coalesce(F.floor(F.col("ord") / slice_rows), F.lit(-(1 << 62)))
    ranked = ordinal(narrow, ["_k"], ["ord", "n"], block, "_at").withColumn("_slice", F.floor(F.col("_at") / slice_rows))
    rows = F.array_sort(F.collect_list(F.struct("ord", "n")))
    packed = ranked.groupBy("_k", "_slice").agg(rows.alias("rows"))
    folded = packed.select("_k", (F.col("_slice") * slice_rows).alias("_first"), F.explode(F.aggregate("rows", state, admit)["out"]).alias("o"))
    return folded.select("_k.*", "o.ord", "o.n", (F.col("_first") + F.col("o.batch")).alias("batch"))


def padding_report(packed: DataFrame) -> DataFrame:
    """Per model: batches, rows, and the share of padded audio that is padding."""
    batches = packed.groupBy("model", "shard", "batch").agg(
        F.count("*").alias("rows"), F.max("n").alias("longest"), F.sum("n").alias("audio")
    )
    return batches.groupBy("model").agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"),
        (1 - F.sum("audio") / F.sum(F.col("rows") * F.col("longest"))).alias("waste"),
    )


def score_with_model(
    pieces: DataFrame, load: Callable[[], Callable[[list], list]], *, payload: str, schema: str, keys: str, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Each piece through a user's model: `load` runs once per task and gives a
    function from a list of payloads to as many result dicts. A batch that
    fails, or gives another count, marks its own rows in `error` and no others.

    `keys` and `schema` are DDL for the columns kept and the result's fields."""
    names, fields = _names(keys), _names(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            payloads = list(frame[payload])
            calls = [(payloads[first : first + max_rows], model) for first in range(0, len(frame), max_rows)]
            yield from _scored(frame[names], calls, fields)

    return pieces.select(*names, payload).mapInPandas(run, f"{keys}, {schema}, error string")


def score_batches(
    packed: DataFrame, load: Callable[[object], Callable[[list], list]], *, payload: str, schema: str, keys: str
) -> DataFrame:
    """packed(model, shard, ord, batch, payload) scored one packed batch a call, in
    the order of `ord`: `load` is asked for a model by its name, once per task for
    each that the task meets. A batch is never split, wherever a frame of rows
    ends, nor joined to another; one that fails, also because its model cannot be
    loaded, marks its own rows in `error`. Null names and shards are groups like any."""
    names, fields = _names(keys), _names(schema)
    by = ["model", "shard", "batch"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict = {}

        def called(name: object) -> Callable[[list], list]:
            def model(payloads: list) -> list:
                if name not in models:
                    models[name] = load(name)
                return models[name](payloads)

            return model

        held, of = [], None  # the frames of a batch that may go on in the next frame
        for frame in frames:
            marks = list(zip(*[[None if missing else v for v, missing in zip(frame[column], frame[column].isna())] for column in by]))
            starts = [i for i, mark in enumerate(marks) if mark != (marks[i - 1] if i else of)]
            if marks:
                before, of = of, marks[-1]
            if not starts:
                held.append(frame)
                continue
            whole = pd.concat([*held, frame.iloc[: starts[-1]]])
            ends = [len(whole) - starts[-1] + i for i in starts]
            payloads, calls, first = list(whole[payload]), [], 0
            for end, name in zip(ends, [before and before[0], *[marks[i][0] for i in starts[:-1]]]):
                if end > first:
                    calls.append((payloads[first:end], called(name)))
                first = end
            yield from _scored(whole[names], calls, fields)
            held = [frame.iloc[starts[-1] :]]
        if held and of is not None:
            whole = pd.concat(held)
            yield from _scored(whole[names], [(list(whole[payload]), called(of[0]))], fields)

    asked = packed.select(*dict.fromkeys([*names, *by, payload]), F.col("ord").alias("_order"))
    dealt = asked.repartition(*by).sortWithinPartitions(*by, "_order")
    return dealt.mapInPandas(run, f"{keys}, {schema}, error string")


def _names(ddl: str) -> list[str]:
    return [field.strip().split()[0] for field in ddl.split(",")]


def _scored(
    keys: pd.DataFrame, calls: list[tuple[list, Callable[[list], list]]], fields: list[str]
) -> Iterator[pd.DataFrame]:
    """Rows through models, a call for each run of payloads, which follow each other
    as the rows of `keys` do. The rows of all calls that succeed come as one frame
    and those of the others as one, since a frame costs far more than a call."""
    good, bad, told, errors, at_ = [], [], {field: [] for field in fields}, [], 0
    for payloads, model in calls:
        rows = range(at_, at_ + len(payloads))
        at_ += len(payloads)
        try:
            results = model(payloads)
            if len(results) != len(payloads):
                raise ValueError(f"{len(results)} results for {len(payloads)} pieces")
            values = [[result[field] for result in results] for field in fields]
        except Exception as exc:  # the batch's rows fail, not the job
            bad.extend(rows)
            errors.extend([f"{type(exc).__name__}: {exc}"] * len(payloads))
        else:
            good.extend(rows)
            for field, own in zip(fields, values):
                told[field].extend(own)
    if good:
        out = keys.iloc[good].reset_index(drop=True)
        for field, own in told.items():  # a null among whole numbers would make them floats
            out[field] = pd.Series(own, dtype=object if any(v is None for v in own) else None)
        yield out.assign(error=None)
    if bad:
        yield keys.iloc[bad].reset_index(drop=True).assign(**dict.fromkeys(fields), error=errors)


def keep_first_on_failure(first: DataFrame, redo: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """First-pass results replaced by a second pass only where that succeeded."""
    good = redo.where(F.col("error").isNull()).select(*keys, F.lit(True).alias("_again"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = first.join(good, keys, "left")
    return joined.select(
        *[c for c in first.columns if c not in fields],
        *[F.when(F.col("_again"), F.col(f"_r_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
    )
