"""Quiet stretches of a file listened to again at their own level.

A file's average level hides a speaker much quieter than the rest. Each long
quiet run is gated anew by its own average and its own quietest tenth, and what
is still quiet within it again, until nothing changes. Runs are the work list;
only runs in which something was heard come back. Everything is keyed by (file,
run) and a block of the line, so neither a long file nor a long run is one task:
the quietest tenth comes from ranks within blocks of level, the median from
blocks with a halo, and what is heard is intervals from there on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.intervals import join_dips, normalise_intervals, runs
from voxloom.operators.scan import BLOCK, ordinal, running, with_halo
from voxloom.operators.signal import QUIETEST, above_gate
from voxloom.session import cut_lineage

# Fixed values, in frames of 20 ms: a sound counts from half a second, and goes on across dips under 400 ms.
HEARD_ENOUGH = 25
SOUND_DIP = 20
TENTH = 0.1
OVER_FLOOR_DB = 10.0
ROUNDS = 100


def _line(column: str, block: int) -> Column:
    return F.floor(F.col(column) / block)


def _in_runs(frames: DataFrame, todo: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Frames (keys, f, rms) that lie in one of the disjoint runs (keys, s, e), with the run as rs, re."""
    marks = todo.select(*keys, F.col("s").alias("f"), F.lit(None).cast("double").alias("rms"), F.struct("s", "e").alias("_m"), F.lit(0).alias("_k"))
    line = frames.select(*keys, "f", "rms", F.lit(None).cast(marks.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_k")).unionByName(marks)
    seen = running(line, keys, ["f", "_k"], _line("f", block), before={"_run": ("last", F.col("_m"))})
    return seen.where((F.col("_k") == 1) & (F.col("_run.e") > F.col("f"))).select(*keys, "f", "rms", F.col("_run.s").alias("rs"), F.col("_run.e").alias("re"))


def _own_gates(parts: DataFrame, by: Sequence[str], ratio: float) -> DataFrame:
    """(by, gate) of each run. The tenth is taken between two ranks; a run's
    values are ranked in blocks of one decibel."""
    sizes = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("rms").alias("_mean"))
    ranked = ordinal(parts.select(*by, "f", "rms"), by, ["rms", "f"], F.floor(20 * F.log10("rms")), "_rank")
    place = (F.col("_n") - 1) * TENTH
    near = ranked.join(sizes, list(by)).where((F.col("_rank") == F.floor(place)) | (F.col("_rank") == F.floor(place) + 1))
    low, high = F.min("rms"), F.max("rms")
    tenth = low + (high - low) * (F.max(place) - F.floor(F.max(place)))
    return near.groupBy(*by).agg(F.greatest(F.lit(QUIETEST), F.max("_mean") * ratio, tenth * 10.0 ** (OVER_FLOOR_DB / 20)).alias("gate"))


def _heard(parts: DataFrame, by: Sequence[str], ratio: float, block: int) -> DataFrame:
    """(by, re, s, e): runs of frames whose median of five is over their run's own gate."""
    gated = parts.join(_own_gates(parts, by, ratio), list(by))
    spread, own = with_halo(gated, by, "f", 2, block)
    place = Window.partitionBy(*by, BLOCK).orderBy("f")
    x = F.col("rms")
    a1, b1 = F.coalesce(F.lag(x, 1).over(place), x), F.coalesce(F.lead(x, 1).over(place), x)
    five = F.array_sort(F.array(F.coalesce(F.lag(x, 2).over(place), a1), a1, x, b1, F.coalesce(F.lead(x, 2).over(place), b1)))
    flagged = spread.withColumn("flag", F.get(five, F.lit(2)) > F.col("gate")).where(own)
    return runs(flagged.select(*by, "re", "f", "flag"), [*by, "re"], pos="f", flag="flag", block=block)


def _near_sounds(heard: DataFrame, by: Sequence[str], relisten: int, dip: int, enough: int, block: int) -> DataFrame:
    """Heard runs with `_long`, whether their sound counts by itself, `_near`,
    whether it comes within reach of one that does, and the ends of the sounds
    that count before and after it."""
    ordered = [*by, "re"]
    seen = running(heard, ordered, ["s"], _line("s", block), before={"_end": ("last", F.col("e"))})
    opened = seen.withColumn("_opens", F.col("_end").isNull() | (F.col("s") - F.col("_end") >= dip)).drop("_end")
    placed = running(opened, ordered, ["s"], _line("s", block), before={"_last": ("last", F.when(F.col("_opens"), F.col("s")))})
    one = cut_lineage(placed.select(*ordered, "s", "e", F.when(F.col("_opens"), F.col("s")).otherwise(F.col("_last")).alias("_a")))
    sounds = one.groupBy(*ordered, "_a").agg(F.max("e").alias("_b"), (F.sum(F.col("e") - F.col("s")) >= enough).alias("_long"))
    long = lambda c: F.when(F.col("_long"), F.col(c))
    beside = running(sounds, ordered, ["_a"], _line("_a", block), before={"_prior": ("last", long("_b"))}, after={"_next": ("first", long("_a"))})
    near = F.col("_long") | F.coalesce(F.col("_a") < F.col("_prior") + relisten, F.lit(False)) | F.coalesce(F.col("_b") > F.col("_next") - relisten, F.lit(False))
    return one.join(beside.withColumn("_near", near), [*ordered, "_a"])


def _within(told: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """(by, re, s, e): the parts of heard runs within `reach` of a sound that counts."""
    whole = F.array(F.struct(F.col("s"), F.col("e")))
    sides = F.array(
        F.struct(F.col("s"), F.least("e", F.col("_prior") + reach).alias("e")), F.struct(F.greatest("s", F.col("_next") - reach).alias("s"), F.col("e"))
    )
    present = F.array(F.col("_prior").isNotNull(), F.col("_next").isNotNull())
    parts = F.when(F.col("_long"), whole).otherwise(F.filter(sides, lambda p, i: F.get(present, i) & (p["s"] < p["e"])))
    return told.select(*by, "re", F.explode(parts).alias("_p")).select(*by, "re", "_p.s", "_p.e")


def loud_runs(
    levels: DataFrame, keys: Sequence[str], *, ratio: float, relisten: int, dip: int = SOUND_DIP, enough: int = HEARD_ENOUGH, block: int = 65536,
) -> DataFrame:
    """(keys, s, e): runs of frames of levels(keys, f, rms) that are loud for the
    file, or in a quiet run of `relisten` frames or more for that run.

    In a quiet run a frame is heard if the median of five frames passes the
    greater of `ratio` times the run's average and 10 dB over its quietest
    tenth. Heard frames join to sounds across dips under `dip`. A sound counts
    if it has `enough` heard frames; a shorter one is loud if it comes within
    `relisten` of one that counts, up to `enough` frames past that. What is
    neither heard nor near in such a run is listened to again. Frames are dense
    from 0 for each key; a frame's level is over 0."""
    keys = list(keys)
    by = [*keys, "rs"]
    flagged = cut_lineage(above_gate(levels.select(*keys, "f", "rms"), keys, ratio=ratio))
    loud = [runs(flagged, keys, pos="f", flag="flag", block=block)]
    todo = cut_lineage(runs(flagged.withColumn("flag", ~F.col("flag")), keys, pos="f", flag="flag", shortest=relisten, block=block))
    frames = flagged.select(*keys, "f", "rms")
    for _ in range(ROUNDS):
        if todo.isEmpty():
            return normalise_intervals(_all(loud), keys, block=block)
        parts = cut_lineage(_in_runs(frames, todo, keys, block))
        told = cut_lineage(_near_sounds(_heard(parts, by, ratio, block), by, relisten, dip, enough, block))
        kept = normalise_intervals(_within(told, by, relisten), [*by, "re"], block=block)
        loud.append(cut_lineage(_within(told.where("_near"), by, relisten + enough).select(*keys, "s", "e")))
        between = running(kept, [*by, "re"], ["s"], _line("s", block), before={"_end": ("last", F.col("e"))}, after={"_start": ("first", F.col("s"))})
        gaps = F.array(
            F.struct(F.coalesce("_end", "rs").alias("s"), F.col("s").alias("e")), F.when(F.col("_start").isNull(), F.struct(F.col("e").alias("s"), F.col("re").alias("e")))
        )
        todo = cut_lineage(between.select(*keys, F.explode(gaps).alias("g")).where(F.col("g.e") - F.col("g.s") >= relisten).select(*keys, "g.s", "g.e"))
        frames = parts.select(*keys, "f", "rms")
    raise RuntimeError(f"quiet runs still change after {ROUNDS} rounds")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def quiet_runs(loud: DataFrame, levels: DataFrame, keys: Sequence[str], *, shortest: int, block: int = 65536) -> DataFrame:
    """(keys, s, e): what lies between loud runs, from the first frame to the last, if `shortest` frames or more."""
    sizes = levels.groupBy(*keys).agg((F.max("f") + 1).alias("_n"))
    edges = loud.select(*keys, "s", "e").unionByName(sizes.select(*keys, F.lit(-1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e")))
    after = running(edges, keys, ["s"], F.floor(F.col("s") / block), after={"_s": ("first", F.col("s"))}).join(sizes, list(keys))
    return after.select(*keys, F.col("e").alias("s"), F.coalesce("_s", "_n").alias("e")).where(F.col("e") - F.col("s") >= shortest)


def speech_spans_volume(
    levels: DataFrame, sizes: DataFrame, keys: Sequence[str], *, relisten: int, ratio: float = 0.4, dip: int = SOUND_DIP, pad: int = 1920, frame: int = 320,
    enough: int = HEARD_ENOUGH, short: DataFrame | None = None, block: int = 65536,
) -> DataFrame:
    """(keys, s, e) in samples: loud runs joined across dips, padded, clipped to
    the file's `n_samples`. Files of `short`(keys, peak), under one frame, are
    speech as a whole if their peak is over 1e-4."""
    loud = loud_runs(levels, keys, ratio=ratio, relisten=relisten, dip=dip, enough=enough, block=block)
    spans = join_dips(loud, list(keys), dip, block=block).join(sizes, list(keys)).select(
        *keys, F.greatest(F.col("s") * frame - pad, F.lit(0)).alias("s"), F.least(F.col("e") * frame + pad, F.col("n_samples")).alias("e")
    )
    if short is None:
        return spans
    own = short.join(sizes, list(keys)).where((F.col("peak") > 1e-4) & (F.col("n_samples") < frame))
    return spans.unionByName(own.select(*keys, F.lit(0).cast("bigint").alias("s"), F.col("n_samples").cast("bigint").alias("e")))
