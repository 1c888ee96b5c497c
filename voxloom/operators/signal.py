"""Loudness of a sampled signal and what it says about speech.

Samples are arrays in blocks (`operators/blocks.py`), so one long file is spread
over many tasks; frames are arrays by block until a gate asks for each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.arrays import let, part
from voxloom.operators.blocks import map_arrays, seams, with_neighbours
from voxloom.operators.intervals import join_dips, overlap_sum, runs, whole

# Fixed values, at 16 kHz and 20 ms frames.
RATE = 16_000
FRAME = 320
OFFSET_FRAMES = 51
SMOOTH_FRAMES = 12
QUIETEST = 1e-3
PAUSE_FRAMES, PAUSE_DB = 12, 25.0
SYLLABLE_FRAMES, LOUD_DB = 3, 15.0
DIRECT_SPAN = 16  # samples, not one of the fixed values
WINDOW_SEC, CONTEXT_SEC, TAIL_SEC, LEAST_SAMPLES = 30, 2, 1, 400


def pcm_to_float(samples: Column, width: int) -> Column:
    """Integer samples of `width` bytes to [-1, 1); one byte is unsigned."""
    offset, scale = (128.0, 128.0) if width == 1 else (0.0, float(1 << (8 * width - 1)))
    return F.transform(samples, lambda v: ((v - F.lit(offset)) / F.lit(scale)).cast("float"))


def normalise_samples(interleaved: Column, channels: int, cap: int) -> Column:
    """Channels averaged, an incomplete last frame dropped, non-finite values
    to 0, and at most `cap` samples kept, so audio over a limit still shows it."""
    kept = let(
        interleaved,
        lambda v: F.when(
            F.size(v) >= channels,
            F.transform(
                F.sequence(F.lit(0), F.least(whole(F.size(v), F.lit(channels)), F.lit(cap)).cast("int") - 1),
                lambda i: F.aggregate(
                    part(v, i * channels, i * channels + channels), F.lit(0.0), lambda acc, s: acc + s.cast("double")
                )
                / channels,
            ),
        ).otherwise(F.array().cast("array<double>")),
    )
    finite = lambda s: F.when(F.isnan(s) | (F.abs(s) == F.lit(float("inf"))), F.lit(0.0)).otherwise(s)
    return F.transform(kept, finite)


def framed(blocks: DataFrame, keys: Sequence[str], size: int, frame: int = FRAME) -> DataFrame:
    """blocks(keys, block, x) to (keys, block, mean, var): arrays with an entry for
    each whole frame, told block by block where it is read. `size` is a multiple
    of `frame`, so no frame lies in two blocks; a last block of no whole frame
    has empty arrays."""
    if size % frame:
        raise ValueError("a block must hold whole frames")

    def kernel(x: np.ndarray) -> tuple:
        whole_frames = x[: len(x) // frame * frame].reshape(-1, frame)
        return whole_frames.mean(axis=1), whole_frames.var(axis=1)

    known = blocks.where(F.col("x").isNotNull())
    return map_arrays(known, [*keys, "block"], ["x"], [], {"mean": "array<double>", "var": "array<double>"}, kernel)


def frame_signal(blocks: DataFrame, keys: Sequence[str], size: int, frame: int = FRAME) -> DataFrame:
    """(keys, f, mean, var) of each whole frame."""
    each = framed(blocks, keys, size, frame).select(*keys, "block", F.posexplode(F.arrays_zip("mean", "var")).alias("i", "v"))
    return each.select(*keys, (F.col("block") * (size // frame) + F.col("i")).alias("f"), "v.mean", "v.var")


def steady_offset(means: np.ndarray, low: int, first: int, count: int, n: int, smooth: int, around: int) -> np.ndarray:
    """The offset under frames [first, first + count) of a file of `n` frames, from
    the `means` of its frames from `low` on: all that lie within reach."""
    half, width = around // 2, min(smooth, n)
    asked = np.arange(first - half, first + count + half)
    turned = asked % (2 * n)  # frames mirrored at the ends, again and again in a short file
    places, back = np.unique(np.where(turned < n, turned, 2 * n - 1 - turned), return_inverse=True)
    start = np.clip(places - smooth // 2, 0, n - width) - low
    smoothed = np.lib.stride_tricks.sliding_window_view(means, width)[start].mean(axis=1)
    return np.median(np.lib.stride_tricks.sliding_window_view(smoothed[back], 2 * half + 1), axis=1)


def frame_levels(
    frames: DataFrame, keys: Sequence[str], per_block: int, *, smooth: int = SMOOTH_FRAMES, around: int = OFFSET_FRAMES
) -> DataFrame:
    """frames(keys, block, mean, var), as `framed` gives them with `per_block` frames
    in a block, to (keys, f, rms): frame loudness less a steady offset. The offset
    is the median, over `around` frames mirrored at the ends, of frame means averaged
    over `smooth` frames kept inside the file; none under -60 dBFS. A block takes
    the frames within reach from its two neighbours."""
    keys = list(keys)
    reach = around // 2 + 2 * smooth
    if per_block < reach:
        raise ValueError(f"a block must hold at least {reach} frames")
    held = frames.where(F.size("mean") > 0)
    counts = held.groupBy(*keys).agg(F.sum(F.size("mean")).cast("long").alias("_n"))
    near = with_neighbours(held, keys, reach, ["mean"]).join(counts, keys)

    def kernel(mean, var, before, after, block, n) -> tuple:
        means = np.concatenate([v for v in (before, mean, after) if v is not None])
        first = block * per_block
        low = first - (0 if before is None else len(before))
        offset = steady_offset(means, low, first, len(mean), n, smooth, around)
        offset = offset * np.clip(np.abs(offset) / 1e-3 - 1, 0.0, 1.0)
        return (np.sqrt(var + np.minimum(mean * mean, (mean - offset) ** 2) + 1e-12),)

    levels = map_arrays(
        near, [*keys, "block"], ["mean", "var", "_before_mean", "_after_mean"], ["block", "_n"], {"rms": "array<double>"}, kernel
    )
    return levels.select(*keys, "block", F.posexplode("rms").alias("i", "rms")).select(
        *keys, (F.col("block") * per_block + F.col("i")).alias("f"), "rms"
    )


def relative_gate(levels: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    """(keys, gate): `ratio` of the average level, never under -60 dBFS."""
    return levels.groupBy(*keys).agg(F.greatest(F.lit(QUIETEST), F.avg("rms") * ratio).alias("gate"))


def above_gate(levels: DataFrame, keys: Sequence[str], *, ratio: float = 0.4, gate_db: float | None = None) -> DataFrame:
    """Levels with `flag`: louder than a fixed gate, or than the file's own."""
    if gate_db is not None:
        return levels.withColumn("flag", F.col("rms") > 10.0 ** (gate_db / 20.0))
    gates = relative_gate(levels, keys, ratio)
    return levels.join(gates, list(keys)).withColumn("flag", F.col("rms") > F.col("gate")).drop("gate")


def speech_spans(
    flagged: DataFrame, sizes: DataFrame, keys: Sequence[str], *, dip: int = 20, pad: int = 1920, frame: int = FRAME,
    block: int = 65536,
) -> DataFrame:
    """Loud frames to padded sample spans (keys, s, e), clipped to the file's
    `n_samples` (sizes)."""
    joined = join_dips(runs(flagged, keys, pos="f", flag="flag", block=block), keys, dip, block=block)
    return joined.join(sizes, list(keys)).select(
        *keys,
        F.greatest(F.col("s") * frame - pad, F.lit(0)).alias("s"),
        F.least(F.col("e") * frame + pad, F.col("n_samples")).alias("e"),
    )


def pauses(flagged: DataFrame, keys: Sequence[str], *, shortest: int = 10, block: int = 65536) -> DataFrame:
    """Runs of quiet frames at least `shortest` long, as (keys, s, e) frames."""
    return runs(flagged.withColumn("flag", ~F.col("flag")), keys, pos="f", flag="flag", shortest=shortest, block=block)


def filter_has_speech(clips: DataFrame, spans: DataFrame, keys: Sequence[str], *, bin_size: int) -> DataFrame:
    """Clips (keys, id, s, e) with any detected speech, and how much."""
    return overlap_sum(spans, clips, keys, block=bin_size).where("overlap > 0").withColumnRenamed("overlap", "speech")


def power_around(x: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The mean power of the `span` samples around each place of `x`, less their
    mean's; fewer samples at its ends. A short span is added up sample by sample,
    which is as quick as running sums and more exact."""
    half = span // 2
    low, high = np.clip(at - half, 0, len(x)), np.clip(at + half, 0, len(x))
    n = np.maximum(high - low, 1)
    if span <= DIRECT_SPAN:
        still = np.concatenate([np.zeros(half), x, np.zeros(half)])
        total, squares = np.zeros(len(at)), np.zeros(len(at))
        for step in range(2 * half):
            value = still[at + step]
            total += value
            squares += value * value
    else:
        away = x - (x.mean() if len(x) else 0.0)
        sums, powers = (np.concatenate([[0.0], np.cumsum(v)]) for v in (away, away * away))
        total, squares = sums[high] - sums[low], powers[high] - powers[low]
    return np.maximum(squares / n - (total / n) * (total / n), 0.0)


def span_power(blocks: DataFrame, keys: Sequence[str], span: int, size: int) -> DataFrame:
    """blocks(keys, block, x) to (keys, pos, power): runs of consecutive samples
    from `pos` on, with the mean power of the `span` samples around each, less
    their mean's, clipped at the file's ends. Inside a block it is told where the
    block is read; only `span` samples either side of an edge are shuffled."""
    half = span // 2
    if half < 1 or size < 2 * span:
        raise ValueError("a span must be two samples at least, and a block two spans")
    shape = {"pos": "bigint", "power": "array<double>"}

    def inside(x, block) -> tuple:
        return block * size + half, power_around(x, np.arange(half, len(x) - half), span)

    def across(tail, head, edge) -> tuple:
        left, right = (np.empty(0) if v is None else v for v in (tail, head))
        stop = len(left) + (len(right) if len(right) < span else half)
        start = max(0, len(left) - half)
        return edge - (len(left) - start), power_around(np.concatenate([left, right]), np.arange(start, stop), span)

    known = blocks.where(F.size("x") > 0)
    own = map_arrays(known.where(F.size("x") >= span), [*keys], ["x"], ["block"], shape, inside)
    # A file's first and last samples are at seams too, whose other side is null.
    edges = map_arrays(seams(known, keys, span, size), [*keys], ["tail", "head"], ["edge"], shape, across)
    return own.unionByName(edges).where(F.size("power") > 0)


def standardise_windows(
    blocks: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    size: int,
    *,
    window: int = WINDOW_SEC * RATE,
    context: int = CONTEXT_SEC * RATE,
    tail: int = TAIL_SEC * RATE,
    least: int = LEAST_SAMPLES,
) -> DataFrame:
    """(keys, win, core_s, core_e, n, mean, scale): each core window with its
    context, a short tail folded into the window before. Windows meet only at
    `context` from an edge, so a block is summed up by the three stretches of a
    window (its first and last `context`, and what lies between), and windows are
    put together from stretches: no sample is shuffled or copied."""
    if window < 2 * context:
        raise ValueError("a window must be twice its context")

    def sum_up(x, block) -> tuple:
        first = block * size
        turns = np.arange(first // window, (first + len(x) - 1) // window + 1)[:, None] * window
        marks = np.unique(np.clip((turns + np.array([0, context, window - context])).ravel(), first, first + len(x) - 1))
        at = np.unique(np.concatenate([[first], marks]))
        n = np.diff(np.concatenate([at, [first + len(x)]]))
        mean = np.add.reduceat(x, at - first) / n
        off = np.add.reduceat((x - np.repeat(mean, n)) ** 2, at - first)
        within = at % window
        stretch = np.where(within < context, 0, np.where(within < window - context, 1, 2))
        return at // window, stretch, n, mean, off

    shape = {"k": "array<bigint>", "stretch": "array<bigint>", "n": "array<bigint>", "mean": "array<double>", "off": "array<double>"}
    summed = map_arrays(blocks.where(F.size("x") > 0), [*keys], ["x"], ["block"], shape, sum_up)
    stretches = summed.select(*keys, F.inline(F.arrays_zip(*shape)))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_x"), F.sum(F.col("off") + F.col("n") * F.col("mean") * F.col("mean")).alias("_xx")]
    by_stretch = stretches.groupBy(*keys, "k", "stretch").agg(*sums)
    n = F.col("n_samples")
    count = F.when((n % window > 0) & (n % window < tail) & (n > window), whole(n, F.lit(window))).otherwise(
        whole(n + window - 1, F.lit(window))
    )
    placed = by_stretch.join(sizes.withColumn("_w", count), list(keys))
    last = F.col("_w") - 1
    beside = F.when(F.col("stretch") == 0, F.col("k") - 1).when(F.col("stretch") == 2, F.col("k") + 1).otherwise(F.col("k"))
    homes = F.array_distinct(F.transform(F.array("k", beside), lambda v: F.greatest(F.lit(0), F.least(last, v))))
    gathered = placed.withColumn("win", F.explode(homes)).groupBy(*keys, "win").agg(
        F.min("_w").alias("_w"), F.min("n_samples").alias("_t"), F.sum("n").alias("n"), F.sum("_x").alias("_x"), F.sum("_xx").alias("_xx")
    )
    mean = F.col("_x") / F.col("n")
    spread = F.greatest(F.col("_xx") / F.col("n") - mean * mean, F.lit(0.0))
    return gathered.where(F.col("n") >= least).select(
        *keys, "win", (F.col("win") * window).alias("core_s"),
        F.when(F.col("win") == F.col("_w") - 1, F.col("_t")).otherwise((F.col("win") + 1) * window).alias("core_e"),
        "n", mean.alias("mean"), F.sqrt(spread + 1e-7).alias("scale"),
    )


def _root_mean_square(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.when(F.size(values) > 0, F.sqrt(total / F.size(values))).otherwise(F.lit(0.0))


def level_match_context(x: Column, low: Column, high: Column) -> Column:
    """A piece whose [low, high) is the window: each side scaled down to the
    window's level where it is louder, never up."""

    def levelled(p: Column) -> Column:
        window = part(p["x"], p["low"], p["high"])

        def side(values: Column) -> Column:
            return let(
                F.struct(values.alias("v"), _root_mean_square(window).alias("level"), _root_mean_square(values).alias("around")),
                lambda s: F.when(
                    (s["around"] > s["level"]) & (s["level"] > 0),
                    F.transform(s["v"], lambda v: v.cast("double") * s["level"] / s["around"]),
                ).otherwise(F.transform(s["v"], lambda v: v.cast("double"))),
            )

        return F.concat(
            side(part(p["x"], F.lit(0), p["low"])),
            F.transform(window, lambda v: v.cast("double")),
            side(part(p["x"], p["high"], F.size(p["x"]))),
        )

    return let(F.struct(x.alias("x"), low.alias("low"), high.alias("high")), levelled)


def pause_then_syllable(levels: Column, first: Column) -> Column:
    """Whether, from frame `first`, a pause is followed by a syllable. Levels
    are over the speech's own."""
    quiet, loud = 10.0 ** (-PAUSE_DB / 20), 10.0 ** (-LOUD_DB / 20)
    start = F.struct(F.lit(0).alias("still"), F.lit(0).alias("heard"))

    def step(acc: Column, level: Column) -> Column:
        paused, done = acc["still"] >= PAUSE_FRAMES, acc["heard"] >= SYLLABLE_FRAMES
        return F.struct(
            F.when(paused, acc["still"]).when(level < quiet, acc["still"] + 1).otherwise(F.lit(0)).alias("still"),
            F.when(done, acc["heard"]).when(paused & (level > loud), acc["heard"] + 1).otherwise(F.lit(0)).alias("heard"),
        )

    tail = let(levels, lambda v: part(v, F.greatest(first, F.lit(0)), F.size(v)))
    return F.aggregate(tail, start, step, lambda acc: acc["heard"] >= SYLLABLE_FRAMES)


def slice_pieces(blocks: DataFrame, windows: DataFrame, *, block: int) -> DataFrame:
    """blocks(file, block, x array) cut to windows(file, piece, ws, we) as
    (file, piece, x). A window names its blocks, so the join is on equality; a
    piece is at most its model's longest chunk."""
    asked = windows.where(F.col("we") > F.col("ws")).withColumn(
        "block", F.explode(F.sequence(whole(F.col("ws"), F.lit(block)), whole(F.col("we") - 1, F.lit(block))))
    )
    start = F.greatest(F.col("ws") - F.col("block") * block, F.lit(0))
    stop = F.least(F.col("we") - F.col("block") * block, F.lit(block))
    cut = blocks.join(asked, ["file", "block"]).select("file", "piece", "block", part(F.col("x"), start, stop).alias("x"))
    return cut.groupBy("file", "piece").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda b: b["x"])).alias("x")
    )
