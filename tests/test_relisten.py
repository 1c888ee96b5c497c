"""Quiet stretches listened to again, against one frame at a time."""

import random
import statistics

from pyspark.sql import functions as F

from voxloom.operators import relisten as rl


def runs_of(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def tenth(values):
    v = sorted(values)
    place = (len(v) - 1) * 0.1
    low = int(place)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (place - low)


def by_frames(rms, ratio, relisten, dip, enough):
    """Loud frames, by the rules of the docstring, a frame at a time."""
    loud = [x > max(1e-3, ratio * statistics.fmean(rms)) for x in rms]
    todo = [r for r in runs_of([not x for x in loud]) if r[1] - r[0] >= relisten]
    while todo:
        a, b = todo.pop()
        part = rms[a:b]
        gate = max(1e-3, ratio * statistics.fmean(part), tenth(part) * 10**0.5)
        padded = [part[0]] * 2 + part + [part[-1]] * 2
        heard = [sorted(padded[i : i + 5])[2] > gate for i in range(len(part))]
        sounds = []
        for s, e in runs_of(heard):
            if sounds and s - sounds[-1][1] < dip:
                sounds[-1][1] = e
            else:
                sounds.append([s, e])
        counting = [(s, e) for s, e in sounds if sum(heard[s:e]) >= enough]
        near = lambda i, more=0: any(s - relisten - more <= i < e + relisten + more for s, e in counting)
        kept = [h and near(i) for i, h in enumerate(heard)]
        for s, e in sounds:
            if any(near(i) for i in range(s, e)):
                for i in range(s, e):
                    loud[a + i] |= heard[i] and near(i, enough)
        if any(kept):
            todo += [(a + s, a + e) for s, e in runs_of([not k for k in kept]) if e - s >= relisten]
    return loud


def signals():
    r = random.Random(12)
    out = {}
    for n in range(25):
        rms = []
        while len(rms) < 160:
            level = r.choice([0.002, 0.003, 0.02, 0.05, 0.4, 1.0])
            rms += [level * r.uniform(0.7, 1.3) for _ in range(r.choice([1, 2, 3, 6, 12, 30]))]
        out[n] = rms
    # a loud speaker, then two ever quieter ones: one round for each
    out[99] = [1.0 + k % 3 / 10 for k in range(40)] + [0.002] * 20 + [0.05 + k % 3 / 100 for k in range(14)] + [0.002] * 30 + [0.008 + k % 3 / 1000 for k in range(8)] + [0.0021] * 30
    return out


def test_loud_runs_are_those_of_every_frame(spark):
    every = signals()
    levels = spark.createDataFrame([(k, f, x) for k, rms in every.items() for f, x in enumerate(rms)], "key long, f long, rms double").repartition(3)
    got = rl.loud_runs(levels, ["key"], ratio=0.4, relisten=12, dip=3, enough=4, block=50)
    found = {k: [] for k in every}
    for r in got.collect():
        found[r.key].append((r.s, r.e))
    want = {k: runs_of(by_frames(rms, 0.4, 12, 3, 4)) for k, rms in every.items()}
    assert {k: sorted(v) for k, v in found.items()} == want
    first = {k: runs_of([x > max(1e-3, 0.4 * statistics.fmean(rms)) for x in rms]) for k, rms in every.items()}
    assert sum(want[k] != first[k] for k in every) > 5  # listening again changes something
    quiet = rl.quiet_runs(got, levels, ["key"], shortest=2, block=50)
    assert sorted((r.key, r.s, r.e) for r in quiet.collect()) == sorted(
        (k, s, e) for k, rms in every.items() for s, e in runs_of([not any(a <= i < b for a, b in want[k]) for i in range(len(rms))]) if e - s >= 2
    )


def test_short_and_empty_files(spark):
    levels = spark.createDataFrame([("a", 0, 0.5)], "key string, f long, rms double")
    sizes = spark.createDataFrame([("a", 320), ("b", 100), ("c", 100)], "key string, n_samples long")
    short = spark.createDataFrame([("b", 0.2), ("c", 1e-5)], "key string, peak double")
    got = rl.speech_spans_volume(levels, sizes, ["key"], relisten=12, short=short)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, 320), ("b", 0, 100)]
    assert rl.loud_runs(levels.where(F.lit(False)), ["key"], ratio=0.4, relisten=12).count() == 0
