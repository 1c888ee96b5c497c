"""Signals in blocks against the same values told over the whole signal at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import blocks as bl
from voxloom.operators import signal as sg

SIZE = 128
RNG = np.random.default_rng(3)
# Lengths on, just under and just over a block's edge, and shorter than any window.
SIGNALS = {f"f{n}": RNG.normal(0.02, 0.1, n) for n in (1, 3, 5, 20, 127, 128, 129, 131, 256, 700, 1283)}


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(k, b, [float(v) for v in x[b * SIZE : (b + 1) * SIZE]]) for k, x in SIGNALS.items() for b in range(-(-len(x) // SIZE))]
    return spark.createDataFrame(rows, "file string, block bigint, x array<double>")


def test_chunks_are_cut_anew(spark):
    rows, whole = [], {}
    for name, x in SIGNALS.items():
        cuts = np.sort(RNG.integers(0, len(x) + 1, 7))
        parts = np.split(x, cuts)
        rows += [(name, i * 5 - 9, [float(v) for v in part]) for i, part in enumerate(parts)]  # some are empty
        whole[name] = x
    rows += [("f3", 900, None), ("none", 0, []), ("none", 1, None)]
    chunks = spark.createDataFrame(rows, "file string, ord bigint, x array<double>")
    found = {}
    for row in bl.reblocked(chunks, ["file"], 50).orderBy("file", "block").collect():
        found.setdefault(row.file, []).append(row)
    assert set(found) == set(whole)
    for name, parts in found.items():
        assert [p.block for p in parts] == list(range(len(parts)))
        assert all(len(p.x) == 50 for p in parts[:-1])
        assert np.array_equal(np.concatenate([p.x for p in parts]), whole[name])


def test_sizes(blocks):
    assert {r.file: r.n_samples for r in bl.sizes_of(blocks, ["file"]).collect()} == {k: len(v) for k, v in SIGNALS.items()}


def test_frames(blocks):
    got = {(r.file, r.f): (r.mean, r["var"]) for r in sg.frame_signal(blocks, ["file"], SIZE, 4).collect()}
    for name, x in SIGNALS.items():
        for f in range(len(x) // 4):
            part = x[4 * f : 4 * f + 4]
            assert got.pop((name, f)) == pytest.approx((part.mean(), part.var()))
    assert not got
    with pytest.raises(ValueError):
        sg.frame_signal(blocks, ["file"], SIZE, 3)


def test_levels(blocks):
    """Each frame by the definition: every average, mirror and median spelt out."""
    frames = sg.framed(blocks, ["file"], SIZE, 2)
    got = {(r.file, r.f): r.rms for r in sg.frame_levels(frames, ["file"], SIZE // 2).collect()}
    for name, x in SIGNALS.items():
        n = len(x) // 2
        means = [x[2 * f : 2 * f + 2].mean() for f in range(n)]
        smooth = []
        for f in range(n):
            low = min(max(f - 6, 0), max(0, n - 12))
            smooth.append(np.mean(means[low : low + 12]))
        for f in range(n):
            near = []
            for at in range(f - 25, f + 26):
                while not 0 <= at < n:
                    at = -1 - at if at < 0 else 2 * n - 1 - at
                near.append(smooth[at])
            offset = np.median(near)
            offset *= min(max(abs(offset) / 1e-3 - 1, 0), 1)
            mean, var = means[f], x[2 * f : 2 * f + 2].var()
            assert got.pop((name, f)) == pytest.approx(np.sqrt(var + min(mean**2, (mean - offset) ** 2) + 1e-12))
    assert not got
    with pytest.raises(ValueError):
        sg.frame_levels(frames, ["file"], 40)


@pytest.mark.parametrize("span", [2, 7, 8, 50, 64])
def test_power(blocks, span):
    got = {}
    for row in sg.span_power(blocks, ["file"], span, SIZE).collect():
        for i, power in enumerate(row.power):
            assert (row.file, row.pos + i) not in got
            got[row.file, row.pos + i] = power
    for name, x in SIGNALS.items():
        for p in range(len(x)):
            near = x[max(0, p - span // 2) : p + span // 2]
            assert got.pop((name, p)) == pytest.approx(near.var(), abs=1e-12)
    assert not got


@pytest.mark.parametrize("window,context,tail", [(20, 4, 6), (50, 25, 30), (300, 20, 100), (7, 0, 3)])
def test_windows(blocks, window, context, tail):
    out = sg.standardise_windows(
        blocks, bl.sizes_of(blocks, ["file"]), ["file"], SIZE, window=window, context=context, tail=tail, least=3
    )
    got = {(r.file, r.win): (r.core_s, r.core_e, r.n, r["mean"], r.scale) for r in out.collect()}
    for name, x in SIGNALS.items():
        bounds = [*range(0, len(x), window), len(x)]
        if len(bounds) > 2 and bounds[-1] - bounds[-2] < tail:
            bounds.pop(-2)
        for win, (low, high) in enumerate(zip(bounds, bounds[1:])):
            piece = x[max(0, low - context) : high + context]
            if len(piece) >= 3:
                assert got.pop((name, win)) == pytest.approx((low, high, len(piece), piece.mean(), np.sqrt(piece.var() + 1e-7)))
    assert not got


def test_no_blocks_null_blocks_and_clashing_columns(spark, blocks):
    nothing = blocks.where(F.lit(False))
    assert sg.frame_signal(nothing, ["file"], SIZE, 4).count() == 0
    assert sg.span_power(nothing, ["file"], 8, SIZE).count() == 0
    odd = spark.createDataFrame(
        [(None, 0, [1.0, 2.0, 3.0], 1, "a"), ("x", 0, None, 2, "b")], "file string, block bigint, x array<double>, n int, mean string"
    )
    assert [(r.file, r.f, r["mean"]) for r in sg.frame_signal(odd, ["file"], SIZE, 2).collect()] == [(None, 0, 1.5)]
    assert [(r.file, r.pos, len(r.power)) for r in sg.span_power(odd, ["file"], 2, SIZE).orderBy("pos").collect()] == [(None, 0, 1), (None, 1, 1), (None, 2, 1)]


def test_no_sample_is_a_row(blocks):
    """Only edges are shuffled for power, and nothing for frames."""
    plan = sg.frame_signal(blocks, ["file"], SIZE, 4)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
