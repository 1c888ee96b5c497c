"""Packing speech into ranges: exact cases and invariants."""

import random

from voxloom.operators.planning import plan_chunks

R = 16_000


def _plan(spark, files, **bounds):
    speech = [(f, int(s * R), int(e * R)) for f, (total, spans) in files.items() for s, e in spans]
    sizes = [(f, int(total * R)) for f, (total, _spans) in files.items()]
    out = plan_chunks(
        spark.createDataFrame(speech, "file string, s long, e long"), spark.createDataFrame(sizes, "file string, total long"),
        **{k: int(v * R) for k, v in bounds.items() if k != "step"}, step=bounds.get("step", 0),
    ).collect()
    return {f: sorted((r.rs / R, r.re / R, r.ws / R, r.we / R) for r in out if r.file == f) for f in files}


def test_known_layouts(spark):
    got = _plan(
        spark,
        {"a": (160, [(0, 10), (40, 150)]), "b": (43.5, [(0, 18.8), (21.5, 43.5)]), "c": (15, []), "d": (90, [])},
        target=20, maximum=20, least=20,
    )
    assert [p[:2] for p in got["b"]] == [(0, 20), (20, 31.75), (31.75, 43.5)]
    assert got["c"] == [(0, 15, 0, 15)] and got["d"] == []
    assert not any(s < 39.9 and e > 13.1 for s, e, *_ in got["a"])


def test_ranges_and_windows_keep_their_bounds(spark):
    rng = random.Random(7)
    files = {}
    for n in range(60):
        at, spans = rng.uniform(0, 5), []
        for _ in range(rng.randrange(1, 40)):
            end = at + rng.choice([0.5, 2, 6, 14, 70]) * rng.uniform(0.5, 1.5)
            spans.append((round(at, 2), round(end, 2)))
            at = end + rng.choice([0.3, 0.9, 2.0, 4.0, 9.0])
        files[f"f{n}"] = (round(at + 1, 2), spans)
    plan = _plan(spark, files, target=60, maximum=75, least=20, context=5, step=1280)
    for name, (total, spans) in files.items():
        pieces = plan[name]
        assert pieces
        for (rs, re, ws, we), nxt in zip(pieces, [*pieces[1:], None]):
            assert 0 <= ws <= rs < re <= we <= total + 1e-9
            if total > 75:
                assert re - rs <= 65 + 1e-9
            assert we - ws <= 75 + 1e-9
            assert nxt is None or re <= nxt[0] + 1e-9
        heard = sum(max(0, min(e, p[1]) - max(s, p[0])) for s, e in spans for p in pieces)
        assert abs(heard - sum(e - s for s, e in spans)) < 0.02 * len(spans)
        for (_, re, _, we), nxt in zip(pieces, pieces[1:]):
            if re < nxt[0]:
                assert we == re
