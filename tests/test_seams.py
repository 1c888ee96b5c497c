"""Sequence matching against brute force, and second decodes by example."""

import itertools
import random

from pyspark.sql import functions as F

from voxloom.operators import reconcile as rc
from voxloom.operators.seams import best_matching


def _brute(lows, highs, within):
    pairs = [
        (a["i"], b["i"], a["at"], b["at"]) for a in lows for b in highs
        if a["key"] and a["key"] == b["key"] and abs(a["at"] - b["at"]) <= within
    ]
    best = (0, 0.0, ())
    for n in range(1, len(pairs) + 1):
        for chosen in itertools.combinations(pairs, n):
            if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chosen, chosen[1:])):
                best = max(best, (n, -round(sum(abs(p[2] - p[3]) for p in chosen), 9), chosen))
    return best[2]


def test_matching_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(150):
        side = lambda: [
            {"i": i, "at": round(0.25 * i + rng.choice([0, 0.125]), 3), "key": rng.choice(["a", "b", ""])} for i in range(rng.randrange(1, 5))
        ]
        lows, highs = side(), side()
        assert best_matching(lows, highs, 0.4) == _brute(lows, highs, 0.4)


def test_redo_windows_ladder(spark):
    sec = 16_000

    def ask(ws, we, stretches):
        frame = spark.createDataFrame([(ws * sec, we * sec, [(s * sec, e * sec) for s, e in stretches])], "ws long, we long, g array<struct<s:long,e:long>>")
        return [(w.s / sec, w.e / sec) for w in frame.select(rc.redo_windows(F.col("ws"), F.col("we"), F.col("g")).alias("r")).first().r]

    assert ask(0, 60, [(10, 20), (22, 30), (50, 55)]) == [(8, 32), (48, 57)]
    assert ask(0, 60, [(1, 59)]) == [(1, 59)]
    assert ask(0, 60, [(0, 60)]) == []
    assert ask(0, 60, [(0, 29), (31, 60)]) == [(0, 31), (29, 60)]


def test_a_word_is_heard_another_way(spark):
    rows = [("Tail.", "TAL", True), ("Lorry", "Lori,", True), ("rat-hole", "ro", False), ("III", "three", True), ("garden", "them", False), (".", "so", True)]
    frame = spark.createDataFrame(
        [(w, 16_000, [(o, 16_000, 16_000)], want) for w, o, want in rows],
        "word string, at long, spoken array<struct<word:string,first:long,last:long>>, want boolean",
    )
    wrong = rc.fuzzy_heard(frame).where("heard <> want").collect()
    assert not wrong


def test_made_up_endings_go_only_when_nobody_heard_them(spark):
    sec = 16_000
    said = ["▁north", "▁wind", "▁blows", "▁cold", "▁ghost"]
    times = [1.0, 2.0, 7.0, 9.0, 9.6]
    word = lambda w, t: (w, int(t * sec), int(t * sec) + 3200)
    full = [word(w[1:], t) for w, t in zip(said, times)]
    loud = [1.0] * 100
    late = [1.0] * 50 + [0.01] * 20 + [1.0] * 30
    cases = {
        "gone": ([full[:4], full[:4]], loud), "one heard it": ([full[:4], full], loud), "another word there": ([full[:4], [*full[:4], word("rain", 9.6)]], loud),
        "lost speech": ([full[:4], []], loud), "said alone": ([full[:4], full[:4]], late), "not decoded": ([], loud), "two gone": ([full[:3], full[:3]], loud),
    }
    rows = [(name, 0, 0, 10 * sec, 8 * sec + 8000, said, times, again, levels) for name, (again, levels) in cases.items()]
    rows.append(("one word", 0, 0, 10 * sec, 0, ["▁only"], [9.8], [[], []], loud))
    frame = spark.createDataFrame(rows, "file string, piece int, ws long, we long, begin long, tokens array<string>, timestamps array<double>, again array<array<struct<word:string,first:long,last:long>>>, levels array<double>")
    frame = frame.withColumn("timestamps", F.when(F.col("file") == "two gone", F.array(*[F.lit(t) for t in (1.0, 2.0, 7.0, 9.3, 9.6)])).otherwise(F.col("timestamps")))
    got = {r.file: (r.dropped, len(r.tokens)) for r in rc.drop_made_up_endings(frame).collect()}
    assert got == {"gone": (1, 4), "one heard it": (0, 5), "another word there": (0, 5), "lost speech": (0, 5), "said alone": (0, 5), "not decoded": (0, 5), "two gone": (2, 3), "one word": (0, 1)}
