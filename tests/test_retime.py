"""Words against pauses: invariants on random words, and cases worked out by hand."""

import random

from pyspark.sql import functions as F

from voxloom.operators.retime import retime_words

LENGTH = 40.0


def _retimed(spark, cases):
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, w array<struct<word:string,start:double,end:double>>, g array<struct<s:double,e:double>>")
    out = frame.select("i", retime_words(F.col("w"), F.col("g"), F.lit(0.0), F.lit(LENGTH)).alias("w")).collect()
    return [[(w.word, w.start, w.end) for w in r.w] for r in sorted(out, key=lambda r: r.i)]


def _random_case(rng):
    words, at = [], rng.uniform(0, 2)
    for i in range(rng.randrange(1, 12)):
        length = rng.uniform(0.05, 0.8)
        words.append((f"word{i}" + rng.choice(["", "", ".", ","]), round(at, 2), round(at + length, 2)))
        at += length + rng.choice([0, 0, rng.uniform(0, 2.5)])
    gaps, at = [], rng.uniform(0, 3)
    while at < LENGTH - 4:
        length = rng.uniform(0.3, 2)
        gaps.append((round(at, 2), round(at + length, 2)))
        at += length + rng.uniform(0.5, 5)
    return words, gaps


def test_words_keep_their_names_and_order(spark):
    rng = random.Random(12)
    cases = [_random_case(rng) for _ in range(150)]
    for (words, _gaps), got in zip(cases, _retimed(spark, cases)):
        assert [w for w, _s, _e in got] == [w for w, _s, _e in words]
        assert all(0 <= s <= e <= LENGTH for _w, s, e in got)
        starts = [s for _w, s, _e in got]
        assert starts == sorted(starts)


def test_words_far_from_pauses_stay(spark):
    rng = random.Random(13)
    cases = [_random_case(rng) for _ in range(100)]
    for (words, gaps), got in zip(cases, _retimed(spark, cases)):
        touched = lambda s, e: any(s < b and a < e for a, b in gaps)
        if not any(touched(s, e) for _w, s, e in words):
            assert got == words


def test_no_pauses_change_nothing(spark):
    rng = random.Random(14)
    cases = [(_random_case(rng)[0], []) for _ in range(20)]
    assert _retimed(spark, cases) == [words for words, _ in cases]


def test_a_word_inside_a_pause_moves_to_its_nearer_side(spark):
    pause = [(11.5, 12.75)]
    (late,), (ended,) = _retimed(spark, [([("pebble", 11.75, 12.0)], pause), ([("pebble.", 11.75, 12.0)], pause)])
    assert (round(late[1], 2), round(late[2], 2)) == (12.75, 13.0)
    assert (round(ended[1], 2), round(ended[2], 2)) == (11.25, 11.5)
