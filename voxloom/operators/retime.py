"""Word times moved out of the pauses they slipped into.

A chunk's words and the parts of pauses inside it are arrays in its row; both
are bounded by the chunk's length, so the two folds run in place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.arrays import let

# Fixed values.
SHORTEST = 0.04
CLOSES = r"""[.,;:?!…"'”’)]$"""
WORD = "struct<word:string,start:double,end:double>"


def _timed(word: Column, start: Column, end: Column) -> Column:
    return F.struct(word.alias("word"), start.cast("double").alias("start"), end.cast("double").alias("end"))


def _before(word: Column, gap: Column, low: Column, high: Column) -> Column:
    """Whether a word wholly inside a gap belongs before it."""
    return F.when(gap["e"] >= high, True).when(gap["s"] <= low, False).otherwise(word["word"].rlike(CLOSES))


def _crowded(gap: Column, words: Column, low: Column, high: Column) -> Column:
    """A gap that is the whole chunk, or with more than one word for a side, or
    one for after it and then one for before: speech, not a pause."""
    inside = F.filter(words, lambda w: (w["start"] >= gap["s"]) & (w["start"] < gap["e"]) & (w["end"] <= gap["e"]))

    def judged(sides: Column) -> Column:
        ahead = F.size(F.filter(sides, lambda s: s))
        crossed = (F.size(sides) == 2) & ~F.get(sides, F.lit(0)) & F.get(sides, F.lit(1))
        return (ahead > 1) | (F.size(sides) - ahead > 1) | F.coalesce(crossed, F.lit(False))

    return ((gap["s"] <= low) & (gap["e"] >= high)) | let(F.transform(inside, lambda w: _before(w, gap, low, high)), judged)


def _against(word: Column, gap: Column, previous: Column, low: Column, high: Column) -> Column:
    """A word moved by one gap it touches."""
    first, last, s, e = word["start"], word["end"], gap["s"], gap["e"]
    name = word["word"]
    inside = (first >= s) & (last <= e)
    return (
        F.when((last <= s) | (first >= e), word)
        .when(inside & _before(word, gap, low, high), _timed(name, F.greatest(s - (last - first), previous), s))
        .when(inside, _timed(name, e, e + (last - first)))
        .when((first < s) & (last > e), _timed(name, first, s))
        .when(first >= s, _timed(name, e, F.greatest(last, e)))
        .otherwise(_timed(name, first, s))
    )


def retime_words(words: Column, gaps: Column, low: Column, high: Column) -> Column:
    """array<struct<word, start, end>>: words array<struct<word, start, end>>
    moved out of `gaps` array<struct<s, e>>, a chunk being low..high; then put in
    order, 40 ms at least, and held in the chunk."""

    def moved(b: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{WORD}>").alias("out"), b["low"].alias("end"))

        def step(acc: Column, w: Column) -> Column:
            passed = F.size(F.filter(b["g"], lambda g: g["e"] <= w["start"]))
            near = let(passed, lambda k: F.slice(
                b["g"], F.greatest(k, F.lit(1)), F.when(k > 0, F.lit(3)).otherwise(F.lit(2))
            ))
            return let(
                F.aggregate(near, _timed(w["word"], w["start"], w["end"]), lambda x, g: _against(x, g, acc["end"], b["low"], b["high"])),
                lambda x: F.struct(F.array_append(acc["out"], x).alias("out"), x["end"].alias("end")),
            )

        return F.aggregate(b["w"], start, step, lambda acc: acc["out"])

    def ordered(b: Column, w: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{WORD}>").alias("out"), F.lit(float("-inf")).alias("end"))

        def step(acc: Column, x: Column) -> Column:
            return let(
                F.greatest(x["start"], acc["end"]),
                lambda begin: let(
                    F.greatest(x["end"], begin + SHORTEST),
                    lambda end: F.struct(F.array_append(acc["out"], _timed(x["word"], begin, end)).alias("out"), end.alias("end")),
                ),
            )

        held = lambda x: let(
            F.least(F.greatest(x["start"], b["low"]), b["high"]),
            lambda begin: _timed(x["word"], begin, F.least(F.greatest(x["end"], begin), b["high"])),
        )
        return F.transform(F.aggregate(w, start, step, lambda acc: acc["out"]), held)

    def real(b: Column) -> Column:
        kept = F.filter(b["g"], lambda g: ~_crowded(g, b["w"], b["low"], b["high"]))
        return let(
            F.struct(b["w"].alias("w"), kept.alias("g"), b["low"].alias("low"), b["high"].alias("high")),
            lambda c: let(moved(c), lambda w: ordered(c, w)),
        )

    bound = F.struct(words.alias("w"), gaps.alias("g"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    return let(bound, real)
