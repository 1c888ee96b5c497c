"""A recogniser's tokens, held as arrays in the row of their piece.

A piece is at most its model's longest chunk, some hundreds of tokens, so these
work inside the row: no token is ever shuffled. Every expression is linear in
the number of tokens except where it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.arrays import at, indices, let, part
from voxloom.functions.text import MARKER, SPACE, strip

# Fixed value: the recogniser gives token starts only; a token lasts at most this long.
WORD_TAIL_SEC = 0.32


def repair_timestamps(tokens: Column, timestamps: Column) -> Column:
    """One time per token: a missing, non-finite or negative one takes the last
    good one before it, 0.0 at the start."""

    def usable(times: Column, i: Column) -> Column:
        return let(
            at(times, i),
            lambda t: t.isNotNull() & ~F.isnan(t) & (t >= 0) & (t < F.lit(float("inf"))),
        )

    def filled(times: Column, count: Column, good: Column) -> Column:
        runs = F.transform(
            good,
            lambda g, k: F.array_repeat(at(times, g), (F.coalesce(at(good, k + 1), count) - g).cast("int")),
        )
        lead = F.array_repeat(F.lit(0.0), F.coalesce(at(good, F.lit(0)), count).cast("int"))
        return F.concat(lead, F.flatten(runs))

    return let(
        F.struct(timestamps.alias("t"), F.size(tokens).alias("n")),
        lambda both: let(
            F.filter(indices(both["n"]), lambda i: usable(both["t"], i)),
            lambda good: filled(both["t"], both["n"], good),
        ),
    )


def word_spans(tokens: Column) -> Column:
    """array<struct<word, first, last>>: a token led by the marker, or following
    a lone marker, opens a word; tokens with no text belong to none."""
    spaced = F.transform(tokens, lambda t: F.replace(t, F.lit(MARKER), F.lit(" ")))

    def bare(texts: Column) -> Column:
        # one search over a piece tells whether any token needs more than blanks taken off
        odd = F.array_join(texts, "").rlike(rf"[{SPACE}&&[^ ]]")
        cut = lambda t, strip: F.struct(strip(t).alias("text"), t.startswith(" ").alias("opens"))
        return F.when(odd, F.transform(texts, lambda t: cut(t, strip))).otherwise(F.transform(texts, lambda t: cut(t, F.trim)))

    both = let(spaced, bare)

    def group(parts: Column) -> Column:
        solid = F.filter(indices(F.size(parts)), lambda i: F.get(parts, i)["text"] != "")

        def heads(spoken: Column) -> Column:
            opening = F.filter(
                indices(F.size(spoken)),
                lambda k: (k == 0)
                | F.exists(
                    part(parts, F.get(spoken, k - 1) + 1, F.get(spoken, k) + 1), lambda p: p["opens"]
                ),
            )
            return let(
                opening,
                lambda opened: F.transform(
                    opened,
                    lambda k, w: let(
                        part(spoken, k, F.coalesce(at(opened, w + 1), F.size(spoken))),
                        lambda own: F.struct(
                            F.array_join(F.transform(own, lambda i: F.get(parts, i)["text"]), "").alias("word"),
                            F.get(own, F.lit(0)).alias("first"),
                            F.get(own, F.size(own) - 1).alias("last"),
                        ),
                    ),
                ),
            )

        return let(solid, heads)

    return let(both, group)


def timed_words(spans: Column, timestamps: Column, chunk_start: Column, chunk_end: Column) -> Column:
    """array<struct<word, start, end>> in absolute seconds: a word ends at the
    next one's start, its last token's longest reach or the chunk's end,
    whichever is first, and never before it starts."""

    def bound(spans: Column, timestamps: Column, span: Column, i: Column) -> Column:
        start = F.least(chunk_end, F.greatest(chunk_start, chunk_start + F.get(timestamps, span["first"])))
        following = at(spans, i + 1)
        nxt = F.coalesce(chunk_start + F.get(timestamps, following["first"]), chunk_end)
        reach = chunk_start + F.get(timestamps, span["last"]) + WORD_TAIL_SEC
        return F.struct(
            span["word"].alias("word"),
            start.alias("start"),
            F.least(chunk_end, F.greatest(start, F.least(nxt, reach))).alias("end"),
        )

    return let(
        F.struct(spans.alias("s"), timestamps.alias("t")),
        lambda both: F.transform(both["s"], lambda span, i: bound(both["s"], both["t"], span, i)),
    )


def segment_of(text: Column, timestamps: Column, chunk_start: Column, chunk_end: Column) -> Column:
    """struct<start, end, text> of a piece, null when it heard nothing."""

    def bounded(both: Column) -> Column:
        times, heard = both["times"], both["text"]
        has = F.size(times) > 0
        start = F.when(
            has, F.least(chunk_end, F.greatest(chunk_start, chunk_start + F.get(times, F.lit(0))))
        ).otherwise(chunk_start)
        full = F.greatest(start, chunk_end)
        last = F.get(times, F.size(times) - 1)
        end = F.when(has, F.least(full, F.greatest(start, chunk_start + last + WORD_TAIL_SEC))).otherwise(full)
        return F.when(heard != "", F.struct(start.alias("start"), end.alias("end"), heard.alias("text")))

    return let(F.struct(timestamps.alias("times"), text.alias("text")), bounded)


def spread(parts: Column, start: Column, end: Column) -> Column:
    """array<struct<word, start, end>>: a span shared out by length, the last
    part ending exactly at the end. Quadratic in copies of references only."""
    edges = F.aggregate(
        parts,
        F.array(F.lit(0)),
        lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.char_length(p)),
    )

    def shared(both: Column) -> Column:
        reach, size, own = both["reach"], F.element_at(both["reach"], -1), both["parts"]
        return F.transform(
            own,
            lambda p, i: F.struct(
                p.alias("word"),
                (both["start"] + (both["end"] - both["start"]) * F.get(reach, i) / size).alias("start"),
                F.when(i == F.size(own) - 1, both["end"])
                .otherwise(both["start"] + (both["end"] - both["start"]) * F.get(reach, i + 1) / size)
                .alias("end"),
            ),
        )

    bound = F.struct(edges.alias("reach"), parts.alias("parts"), start.alias("start"), end.alias("end"))
    return let(bound, shared)
