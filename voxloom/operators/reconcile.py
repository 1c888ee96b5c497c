"""Repeated decodes of the same audio: what the first skipped, and whether the
second is to be believed. Samples are file positions at 16 kHz."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import numbers as nb
from voxloom.functions.arrays import at, indices, let, pinned
from voxloom.functions.text import WORD, seam_key
from voxloom.functions.tokens import word_spans
from voxloom.operators.intervals import overlap_sum
from voxloom.operators.signal import pause_then_syllable

# Fixed values.
RATE = 16_000
STALL = 3 * RATE
TAIL = 5120
MIN_WORDS = 2
MARGIN = 2 * RATE
PART = 8 * RATE
NEAR = RATE
SPOKEN_BEFORE, SPOKEN_AFTER = 1600, 2400
MADE_UP = 12000
ENDING, LEAD = 8 * RATE, RATE
PAUSE_FRAMES, PAUSE_DB, FRAME = 5, 15.0, 320
NUMBER_WORDS = (*nb.ONES, *nb.TENS[2:], *nb.SCALE_WORDS, *nb.ORDINALS.values())
NUMBERISH = rf"^(\d+(st|nd|rd|th|s)?|[ivxlc]+|({'|'.join(NUMBER_WORDS)})(th|s)?)$"


def samples(seconds: Column) -> Column:
    return F.floor(seconds * RATE)


def untimed_stretches(results: DataFrame) -> DataFrame:
    """Results with `stretches`: gaps of 3 s or more in the piece's own range
    with no token that holds a word character."""
    heard = F.array_sort(
        F.transform(
            F.filter(F.arrays_zip("tokens", "timestamps"), lambda p: p["tokens"].rlike(WORD)),
            lambda p: F.col("ws") + samples(p["timestamps"]),
        )
    )

    def gaps(marks: Column) -> Column:
        clipped = F.transform(
            indices(F.size(marks) + 1),
            lambda k: F.struct(
                F.greatest(F.coalesce(at(marks, k - 1) + TAIL, F.col("ws")), F.col("rs")).alias("s"),
                F.least(F.coalesce(at(marks, k), F.col("we")), F.col("re")).alias("e"),
            ),
        )
        return F.filter(clipped, lambda g: g["e"] - g["s"] >= STALL)

    return pinned(results, stretches=let(heard, gaps)).select(*[c for c in results.columns if c != "stretches"], "stretches")


def stalled_stretches(untimed: DataFrame, speech: DataFrame, *, block: int = 65536 * 16) -> DataFrame:
    """(file, piece, k, s, e, overlap): the stretches with 3 s or more of
    detected speech (file, s, e)."""
    rows = untimed.select("file", "piece", F.posexplode("stretches").alias("k", "g")).select(
        "file", "piece", "k", F.col("g.s").alias("s"), F.col("g.e").alias("e")
    ).withColumn("id", F.shiftleft(F.col("piece").cast("long"), 32) + F.col("k"))
    sums = overlap_sum(speech, rows.select("file", "id", "s", "e"), ["file"], block=block)
    return rows.join(sums, ["file", "id"]).where(F.col("overlap") >= STALL).drop("id")


def word_starts(results: DataFrame) -> Column:
    """Each word's start sample."""
    return let(
        F.struct(word_spans(F.col("tokens")).alias("s"), F.col("timestamps").alias("t")),
        lambda b: F.transform(b["s"], lambda w: F.col("ws") + samples(F.get(b["t"], w["first"]))),
    )


def count_within(starts: Column, stretches: Column, shorten: int = 0) -> Column:
    """How many starts lie in the stretches, each shortened at its end."""
    return F.aggregate(
        stretches,
        F.lit(0),
        lambda acc, g: acc + F.size(F.filter(starts, lambda x: (x >= g["s"]) & (x < g["e"] - shorten))),
    )


def accept_redo(first: DataFrame, again: DataFrame) -> DataFrame:
    """(file, piece, skipped_words, before, after, accepted). first(file, piece,
    rs, re, starts, stretches), again(file, piece, starts). A second decode
    stands when it hears two words or more where the first skipped speech and no
    fewer in the whole range."""
    second = again.select("file", "piece", F.col("starts").alias("redo"))
    own = F.array(F.struct(F.col("rs").alias("s"), F.col("re").alias("e")))
    counted = first.join(second, ["file", "piece"]).select(
        "file", "piece",
        count_within(F.col("redo"), F.col("stretches"), TAIL).alias("skipped_words"),
        count_within(F.col("starts"), own).alias("before"),
        count_within(F.col("redo"), own).alias("after"),
    )
    return counted.withColumn("accepted", (F.col("skipped_words") >= MIN_WORDS) & (F.col("after") >= F.col("before")))


def redo_windows(ws: Column, we: Column, stretches: Column) -> Column:
    """What to decode again: stretches with 2 s either side, overlapping ones
    as one; where that is the whole window, the bare span; where that is too,
    each stretch alone; a lone stretch that is the whole window, nothing."""
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def windowed(b: Column) -> Column:
        lo, hi = b["ws"], b["we"]
        wide = lambda g: span(F.greatest(lo, g["s"] - MARGIN), F.least(hi, g["e"] + MARGIN))
        is_whole = lambda g: (g["s"] == lo) & (g["e"] == hi)
        group = F.struct(
            F.lit(None).cast("bigint").alias("stop"), F.array().cast("array<array<struct<s:bigint,e:bigint>>>").alias("out")
        )

        def add(acc: Column, g: Column) -> Column:
            meets = wide(g)["s"] <= acc["stop"]
            return F.struct(
                wide(g)["e"].alias("stop"),
                F.when(
                    meets,
                    F.array_append(
                        F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array_append(F.element_at(acc["out"], -1), g)
                    ),
                ).otherwise(F.array_append(acc["out"], F.array(g))).alias("out"),
            )

        def choose(inside: Column) -> Column:
            head, last = F.get(inside, F.lit(0)), F.get(inside, F.size(inside) - 1)
            joined = span(wide(head)["s"], wide(last)["e"])
            bare = span(head["s"], last["e"])
            alone = F.transform(inside, lambda g: F.when(is_whole(wide(g)), g).otherwise(wide(g)))
            return (
                F.when(~is_whole(joined), F.array(joined))
                .when(~is_whole(bare), F.array(bare))
                .when(F.size(inside) > 1, alone)
                .otherwise(none)
            )

        return F.flatten(F.transform(F.aggregate(b["g"], group, add, lambda acc: acc["out"]), choose))

    return let(
        F.struct(
            ws.alias("ws"), we.alias("we"),
            F.transform(stretches, lambda g: span(g["s"].cast("bigint"), g["e"].cast("bigint"))).alias("g"),
        ),
        windowed,
    )


def parts_of(ws: Column, we: Column, pauses: Column) -> Column:
    """A window that heard nothing as parts of about 8 s, each cut at the pause
    nearest its even share; the window itself where there is no pause."""
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))

    def cut(b: Column) -> Column:
        count = F.ceil((b["we"] - b["ws"]) / PART)
        share = (b["we"] - b["ws"]) / count
        nearest = lambda k: F.array_min(
            F.transform(b["p"], lambda at_: F.struct(F.abs(at_ - (b["ws"] + share * k)).alias("d"), at_.alias("at")))
        )["at"]
        cuts = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), (count - 1).cast("int")), nearest)))
        edges = let(cuts, lambda c: F.concat(F.array(b["ws"]), c, F.array(b["we"])))
        parts = let(edges, lambda e: F.transform(indices(F.size(e) - 1), lambda k: span(F.get(e, k), F.get(e, k + 1))))
        return F.when((count < 2) | (F.size(b["p"]) == 0), F.array(span(b["ws"], b["we"]))).otherwise(parts)

    inside = F.filter(pauses, lambda p: (p > ws) & (p < we))
    return let(F.struct(ws.alias("ws"), we.alias("we"), inside.alias("p")), cut)


def spoken_words(results: DataFrame) -> Column:
    """array<struct<word, first, last>>: each word, the sample it starts at, and
    that of its last token with a word character."""

    def of(b: Column) -> Column:
        def one(w: Column) -> Column:
            lettered = F.filter(F.sequence(w["first"], w["last"]), lambda i: F.get(b["v"], i).rlike(WORD))
            last = F.coalesce(at(lettered, F.size(lettered) - 1), w["first"])
            return F.struct(
                w["word"].alias("word"),
                (F.col("ws") + samples(F.get(b["t"], w["first"]))).alias("first"),
                (F.col("ws") + samples(F.get(b["t"], last))).alias("last"),
            )

        return F.transform(b["s"], one)

    return let(
        F.struct(word_spans(F.col("tokens")).alias("s"), F.col("timestamps").alias("t"), F.col("tokens").alias("v")), of
    )


def words_near_cut(spoken: Column, cut: Column) -> Column:
    """Words starting within 1 s of a cut, with their comparison keys."""
    return F.transform(
        F.filter(spoken, lambda w: F.abs(w["first"] - cut) <= NEAR),
        lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"), seam_key(w["word"]).alias("key")),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def likeness(target: pd.Series, others: pd.Series) -> pd.Series:
    """The matching-blocks ratio of a key with each of a few others."""
    return pd.Series(
        [[difflib.SequenceMatcher(None, t, o).ratio() for o in near] for t, near in zip(target, others)]
    )


def fuzzy_heard(asked: DataFrame) -> DataFrame:
    """asked(..., word, at, spoken) with `heard`: whether another decode's words
    within 1 s hold the word: its key inside theirs joined, one like it, or
    another number. The ratio is computed only where the cheap tests fail and
    some key is long enough."""
    target = seam_key(F.col("word"))
    near = F.transform(
        F.filter("spoken", lambda w: (w["first"] - NEAR <= F.col("at")) & (F.col("at") <= w["last"] + NEAR)),
        lambda w: seam_key(w["word"]),
    )
    keyed = pinned(asked, _t=target, _near=near)
    number = F.col("_t").rlike(NUMBERISH) & F.exists("_near", lambda k: k.rlike(NUMBERISH))
    cheap = (F.col("_t") == "") | (F.instr(F.array_join("_near", ""), F.col("_t")) > 0) | number
    marked = keyed.withColumn("_cheap", cheap).withColumn(
        "_like",
        F.when(
            ~F.col("_cheap") & (F.char_length("_t") >= 4), F.filter("_near", lambda k: F.char_length(k) >= 2)
        ).otherwise(F.array().cast("array<string>")),
    )
    scored = marked.withColumn("_ratio", likeness(F.col("_t"), F.col("_like")))
    return scored.withColumn("heard", F.col("_cheap") | F.exists("_ratio", lambda r: r >= 0.6)).drop(
        "_t", "_near", "_cheap", "_like", "_ratio"
    )


def spoken_at(spoken: Column, at_: Column, before: Column) -> Column:
    """Whether another word than `before` starts where one was heard."""
    return F.exists(
        spoken,
        lambda w: w["first"].between(at_ - SPOKEN_BEFORE, at_ + SPOKEN_AFTER) & (seam_key(w["word"]) != seam_key(before)),
    )


def select_endings(pieces: DataFrame) -> DataFrame:
    """Pieces (file, piece, re, ws, we, starts, levels) whose last words need a
    second look, with `begin`, where the ending to decode again starts. `levels`
    are the piece's own frames, 20 ms each."""
    begin = let(
        F.struct(F.col("starts").alias("x"), F.col("we").alias("we"), F.col("ws").alias("ws")),
        lambda b: let(
            F.size(F.filter(b["x"], lambda s: s < b["we"] - MADE_UP)),
            lambda early: F.greatest(
                b["ws"], b["we"] - 2 * ENDING,
                F.least(b["we"] - ENDING, F.get(b["x"], F.greatest(early - 1, F.lit(0))) - LEAD),
            ),
        ),
    )
    # Every array is pinned: else each mention of it, in filters too, makes it anew.
    timed = pinned(pieces.where(F.col("we") == F.col("re")), starts=F.col("starts")).where(
        (F.size("starts") >= 2) & (F.element_at("starts", -1) >= F.col("we") - MADE_UP)
    )
    asked = pinned(timed, begin=begin)
    frames = F.slice("levels", F.floor((F.col("begin") - F.col("ws")) / FRAME).cast("int") + 1, F.size("levels"))
    rank = (F.size("_l") - 1) * 0.95
    low = F.floor(rank).cast("int")
    # nulls, which sort last, are as good as past the end
    top = let(F.sort_array(F.array_compact("_l")), lambda ordered: (
        F.get(ordered, low) + (F.coalesce(F.get(ordered, low + 1), F.get(ordered, low)) - F.get(ordered, low)) * (rank - low)
    ))
    quiet = F.array_max(F.slice("_l", -PAUSE_FRAMES, PAUSE_FRAMES))
    framed = pinned(asked, _l=frames).where(F.size("_l") >= PAUSE_FRAMES)
    return pinned(framed, top=top).where(quiet <= F.col("top") * 10.0 ** (-PAUSE_DB / 20)).select(*pieces.columns, "begin", "top")


def drop_made_up_endings(asked: DataFrame) -> DataFrame:
    """asked(file, piece, ws, we, begin, tokens, timestamps, again, levels): a
    piece whose ending was decoded `again`, an array of decodes, each an array
    of struct<word, first, last> in samples; `levels` are its frames from
    `begin`, over the speech's own. Returns file, piece, tokens, timestamps,
    dropped: without the words of its last 0.75 s, from the end back to the
    last one that a decode heard or where a decode spoke another word. They stay
    unless every decode heard the word before them and no syllable follows a
    pause after it. The first word always stays, and so does a piece that was
    not decoded again.

    Only the late words of a piece and the one before them leave its row."""
    spanned = pinned(asked, _spans=word_spans(F.col("tokens")))
    located = pinned(
        spanned, _at=let(F.struct(F.col("_spans").alias("s"), F.col("timestamps").alias("t")),
                         lambda b: F.transform(b["s"], lambda w: F.col("ws") + samples(F.get(b["t"], w["first"]))))
    )
    late = F.filter(indices(F.size("_spans")), lambda i: (i > 0) & (F.get("_at", i) >= F.col("we") - MADE_UP))
    # a word on its own counts as late only if all after it are
    early = F.coalesce(F.array_max(F.filter(indices(F.size("_spans")), lambda i: ~F.array_contains("_late", i))), F.lit(0))
    opened = pinned(pinned(located, _late=late), _from=early)
    words = opened.where(F.size("again") > 0).select(
        "file", "piece", "_from", "again", "_spans", "_at", F.explode(F.filter(indices(F.size("_spans")), lambda i: i >= F.col("_from"))).alias("k")
    ).select(
        "file", "piece", "k", F.get("_spans", F.col("k"))["word"].alias("word"), F.get("_at", F.col("k")).alias("at"),
        at(F.col("_spans"), F.col("k") - 1)["word"].alias("_before"), F.explode("again").alias("spoken"),
    )
    told = fuzzy_heard(words).withColumn("spoken", F.coalesce(spoken_at(F.col("spoken"), F.col("at"), F.coalesce("_before", F.lit(""))), F.lit(False)))
    verdicts = told.groupBy("file", "piece", "k").agg(F.bool_or("heard").alias("any"), F.bool_and("heard").alias("all"), F.bool_or("spoken").alias("spoken"))
    # the word that ends what stays: the last with a sign of being said, or the one before all late words
    ends = verdicts.groupBy("file", "piece").agg(
        F.max(F.struct((F.col("any") | F.col("spoken") | (F.col("k") == 0)).cast("int").alias("sign"), "k", "all")).alias("_sign"),
        F.min(F.struct("k", "all")).alias("_first"),
    ).select("file", "piece", F.when(F.col("_sign.sign") == 1, F.struct("_sign.k", "_sign.all")).otherwise(F.struct("_first.k", "_first.all")).alias("_end"))
    judged = opened.join(ends, ["file", "piece"], "left")
    last = F.get("_spans", F.col("_end.k"))["last"]
    frame = F.floor((F.col("ws") + samples(F.get("timestamps", last)) - F.col("begin")) / FRAME).cast("int")
    goes = F.col("_end.all") & (F.col("_end.k") < F.size("_spans") - 1) & ~pause_then_syllable(F.col("levels"), frame)
    keep = F.when(goes, last + 1).otherwise(F.size("tokens"))
    return judged.withColumn("_keep", keep).select(
        "file", "piece", F.slice("tokens", F.lit(1), F.col("_keep")).alias("tokens"), F.slice("timestamps", F.lit(1), F.col("_keep")).alias("timestamps"),
        F.when(goes, F.size("_spans") - 1 - F.col("_end.k")).otherwise(F.lit(0)).alias("dropped"),
    )
