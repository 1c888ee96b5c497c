"""Detected speech packed into bounded ranges, and the wider windows to decode.

Packing is sequential, but it starts afresh after every long silence, so the
unit of work is a stretch of speech between two of them, not a file. Finding
the stretches is a running scan; packing one is a fold over its spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.arrays import at, indices, let
from voxloom.operators.intervals import whole
from voxloom.operators.scan import running
from voxloom.session import cut_lineage

# Fixed values at 16 kHz.
RATE = 16_000
TRIM = 3 * RATE
SLIVER = 2 * RATE
STEP = 1280
NUDGE = 160

SPAN = "struct<s:bigint,e:bigint>"


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))


def room(length: Column, maximum: Column) -> Column:
    return whole(length + maximum - 1, maximum) * maximum


def stretches(speech: DataFrame, sizes: DataFrame, *, trim: int = TRIM, block: int = 60 * RATE * 60) -> DataFrame:
    """speech(file, s, e) disjoint, sizes(file, total) to one row per stretch:
    (file, stretch, spans, head, tail, next_start, total). `head` and `tail` mark
    the file's first and last."""
    line = F.floor(F.col("s") / block)
    seen = running(speech.select("file", "s", "e"), ["file"], ["s", "e"], line, before={"_end": ("last", F.col("e"))})
    opens = F.col("_end").isNull() | (F.col("s") - F.col("_end") >= trim)
    marked = running(
        seen.withColumn("_o", opens), ["file"], ["s", "e"], line,
        before={"_own": ("last", F.when(F.col("_o"), F.col("s")))},
        after={"_next": ("first", F.when(F.col("_o"), F.col("s")))},
    )
    grouped = marked.groupBy("file", F.when(F.col("_o"), F.col("s")).otherwise(F.col("_own")).alias("stretch")).agg(
        F.array_sort(F.collect_list(span(F.col("s"), F.col("e")))).alias("spans"),
        F.bool_or(F.col("_end").isNull()).alias("head"),
        F.max("_next").alias("next_start"),
    )
    return grouped.join(sizes.select("file", "total"), "file").withColumn("tail", F.col("next_start").isNull())


def packed_ranges(spans: Column, head: Column, tail: Column, total: Column, *, target: int, own: int, least: int, trim: int) -> Column:
    """array<struct<s, e>>: a stretch's spans in ranges up to `target`, closed at
    a pause once `least` long, or sooner where going on would force a cut inside
    speech."""
    big = lambda v: F.lit(v).cast("long")
    held = lambda n: room(n, big(own))

    def pack(b: Column) -> Column:
        first = F.get(b["v"], F.lit(0))["s"]
        lead = F.when(b["head"], F.greatest(big(0), first - trim)).otherwise(first)
        led = lambda acc: F.when(
            b["head"] & (F.size(acc["out"]) == 0), F.greatest(lead, acc["ce"] - held(acc["ce"] - first))
        ).otherwise(acc["cs"])
        state = lambda out, cs, ce: F.struct(out.alias("out"), cs.cast("long").alias("cs"), ce.cast("long").alias("ce"))
        start = state(F.array().cast(f"array<{SPAN}>"), lead, F.get(b["v"], F.lit(0))["e"])

        def take(acc: Column, nxt: Column) -> Column:
            def decide(x: Column) -> Column:
                s, e, cs, ce = x["s"], x["e"], x["cs"], x["ce"]
                cut = F.least(
                    F.greatest(whole(ce + s, big(2)), F.least(e - own, s)), cs + held(ce - cs)
                )

                def close(y: Column) -> Column:
                    after = e - y["cut"]
                    whole_ = e - F.when(b["head"] & (F.size(acc["out"]) == 0), first).otherwise(cs)
                    spare = (
                        (held(y["cut"] - cs) + held(after) <= held(whole_))
                        & (held(after) - after >= F.least(big(trim), held(whole_) - whole_))
                        & (held(e - s) == held(after))
                        & (y["cut"] - cs >= SLIVER)
                    )
                    closes = (ce - cs >= least) | ((e - cs > own) & (after <= own)) | spare
                    grown = F.when(y["cut"] > cs, F.array_append(acc["out"], span(cs, y["cut"]))).otherwise(acc["out"])
                    return F.when(closes, state(grown, y["cut"], e)).otherwise(state(acc["out"], cs, e))

                return F.when(e - cs <= target, state(acc["out"], cs, e)).otherwise(let(F.struct(cut.alias("cut")), close))

            return let(
                F.struct(nxt["s"].alias("s"), nxt["e"].alias("e"), led(acc).cast("long").alias("cs"), acc["ce"].alias("ce")), decide
            )

        def finish(acc: Column) -> Column:
            def last(x: Column) -> Column:
                end = F.when(
                    b["tail"], F.least(b["total"], acc["ce"] + trim, x["cs"] + held(acc["ce"] - x["cs"]))
                ).otherwise(acc["ce"])
                return let(
                    F.struct(end.alias("e")),
                    lambda y: F.when(y["e"] > x["cs"], F.array_append(acc["out"], span(x["cs"], y["e"]))).otherwise(acc["out"]),
                )

            return let(F.struct(led(acc).cast("long").alias("cs")), last)

        rest = F.slice(b["v"], 2, F.greatest(F.size(b["v"]) - 1, F.lit(0)))
        return F.aggregate(rest, start, take, finish)

    bound = F.struct(spans.alias("v"), head.alias("head"), tail.alias("tail"), total.cast("long").alias("total"))
    return let(bound, pack)


def split_long(ranges: Column, own: int) -> Column:
    """Ranges over `own` cut into the fewest near-equal parts."""

    def parts(r: Column) -> Column:
        n = whole(r["e"] - r["s"] + own - 1, F.lit(own).cast("long"))
        edge = lambda k: r["s"] + whole((r["e"] - r["s"]) * k, n)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: span(edge(k), edge(k + 1)))

    return F.flatten(F.transform(ranges, parts))


def context_windows(ranges: Column, spans: Column, *, context: int, maximum: int) -> Column:
    """array<struct<s, e>>, one window per range of a stretch: at an edge that
    meets another range, the nearest pause middle `context` away or more, else
    the farthest that fits, else exactly `context`."""

    def windows(b: Column) -> Column:
        r, v = b["r"], b["v"]
        pauses = F.transform(
            indices(F.size(v) - 1),
            lambda k: F.struct(
                F.get(v, k)["e"].alias("before"), F.get(v, k + 1)["s"].alias("after"),
                whole(F.get(v, k)["e"] + F.get(v, k + 1)["s"], F.lit(2).cast("long")).alias("mid"),
            ),
        )
        none = F.array().cast("array<bigint>")

        def one(p: Column, k: Column) -> Column:
            own, prior, nxt = F.get(r, k), at(r, k - 1), at(r, k + 1)
            free = maximum - (own["e"] - own["s"])
            low = F.greatest(prior["s"], own["s"] - F.when(nxt.isNotNull(), whole(free, F.lit(2).cast("long"))).otherwise(free))

            def left(x: Column) -> Column:
                inside = F.reverse(F.transform(
                    F.filter(p, lambda q: (q["after"] < own["s"]) & (q["mid"] >= x["low"])), lambda q: q["mid"]
                ))
                edge = F.when((k == 1) & (prior["s"] >= x["low"]), F.array(prior["s"])).otherwise(none)
                return let(F.concat(inside, edge), lambda c: F.coalesce(
                    at(F.filter(c, lambda a: a <= own["s"] - context), F.lit(0)), at(c, F.size(c) - 1),
                    F.greatest(x["low"], own["s"] - context),
                ))

            start = F.when(prior.isNotNull(), let(F.struct(low.alias("low")), left)).otherwise(own["s"])

            def right(y: Column) -> Column:
                high = F.least(nxt["e"], y["s"] + maximum)

                def reach(z: Column) -> Column:
                    inside = F.transform(F.filter(p, lambda q: (q["before"] > own["e"]) & (q["mid"] <= z["high"])), lambda q: q["mid"])
                    edge = F.when((k + 2 == F.size(r)) & (nxt["e"] <= z["high"]), F.array(nxt["e"])).otherwise(none)
                    return let(F.concat(inside, edge), lambda c: F.coalesce(
                        at(F.filter(c, lambda a: a >= own["e"] + context), F.lit(0)), at(c, F.size(c) - 1),
                        F.least(z["high"], own["e"] + context),
                    ))

                end = F.when(nxt.isNotNull(), let(F.struct(high.alias("high")), reach)).otherwise(own["e"])
                return span(y["s"], end)

            return let(F.struct(start.cast("long").alias("s")), right)

        return let(pauses, lambda p: F.transform(indices(F.size(r)), lambda k: one(p, k)))

    if context <= 0:
        return ranges
    return let(F.struct(ranges.alias("r"), spans.alias("v")), windows)


def off_step(pieces: Column, next_start: Column, *, step: int = STEP, own: int, maximum: int) -> Column:
    """array<struct<rs, re, ws, we>> of a stretch: its last range, where it ends
    at a long silence and is a whole number of steps long, or a window ending
    with it is, reaches 10 to 30 ms further where the bounds allow."""

    def moved(b: Column) -> Column:
        last = F.element_at(b["p"], -1)
        ending = F.filter(b["p"], lambda w: w["we"] == last["re"])
        starts = F.concat(F.array(last["rs"]), F.transform(ending, lambda w: w["ws"]))
        on_step = lambda x: F.exists(starts, lambda s: (x - s) % step == 0)
        choice = F.filter(
            F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: last["re"] + k * NUDGE),
            lambda x: ~on_step(x) & (x < b["next"]) & (x - last["rs"] <= own)
            & ~F.exists(ending, lambda w: x - w["ws"] > maximum),
        )
        end = F.when(b["next"].isNotNull() & on_step(last["re"]), F.coalesce(at(choice, F.lit(0)), last["re"])).otherwise(last["re"])
        return let(F.struct(end.alias("e")), lambda y: F.transform(b["p"], lambda w, i: F.struct(
            w["rs"].alias("rs"),
            F.when(i == F.size(b["p"]) - 1, y["e"]).otherwise(w["re"]).alias("re"),
            w["ws"].alias("ws"),
            F.when(w["we"] == last["re"], y["e"]).otherwise(w["we"]).alias("we"),
        )))

    return F.when(F.size(pieces) > 0, let(F.struct(pieces.alias("p"), next_start.alias("next")), moved)).otherwise(pieces)


def plan_chunks(
    speech: DataFrame, sizes: DataFrame, *, target: int, maximum: int, least: int, context: int = 0, step: int = 0, trim: int = TRIM,
    split: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """(file, rs, re, ws, we): bounded ranges and the windows to decode for
    them. A file no longer than `maximum` is one range whatever was heard; a
    longer one without speech has none. Lengths are samples. Ranges over what a
    window has room for are split evenly, or by `split`(ranges, speech, sizes,
    limit), which gets ranges(file, stretch, s, e) and returns the like, as
    `split_all` does."""
    own = max(1, maximum - 2 * context)
    goal = min(target, own)
    floor = min(goal, max(0, least))
    short = sizes.where((F.col("total") > 0) & (F.col("total") <= maximum)).select(
        "file", F.lit(0).cast("long").alias("rs"), F.col("total").alias("re"), F.lit(0).cast("long").alias("ws"), F.col("total").alias("we")
    )
    long = sizes.where(F.col("total") > maximum)
    found = stretches(speech.join(long.select("file"), "file", "left_semi"), long, trim=trim)
    packed = packed_ranges(F.col("spans"), F.col("head"), F.col("tail"), F.col("total"), target=goal, own=own, least=floor, trim=trim)
    if split is None:
        ranged = found.withColumn("ranges", split_long(packed, own))
    else:
        known = cut_lineage(found.withColumn("packed", packed))
        cut = split(known.select("file", "stretch", F.explode("packed").alias("p")).select("file", "stretch", "p.s", "p.e"), speech, long, own)
        ranges = cut.groupBy("file", "stretch").agg(F.array_sort(F.collect_list(span(F.col("s"), F.col("e")))).alias("ranges"))
        ranged = known.drop("packed").join(ranges, ["file", "stretch"])
    windowed = ranged.withColumn("windows", context_windows(F.col("ranges"), F.col("spans"), context=context, maximum=maximum))
    pieces = F.transform(
        F.arrays_zip("ranges", "windows"),
        lambda p: F.struct(p["ranges"]["s"].alias("rs"), p["ranges"]["e"].alias("re"), p["windows"]["s"].alias("ws"), p["windows"]["e"].alias("we")),
    )
    stepped = off_step(F.col("pieces"), F.col("next_start"), step=step, own=own, maximum=maximum) if step else F.col("pieces")
    out = windowed.withColumn("pieces", pieces).select("file", F.explode_outer(stepped).alias("p"))
    return out.where(F.col("p").isNotNull()).select("file", "p.*").unionByName(short)
