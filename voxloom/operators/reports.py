"""Summaries of runs, catalogues and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.intervals import binned_overlaps
from voxloom.operators.scan import running


def runtime_summary(runs: DataFrame) -> DataFrame:
    """runs(file, run, duration, secs), per file. The speed-up is the mean of
    the ratios, not the ratio of the means."""
    ratio = F.when(F.col("secs") > 0, F.col("duration") / F.col("secs")).otherwise(F.lit(0.0))
    return runs.groupBy("file").agg(
        F.count("*").alias("runs"),
        F.max("duration").alias("duration"),
        F.avg("secs").alias("avg_secs"),
        F.min("secs").alias("min_secs"),
        F.max("secs").alias("max_secs"),
        F.coalesce(F.stddev_samp("secs"), F.lit(0.0)).alias("std_secs"),
        F.avg(F.col("secs") / F.col("duration")).alias("avg_rtf"),
        F.avg(ratio).alias("avg_speedup"),
    )


def overall_summary(per_file: DataFrame) -> DataFrame:
    """Unweighted means over files, total audio, and the time all runs took."""
    return per_file.agg(
        F.count("*").alias("files"),
        F.avg("avg_secs").alias("avg_secs"),
        F.avg("avg_rtf").alias("avg_rtf"),
        F.avg("avg_speedup").alias("avg_speedup"),
        F.sum("duration").alias("total_audio"),
        F.sum(F.col("avg_secs") * F.col("runs")).alias("total_secs"),
    )


def select_bench_files(files: DataFrame, count: int, *, shortest: float = 5.0, longest: float = 300.0) -> DataFrame:
    """Up to `count` files by size, those of a usable length first. A top-k
    sort, so each task keeps `count` rows only."""
    usable = F.col("duration").between(shortest, longest)
    return (
        files.withColumn("usable", F.coalesce(usable, F.lit(False)))
        .orderBy(F.col("usable").desc(), F.col("size"), F.col("file"))
        .limit(count)
        .orderBy("duration", "file")
    )


def stage_timings(jobs: DataFrame, *, accuracy: int = 10000) -> DataFrame:
    """jobs(model, duration, chunks, decode_ms, infer_ms, total_ms) by model."""
    stages = ("decode_ms", "infer_ms", "total_ms")
    return jobs.groupBy("model").agg(
        F.count("*").alias("jobs"), F.sum("chunks").alias("chunks"), F.sum("duration").alias("audio"),
        *[F.avg(stage).alias(f"avg_{stage}") for stage in stages],
        *[F.max(stage).alias(f"max_{stage}") for stage in stages],
    )


def catalogue_cards(variants: DataFrame) -> DataFrame:
    """variants(name, author, language, quantization) to one row per name, its
    languages and quantizations as sorted lists."""
    return variants.groupBy("name").agg(
        F.min("author").alias("author"),
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.array_sort(F.collect_set("quantization")).alias("quantizations"),
    )


def forced_cut_report(pieces: DataFrame, speech: DataFrame, words: DataFrame, *, deep: int, bin_size: int) -> DataFrame:
    """Per file: pieces, cuts strictly inside speech, those inside a word, and
    those more than `deep` inside one. pieces(file, rs, re), speech and
    words(file, s, e). A cut is where one piece ends and another starts, found
    by equality; what holds it, by binned joins."""
    ends = pieces.select("file", F.col("re").alias("s"))
    cuts = ends.join(pieces.select("file", F.col("rs").alias("s")), ["file", "s"], "left_semi").withColumn("e", F.col("s") + 1)
    inside = (
        binned_overlaps(cuts, speech, ["file"], bin_size=bin_size).where(F.col("r_s") < F.col("s")).select("file", "s", "e").distinct()
    )
    depth = F.least(F.col("s") - F.col("r_s"), F.col("r_e") - F.col("s"))
    in_word = (
        binned_overlaps(inside, words, ["file"], bin_size=bin_size).where(F.col("r_s") < F.col("s"))
        .groupBy("file", "s").agg(F.max(depth).alias("depth"))
    )
    held = inside.groupBy("file").agg(F.count("*").alias("in_speech"))
    cut = in_word.groupBy("file").agg(F.count("*").alias("in_word"), F.count_if(F.col("depth") > deep).alias("deep"))
    total = pieces.groupBy("file").agg(F.count("*").alias("pieces"))
    return total.join(held, "file", "left").join(cut, "file", "left").na.fill(0)


def compare_plans(a: DataFrame, b: DataFrame, words: DataFrame, *, deep: int, within: int, block: int = 960_000) -> DataFrame:
    """Per file, the cuts of two plans a and b(file, rs, re) against disjoint
    words(file, s, e): how many each has, has inside a word, and has more than
    `deep` inside one; how many of a's have a cut of b at most `within` away
    (the nearest, the earlier of two), how many of those were moved, and how many
    then lie less deep in a word, or deeper. One scan of the line finds the word
    that holds a cut and the other plan's cuts beside it, so no pairs are formed."""

    def cuts(plan: DataFrame, kind: int) -> DataFrame:
        meets = plan.select("file", F.col("rs").alias("x"))
        return plan.select("file", F.col("re").alias("x")).distinct().join(meets, ["file", "x"], "left_semi").withColumn("_k", F.lit(kind)).withColumn("_w", F.lit(None).cast("struct<s:bigint,e:bigint>"))

    held = words.where("e > s").select("file", F.col("s").alias("x"), F.lit(2).alias("_k"), F.struct(F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e")).alias("_w"))
    line = cuts(a, 0).unionByName(cuts(b, 1)).unionByName(held)
    other = F.when(F.col("_k") == 1, F.col("x"))
    seen = running(
        line, ["file"], ["x", "_k"], F.floor(F.col("x") / block), before={"_word": ("last", F.col("_w")), "_prior": ("last", other)}, after={"_next": ("first", other)}
    ).where("_k < 2")
    depth = F.coalesce(F.when(F.col("_word.e") > F.col("x"), F.least(F.col("x") - F.col("_word.s"), F.col("_word.e") - F.col("x"))), F.lit(0))
    near = F.when(F.coalesce(F.col("x") - F.col("_prior") <= F.col("_next") - F.col("x"), F.col("_next").isNull()), F.col("_prior")).otherwise(F.col("_next"))
    told = seen.select("file", "x", "_k", depth.alias("depth"), F.when((F.col("_k") == 0) & (F.abs(near - F.col("x")) <= within), near).alias("_to"))
    theirs = told.where("_k = 1").select("file", F.col("x").alias("_to"), F.col("depth").alias("_depth"))
    both = told.join(theirs, ["file", "_to"], "left")
    mine, yours, paired = F.col("_k") == 0, F.col("_k") == 1, F.col("_to").isNotNull()
    counts = {
        "cuts_a": mine, "cuts_b": yours, "in_word_a": mine & (F.col("depth") > 0), "in_word_b": yours & (F.col("depth") > 0),
        "deep_a": mine & (F.col("depth") > deep), "deep_b": yours & (F.col("depth") > deep), "aligned": paired, "moved": paired & (F.col("_to") != F.col("x")),
        "better": paired & (F.col("_depth") < F.col("depth")), "worse": paired & (F.col("_depth") > F.col("depth")),
    }
    return both.groupBy("file").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
