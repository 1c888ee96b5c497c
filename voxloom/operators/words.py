"""From a recogniser's result rows to words, segments and whole transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.arrays import pinned, unroll
from voxloom.functions.text import clean_text, decode_tokens
from voxloom.functions.tokens import repair_timestamps, segment_of, timed_words, word_spans


def extract(results: DataFrame) -> DataFrame:
    """Results with times repaired and text rebuilt from the tokens; a piece
    with text only keeps its own."""
    tokens = F.coalesce(F.col("tokens"), F.array().cast("array<string>"))
    given = F.col("text") if "text" in results.columns else F.lit("")
    return results.withColumn("tokens", tokens).select(
        *[c for c in results.columns if c not in ("text", "tokens", "timestamps")],
        clean_text(F.when(F.size("tokens") > 0, decode_tokens(F.col("tokens"))).otherwise(given)).alias("text"),
        "tokens",
        repair_timestamps(F.col("tokens"), F.col("timestamps")).alias("timestamps"),
    )


def group_tokens_to_words(results: DataFrame) -> DataFrame:
    """(file, piece, w, word, first, last)."""
    return unroll(results, ["file", "piece"], word_spans(F.col("tokens")), "w", "s").select("file", "piece", "w", "s.*")


def piece_words(results: DataFrame) -> DataFrame:
    """Pieces with their timed words and segment, one row each, no shuffle."""
    heard = extract(results)
    once = pinned(heard, text=F.col("text"), tokens=F.col("tokens"), timestamps=F.col("timestamps"), spans=word_spans(F.col("tokens")))
    bounds = (F.col("timestamps"), F.col("chunk_start"), F.col("chunk_end"))
    timed = pinned(once, words=timed_words(F.col("spans"), *bounds), segment=segment_of(F.col("text"), *bounds))
    return timed.select(
        *[c for c in results.columns if c not in ("text", "tokens", "timestamps")], "text", "words", "segment"
    )


def word_bounds(results: DataFrame) -> DataFrame:
    """(file, piece, w, word, start, end)."""
    return unroll(piece_words(results), ["file", "piece"], F.col("words"), "w", "t").select("file", "piece", "w", "t.*")


def segment_bounds(results: DataFrame) -> DataFrame:
    """(file, piece, start, end, text), one row per piece that heard something."""
    return piece_words(results).where(F.col("segment").isNotNull()).select("file", "piece", "segment.*")


def cover(segment: Column, words: Column) -> Column:
    """A segment widened to hold its words after they were re-timed."""
    return F.when(F.size(words) == 0, segment).otherwise(
        F.struct(
            F.least(segment["start"], F.get(words, F.lit(0))["start"]).alias("start"),
            F.greatest(segment["end"], F.get(words, F.size(words) - 1)["end"]).alias("end"),
            segment["text"].alias("text"),
        )
    )


def stitch_transcript(pieces: DataFrame, *, words: str = "words") -> DataFrame:
    """Pieces with `segment` and timed words to one row per file: text, segments
    and words in order. Words are null, not empty, for a file one of whose
    pieces could not be timed (its words null). A file holds as many pieces as
    the length limit lets it (enforce_limits); one row is what is asked for."""
    ordered = F.array_sort(
        F.collect_list(F.struct("piece", "segment", F.col(words).alias("words")))
    )
    gathered = pieces.where(F.col("segment").isNotNull()).groupBy("file").agg(
        ordered.alias("p"), F.bool_or(F.col(words).isNull()).alias("_untimed")
    )
    return gathered.select(
        "file",
        clean_text(F.array_join(F.col("p.segment.text"), " ")).alias("text"),
        F.col("p.segment").alias("segments"),
        F.when(~F.col("_untimed"), F.flatten("p.words")).alias("words"),
    )
