"""Documents to write: plain text, subtitle cues and JSON, one row per file.

Every sink returns a frame with `file` and `value`; write it with
`df.select("value").write.text(...)` or partition it by file first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import clean_text, srt_time, strip


def _in_order(segments: DataFrame, *columns: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct("piece", *columns)))


def text_documents(segments: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(_in_order(segments, F.col("text")), lambda s: s["text"]), " ")
    return segments.groupBy("file").agg(clean_text(joined).alias("value"))


def _cues(segments: DataFrame) -> DataFrame:
    return segments.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")


def srt_documents(segments: DataFrame) -> DataFrame:
    """SubRip: numbered cues, a blank line after each."""
    spoken = F.struct(
        srt_time(F.col("start")).alias("a"), srt_time(F.col("end")).alias("b"), F.col("text").alias("t")
    )
    cues = _cues(segments).groupBy("file").agg(_in_order(segments, spoken.alias("c")).alias("cues"))
    lines = F.transform(
        F.col("cues"),
        lambda s, i: F.concat(
            (i + 1).cast("string"), F.lit("\n"), s["c"]["a"], F.lit(" --> "), s["c"]["b"], F.lit("\n"), s["c"]["t"], F.lit("\n")
        ),
    )
    return cues.select("file", F.array_join(lines, "\n").alias("value"))


def vtt_documents(segments: DataFrame) -> DataFrame:
    """WebVTT: a header, unnumbered cues, points in the times."""
    spoken = F.struct(
        F.replace(srt_time(F.col("start")), F.lit(","), F.lit(".")).alias("a"),
        F.replace(srt_time(F.col("end")), F.lit(","), F.lit(".")).alias("b"),
        F.col("text").alias("t"),
    )
    cues = _cues(segments).groupBy("file").agg(_in_order(segments, spoken.alias("c")).alias("cues"))
    lines = F.transform(
        F.col("cues"),
        lambda s: F.concat(s["c"]["a"], F.lit(" --> "), s["c"]["b"], F.lit("\n"), s["c"]["t"], F.lit("\n")),
    )
    return cues.select("file", F.concat(F.lit("WEBVTT\n\n"), F.array_join(lines, "\n")).alias("value"))


def verbose_json_documents(transcripts: DataFrame, *, with_words: bool) -> DataFrame:
    """transcripts(file, language, duration, text, segments, words) as JSON;
    words are null unless asked for."""
    segments = F.transform(
        F.col("segments"),
        lambda s, i: F.struct(
            i.alias("id"),
            F.lit(0).alias("seek"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["text"].alias("text"),
            F.array().cast("array<int>").alias("tokens"),
            F.lit(0.0).alias("temperature"),
            F.lit(0.0).alias("avg_logprob"),
            F.lit(0.0).alias("compression_ratio"),
            F.lit(0.0).alias("no_speech_prob"),
        ),
    )
    words = F.transform(
        F.col("words"), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("word"))
    )
    document = F.struct(
        F.lit("transcribe").alias("task"),
        "language",
        "duration",
        "text",
        segments.alias("segments"),
        (words if with_words else F.lit(None).cast("array<struct<start:double,end:double,word:string>>")).alias("words"),
    )
    return transcripts.select("file", F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def alignment_documents(aligned: DataFrame) -> DataFrame:
    """aligned(file, aligner, language, duration, words array<struct<word,
    start, end, score>>) as JSON, times held within the audio, nulls kept."""
    words = F.transform(
        F.col("words"),
        lambda w: F.struct(
            w["word"].alias("word"),
            F.when(w["start"].isNotNull(), F.least(F.col("duration"), w["start"])).alias("start"),
            F.when(w["end"].isNotNull(), F.least(F.col("duration"), w["end"])).alias("end"),
            w["score"].alias("score"),
        ),
    )
    document = F.struct("aligner", "language", "duration", words.alias("words"))
    return aligned.select("file", F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def batch_documents(batches: DataFrame) -> DataFrame:
    """batches(batch, ord, filename, text, duration) as one JSON each, in the
    order the files came. A batch holds at most what enforce_limits lets in."""
    item = F.struct("ord", F.struct("filename", "text", "duration").alias("d"))
    grouped = batches.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("i"), F.count("*").alias("n"))
    document = F.struct(F.col("n").alias("batch_size"), F.col("i.d").alias("results"))
    return grouped.select("batch", F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))
