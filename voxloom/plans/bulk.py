"""The whole job over a corpus of files: planned, cut, decoded, decoded again
where speech was skipped, stitched and written, a wave of files at a time.

Waves bound what a lost job has to do again. A wave's transcripts are written
first and its manifest rows after them, one row per file and attempt; a wave
without manifest rows never happened, whatever it left behind. A run takes up
the files that no manifest row calls done, so it can be started again at will.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.tokens import repair_timestamps
from voxloom.operators import reconcile as rc
from voxloom.operators.batching import score_with_model
from voxloom.operators.intervals import clip_intervals
from voxloom.operators.planning import plan_chunks
from voxloom.operators.redo import protect_seam_words
from voxloom.operators.seams import trim_overlaps
from voxloom.operators.signal import slice_pieces
from voxloom.operators.words import piece_words, stitch_transcript
from voxloom.session import cut_lineage

RATE = 16_000
STRETCHES = "array<struct<s:bigint,e:bigint>>"
MANIFEST = "wave string, attempt int, state string, error string"


@dataclass(frozen=True)
class Bounds:
    """Lengths in samples: of a range, a window, the shortest range to close and the context."""

    target: int
    maximum: int
    least: int
    context: int = 0
    step: int = 0


@dataclass(frozen=True)
class Signal:
    """blocks(file, block, x): `hop` samples to an element of x, `block` elements to a row."""

    blocks: DataFrame
    block: int
    hop: int = 1

    def first(self, sample: Column) -> Column:
        return F.floor(sample / self.hop)

    def aligned(self, windows: DataFrame) -> DataFrame:
        """Windows opened to whole elements."""
        return windows.withColumn("ws", self.first(F.col("ws")) * self.hop).withColumn("we", F.ceil(F.col("we") / self.hop) * self.hop)

    def decode(self, windows: DataFrame, load: Callable) -> DataFrame:
        """windows(file, id, ws, we) of whole elements through the model: file,
        id, tokens, timestamps, error, each decoded once and written."""
        asked = windows.select("file", F.col("id").alias("piece"), self.first(F.col("ws")).alias("ws"), self.first(F.col("we")).alias("we"))
        cut = slice_pieces(self.blocks.join(asked.select("file").distinct(), "file", "left_semi"), asked, block=self.block)
        kind = self.blocks.schema["file"].dataType.simpleString()
        heard = score_with_model(
            cut.withColumnRenamed("piece", "id"), load, payload="x", keys=f"file {kind}, id bigint", schema="tokens array<string>, timestamps array<double>"
        )
        return cut_lineage(heard.withColumn("timestamps", repair_timestamps(F.col("tokens"), F.col("timestamps"))))


def _skipped(pieces: DataFrame, speech: DataFrame) -> DataFrame:
    """Pieces with `stretches`, the speech in their ranges that they have no word for."""
    found = rc.stalled_stretches(rc.untimed_stretches(pieces), speech)
    stretches = found.groupBy("file", "piece").agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e")))).alias("stretches"))
    return pieces.join(stretches, ["file", "piece"])


def _whole_ranges_again(pieces: DataFrame, speech: DataFrame, signal: Signal, load: Callable) -> DataFrame:
    """A piece that decoded context and skipped speech, decoded as its range
    alone where that hears what it skipped and loses nothing."""
    skipped = cut_lineage(_skipped(pieces, speech))
    own = signal.aligned(skipped.select("file", F.col("piece").alias("id"), F.col("rs").alias("ws"), F.col("re").alias("we")))
    context = skipped.join(own.select("file", F.col("id").alias("piece"), F.col("ws").alias("_ws"), F.col("we").alias("_we")), ["file", "piece"]).where("ws <> _ws OR we <> _we")
    asked = context.select("file", F.col("piece").cast("bigint").alias("id"), F.col("_ws").alias("ws"), F.col("_we").alias("we"))
    again = signal.decode(asked, load).where("error IS NULL")
    second = again.join(asked, ["file", "id"]).select("file", F.col("id").cast("int").alias("piece"), "ws", "we", "tokens", "timestamps")
    judged = rc.accept_redo(
        context.withColumn("starts", rc.word_starts(context)).select("file", "piece", "rs", "re", "starts", "stretches"),
        second.withColumn("starts", rc.word_starts(second)).select("file", "piece", "starts"),
    ).where("accepted")
    taken = second.join(judged.select("file", "piece"), ["file", "piece"], "left_semi").select("file", "piece", *[F.col(c).alias(f"_{c}") for c in ("ws", "we", "tokens", "timestamps")])
    joined = pieces.join(taken, ["file", "piece"], "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("ws", "we", "tokens", "timestamps") else F.col(c) for c in pieces.columns])


def _stretches_again(pieces: DataFrame, speech: DataFrame, signal: Signal, load: Callable) -> DataFrame:
    """What is still skipped, decoded on its own, and the words heard there put
    in; a piece that heard nothing is decoded in parts, cut at pauses."""
    skipped = cut_lineage(_skipped(pieces, speech))
    nothing = (F.size("stretches") == 1) & (F.get("stretches", F.lit(0))["s"] == F.col("ws")) & (F.get("stretches", F.lit(0))["e"] == F.col("we"))
    heard_none = skipped.where(nothing)
    inside = clip_intervals(speech, heard_none.select("file", F.col("piece").alias("id"), F.col("ws").alias("s"), F.col("we").alias("e")), ["file"], bin_size=60 * RATE)
    spans = inside.groupBy("file", F.col("id").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_v"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("_v") - 1), lambda k: F.floor((F.get("_v", k - 1)["e"] + F.get("_v", k)["s"]) / 2))
    parts = heard_none.join(spans, ["file", "piece"]).withColumn("_p", F.when(F.size("_v") > 1, gaps).otherwise(F.array().cast("array<bigint>"))).select(
        "file", "piece", F.lit(True).alias("parts"), "stretches", F.posexplode(rc.parts_of(F.col("ws"), F.col("we"), F.col("_p"))).alias("k", "g")
    )
    windows = skipped.where(~nothing).select(
        "file", "piece", F.lit(False).alias("parts"), "stretches", F.posexplode(rc.redo_windows(F.col("ws"), F.col("we"), F.col("stretches"))).alias("k", "g")
    )
    asked = signal.aligned(windows.unionByName(parts).select("file", "piece", "k", "parts", "stretches", F.col("g.s").alias("ws"), F.col("g.e").alias("we")))
    numbered = cut_lineage(asked.withColumn("id", F.shiftleft(F.col("piece").cast("bigint"), 20) + F.col("k")))
    again = signal.decode(numbered.select("file", "id", "ws", "we"), load).where("error IS NULL")
    own = F.when(F.col("parts"), F.col("stretches")).otherwise(F.filter("stretches", lambda g: (g["s"] >= F.col("ws")) & (g["e"] <= F.col("we"))))
    redos = numbered.join(again, ["file", "id"]).select(
        "file", "piece", "k", F.col("ws").alias("start"), F.col("we").alias("stop"), own.cast(STRETCHES).alias("stretches"),
        F.col("tokens").alias("again_tokens"), F.col("timestamps").alias("again_times"), "parts",
    )
    return protect_seam_words(pieces, cut_lineage(redos)).drop("new", "round")


def transcribe(sizes: DataFrame, speech: DataFrame, signal: Signal, load: Callable, bounds: Bounds) -> DataFrame:
    """(file, text, segments, words, pieces, error) of sizes(file, total), one
    row each, with speech(file, s, e) disjoint. A file without speech has an
    empty text. One with a piece that the model failed on has that error, no
    transcript and its number of pieces; a failed second decode changes nothing."""
    plan = plan_chunks(speech, sizes, target=bounds.target, maximum=bounds.maximum, least=bounds.least, context=bounds.context, step=bounds.step)
    # a file has as many pieces as its length limit lets it
    numbered = plan.withColumn("piece", F.row_number().over(Window.partitionBy("file").orderBy("rs")) - 1)
    pieces = cut_lineage(signal.aligned(numbered))
    heard = signal.decode(pieces.select("file", F.col("piece").cast("bigint").alias("id"), "ws", "we"), load)
    joined = pieces.join(heard.withColumn("piece", F.col("id").cast("int")).drop("id"), ["file", "piece"], "left")
    failed = joined.groupBy("file").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("piece", "error")))["error"].alias("error"), F.count(F.lit(1)).cast("int").alias("pieces"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    first = joined.drop("error").withColumn("tokens", F.coalesce("tokens", none("string"))).withColumn("timestamps", F.coalesce("timestamps", none("double")))
    second = cut_lineage(_whole_ranges_again(cut_lineage(first), speech, signal, load))
    third = _stretches_again(second, speech, signal, load)
    trimmed = trim_overlaps(third).withColumn("chunk_start", F.col("rs") / float(RATE)).withColumn("chunk_end", F.col("re") / float(RATE))
    stitched = stitch_transcript(piece_words(trimmed))
    whole = sizes.select("file").join(failed, "file", "left").join(stitched, "file", "left")
    good = F.col("error").isNull()
    return whole.select(
        "file", F.when(good, F.coalesce("text", F.lit(""))).alias("text"), F.when(good, F.col("segments")).alias("segments"), F.when(good, F.col("words")).alias("words"),
        F.coalesce("pieces", F.lit(0)).alias("pieces"), "error",
    )


class Manifest:
    """The append-only account of a job in `folder`: which wave holds which file's transcript."""

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind
        spark.createDataFrame([], f"file {kind}, {MANIFEST}").write.mode("append").parquet(f"{self.folder}/manifest")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"file {self.kind}, {MANIFEST}").parquet(f"{self.folder}/manifest")

    def todo(self, sizes: DataFrame, attempts: int) -> DataFrame:
        """Files that are not done and were not tried so often, with `attempt`, the next one's number."""
        known = self.rows().groupBy("file").agg(F.bool_or(F.col("state") == "done").alias("_done"), F.max("attempt").alias("_last"))
        joined = sizes.join(known, "file", "left").withColumn("attempt", F.coalesce("_last", F.lit(0)) + 1)
        return joined.where(~F.coalesce("_done", F.lit(False)) & (F.col("attempt") <= attempts)).drop("_done", "_last")

    def commit(self, transcripts: DataFrame, attempts: DataFrame, before_commit: Callable[[str], None]) -> None:
        """Transcripts first, then a manifest row for each of their files."""
        wave = uuid.uuid4().hex
        place = f"{self.folder}/transcripts/wave={wave}"
        transcripts.write.parquet(place)
        before_commit(wave)
        back = self.spark.read.schema(transcripts.schema).parquet(place)
        state = F.when(F.col("error").isNull(), "done").otherwise("failed")
        rows = back.select("file", "error").join(attempts, "file").select("file", F.lit(wave).alias("wave"), F.col("attempt").cast("int").alias("attempt"), state.alias("state"), "error")
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def transcripts(self, schema) -> DataFrame:
        """The committed transcript of each file that is done."""
        done = self.rows().where("state = 'done'").select("file", "wave")
        if done.isEmpty():
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.option("basePath", f"{self.folder}/transcripts").parquet(f"{self.folder}/transcripts")
        return stored.withColumn("wave", F.col("wave").cast("string")).join(done, ["file", "wave"], "left_semi").select(*schema.names)


def bulk_transcribe(
    sizes: DataFrame, speech: DataFrame, signal: Signal, load: Callable, bounds: Bounds, folder: str, *,
    wave_samples: int = 10_000 * 3600 * RATE, attempts: int = 2, before_commit: Callable[[str], None] = lambda wave: None,
) -> DataFrame:
    """(file, text, segments, words, pieces) of every file that could be
    transcribed, from `folder`, where `manifest` says what came of the others.

    Files are dealt by hash into waves of about `wave_samples` of audio. A file
    whose model call failed is tried `attempts` times in all, over all runs.
    Each of sizes(file, total) is one file; a null name is not one."""
    spark = sizes.sparkSession
    named = sizes.where(F.col("file").isNotNull()).groupBy("file").agg(F.max("total").alias("total"))
    manifest = Manifest(spark, folder, sizes.schema["file"].dataType.simpleString())
    while True:
        todo = cut_lineage(manifest.todo(named, attempts))
        left = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first()
        if not left[0]:
            break
        waves = max(1, -(-left[1] // wave_samples))
        for wave in range(waves):
            part = cut_lineage(todo.where(F.pmod(F.xxhash64("file"), F.lit(waves)) == wave))
            if part.isEmpty():
                continue
            own = speech.join(part.select("file"), "file", "left_semi")
            out = transcribe(part.select("file", "total"), own, signal, load, bounds)
            manifest.commit(out, part.select("file", "attempt"), before_commit)
    schema = spark.createDataFrame([], f"file {manifest.kind}, text string, segments array<struct<start:double,end:double,text:string>>, words array<struct<word:string,start:double,end:double>>, pieces int").schema
    return manifest.transcripts(schema)
