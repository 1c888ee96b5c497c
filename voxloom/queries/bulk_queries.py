"""The whole job over the conversation turns, with a recogniser that skips words."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxloom.plans import bulk, views
from voxloom.queries.base import Query, with_views
from voxloom.session import shared_folder

WORD = 12_800
RUN, PAUSE = 25, 5
BOUNDS = bulk.Bounds(target=20 * WORD, maximum=30 * WORD, least=10 * WORD, context=5 * WORD)


def load():
    """A recogniser of words: one element of a signal is a word, or silence. It
    skips the fourth to the eleventh of an input longer than 22."""

    def recognise(inputs):
        out = []
        for x in inputs:
            kept = [(k, w) for k, w in enumerate(x) if w and not (len(x) > 22 and 3 <= k <= 10)]
            out.append({"tokens": ["▁" + w for _, w in kept], "timestamps": [k * 0.8 for k, _ in kept]})
        return out

    return recognise


def corpus(spark, sf_dir):
    """sizes, speech and signal: a turn is a file, a word 0.8 s, and every 25 words are followed by 4 s of silence."""
    turns = views.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("file"), views.split_words(F.col("text")).alias("w"))
    files = turns.withColumn("n", F.size("w").cast("bigint"))
    length = F.col("n") + PAUSE * F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / RUN)
    sizes = files.select("file", (length * WORD).alias("total"))
    runs = files.where("n > 0").select("file", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))).alias("k"))
    start = F.col("k") * (RUN + PAUSE)
    speech = runs.select("file", (start * WORD).alias("s"), ((start + F.least(F.lit(RUN), F.col("n") - F.col("k") * RUN)) * WORD).alias("e"))
    silence = F.array_repeat(F.lit(""), PAUSE)
    elements = F.flatten(F.transform(
        F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN).cast("int")),
        lambda k: F.concat(F.when(k > 0, silence).otherwise(F.array().cast("array<string>")), F.slice("w", k * RUN + 1, F.lit(RUN))),
    ))
    blocks = files.where("n > 0").withColumn("x", elements).select(
        "file", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 64).cast("int")), lambda b: F.struct(b.cast("bigint").alias("block"), F.slice("x", b * 64 + 1, F.lit(64)).alias("x")))).alias("b")
    ).select("file", "b.block", "b.x")
    return sizes, speech, bulk.Signal(blocks, 64, WORD)


def _bulk(spark, sf_dir):
    sizes, speech, signal = corpus(spark, sf_dir)
    folder = f"{shared_folder(spark)}/bulk-{uuid.uuid4().hex}"
    out = bulk.bulk_transcribe(sizes, speech, signal, load, BOUNDS, folder)
    return out.select("file", F.regexp_replace("text", r"[\s\p{Z}]", "").alias("said"), F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"))


QUERIES = [
    Query(
        "bulk_transcribe", _bulk,
        with_views(
            r"""SELECT file, coalesce(string_agg(word, '' ORDER BY i), '') AS said, count(word) AS n_words FROM (
                  SELECT file, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS word, unnest(range(greatest(len(ws), 1))) AS i FROM turn_lists) GROUP BY file""",
            r"""turn_lists AS (SELECT conv_id * 100 + turn AS file,
                  list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM conversations)""",
        ),
    ),
]
