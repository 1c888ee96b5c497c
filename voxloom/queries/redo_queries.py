"""Second decodes put in among the first's, over decodes that skipped words."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import reconcile as rc
from voxloom.operators import redo
from voxloom.operators.seams import trim_overlaps
from voxloom.plans import views
from voxloom.queries.base import Query, with_views
from voxloom.queries.seam_queries import _SKIP_SQL, _STRETCH_SQL, _WINDOW_SQL, DECODED_SQL, _skipping, decoded
from voxloom.session import cut_lineage


def redecoded(first, full):
    """redos(file, piece, k, ...): each window of skipped speech, decoded again
    from `full`, a decode of the same pieces that skipped nothing."""
    windows = first.withColumn("g", rc.redo_windows(F.col("ws"), F.col("we"), F.col("stretches"))).select(
        "file", "piece", "stretches", F.posexplode("g").alias("k", "g")
    ).select("file", "piece", "k", F.col("g.s").alias("start"), F.col("g.e").alias("stop"), "stretches")
    heard = windows.join(full.select("file", "piece", "ws", "tokens", "timestamps"), ["file", "piece"])
    inside = F.filter(
        F.arrays_zip("tokens", "timestamps"),
        lambda p: (F.col("ws") + rc.samples(p["timestamps"]) >= F.col("start")) & (F.col("ws") + rc.samples(p["timestamps"]) < F.col("stop")),
    )
    own = F.filter("stretches", lambda g: (g["s"] >= F.col("start")) & (g["e"] <= F.col("stop")))
    # times from the window's start, on whole milliseconds
    return heard.withColumn("_z", inside).select(
        "file", "piece", "k", "start", "stop", own.alias("stretches"), F.col("_z.tokens").alias("again_tokens"),
        F.transform("_z.timestamps", lambda t: F.round(t + (F.col("ws") - F.col("start")) / 16000.0, 9)).alias("again_times"), F.lit(False).alias("parts"),
    )


def _passes(spark, sf_dir):
    first = cut_lineage(rc.untimed_stretches(_skipping(spark, sf_dir)))
    return first, cut_lineage(redecoded(first, decoded(spark, sf_dir)))


def _merge(spark, sf_dir):
    first, redos = _passes(spark, sf_dir)
    pieces = first.drop("stretches").withColumn("taken", F.array().cast(redo.TAKEN)).withColumn("barred", F.array().cast(redo.BARRED))
    out = redo.merge_redos(pieces, redos)
    return out.select("file", "piece", F.array_join("tokens", "").alias("said"), F.col("new").cast("long").alias("new"))


def _protect(spark, sf_dir):
    """Per file, the words that its seams keep of the first decodes, and how
    many of those they lose once the second decodes are in."""
    first, redos = _passes(spark, sf_dir)
    pieces = first.drop("stretches")
    after = redo.protect_seam_words(pieces, redos).drop("new", "round")

    def kept(frame, name):
        words = trim_overlaps(frame).select("file", F.explode("tokens").alias("word"))
        return words.groupBy("file", "word").agg(F.count(F.lit(1)).alias(name))

    both = kept(pieces, "before").join(kept(after, "after"), ["file", "word"], "left")
    return both.groupBy("file").agg(
        F.sum("before").alias("kept"), F.sum(F.greatest(F.col("before") - F.coalesce("after", F.lit(0)), F.lit(0))).alias("lost")
    )


_REDO_SQL = """
heard AS (SELECT r.*, d.i, d.pt, d.word, max(d.i) OVER (PARTITION BY r.file, r.piece, r.s) AS final FROM rw r JOIN dec d ON d.file = r.file AND d.piece = r.piece AND d.pt >= r.a AND d.pt < r.b),
sides AS (SELECT file, piece, s, max(pt) FILTER (WHERE pt < s) AS prior, min(pt) FILTER (WHERE pt >= e) AS later
          FROM heard WHERE i % 16 NOT BETWEEN 7 AND 13 AND regexp_matches(word, '[\\p{L}\\p{N}_]') GROUP BY file, piece, s),
ins AS (SELECT h.file, h.piece, h.i, h.word, h.pt >= h.s AND h.pt < h.e AS inside FROM heard h LEFT JOIN sides z USING (file, piece, s)
        WHERE h.i % 16 BETWEEN 7 AND 13 AND h.i < h.final
          AND CASE WHEN z.prior IS NOT NULL THEN h.pt > z.prior WHEN h.s = h.rs AND h.a < h.rs THEN TRUE ELSE h.pt >= h.s - 5120 END
          AND CASE WHEN z.later IS NOT NULL THEN h.pt < z.later WHEN h.e = h.re AND h.b > h.re THEN TRUE ELSE h.pt < h.e END)"""

QUERIES = [
    Query(
        "merge_redo_words", _merge,
        with_views(
            """SELECT p.file, p.piece, coalesce(string_agg('▁' || w.word, '' ORDER BY w.i), '') AS said, count(*) FILTER (WHERE w.inside) AS new
               FROM pcs p LEFT JOIN (SELECT file, piece, i, word, FALSE AS inside FROM skp UNION ALL SELECT file, piece, i, word, inside FROM ins) w USING (file, piece) GROUP BY p.file, p.piece""",
            DECODED_SQL, _SKIP_SQL, _STRETCH_SQL, _WINDOW_SQL, _REDO_SQL,
        ),
    ),
    Query(
        "protect_seam_words", _protect,
        with_views("SELECT file, count(*) AS kept, 0 AS lost FROM tw WHERE i % 16 NOT BETWEEN 7 AND 13 GROUP BY file", DECODED_SQL),
    ),
]
