"""Packing, over the union of each user's event intervals as speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import intervals as iv
from voxloom.operators import planning as pl
from voxloom.plans import views
from voxloom.queries.base import Query, with_views
from voxloom.queries.interval_queries import _UNION_SQL, WEEK
from voxloom.session import cut_lineage

START = 1_704_067_200
TRIM, TARGET, MAXIMUM, LEAST, CONTEXT = 7200, 36_000, 45_000, 12_000, 3000


def _speech(spark, sf_dir):
    spans = iv.normalise_intervals(views.intervals(spark, sf_dir), ["key"], block=WEEK)
    speech = cut_lineage(spans.select(F.col("key").alias("file"), (F.col("s") - START).alias("s"), (F.col("e") - START).alias("e")))
    return speech, speech.groupBy("file").agg((F.max("e") + 500).alias("total"))


def _stretches(spark, sf_dir):
    speech, sizes = _speech(spark, sf_dir)
    found = pl.stretches(speech, sizes, trim=TRIM, block=WEEK)
    return found.select("file", "stretch", F.size("spans").cast("long").alias("n"), "head", "tail", "next_start", "total")


def _plan(spark, sf_dir):
    speech, sizes = _speech(spark, sf_dir)
    return pl.plan_chunks(speech, sizes, target=TARGET, maximum=MAXIMUM, least=LEAST, context=CONTEXT, step=60, trim=TRIM)


def _ranges(spark, sf_dir):
    return _plan(spark, sf_dir).select("file", "rs", "re")


def _report(spark, sf_dir):
    """Per file: pieces, the longest, and the speech in no range."""
    speech, _sizes = _speech(spark, sf_dir)
    plan = cut_lineage(_plan(spark, sf_dir))
    bounds = plan.select("file", F.col("rs").alias("id"), F.col("rs").alias("s"), F.col("re").alias("e"))
    inside = iv.overlap_sum(speech, bounds, ["file"], block=WEEK).groupBy("file").agg(F.sum("overlap").alias("inside"))
    whole = speech.groupBy("file").agg(F.sum(F.col("e") - F.col("s")).alias("heard"))
    shape = plan.groupBy("file").agg(
        (F.max(F.col("re") - F.col("rs")) <= MAXIMUM - 2 * CONTEXT).alias("ranges_fit"), (F.max(F.col("we") - F.col("ws")) <= MAXIMUM).alias("windows_fit"),
    )
    return whole.join(inside, "file").join(shape, "file").select(
        "file", "heard", (F.col("heard") - F.col("inside")).alias("outside"), "ranges_fit", "windows_fit"
    )


QUERIES = [
    Query(
        "speech_stretches", _stretches,
        with_views(
            f"""SELECT key AS file, min(s) AS stretch, count(*) AS n, min(g) = 1 AS head, lead(min(s)) OVER (PARTITION BY key ORDER BY min(s)) IS NULL AS tail,
                  lead(min(s)) OVER (PARTITION BY key ORDER BY min(s)) AS next_start, any_value(total) AS total
                FROM (SELECT *, sum(o) OVER (PARTITION BY key ORDER BY s) AS g, max(e) OVER (PARTITION BY key) + 500 AS total FROM (
                  SELECT key, s - {START} AS s, e - {START} AS e, CASE WHEN s - lag(e) OVER (PARTITION BY key ORDER BY s) < {TRIM} THEN 0 ELSE 1 END AS o FROM uni))
                GROUP BY key, g""",
            views.INTERVALS_SQL, _UNION_SQL,
        ),
    ),
    Query("plan_chunks", _ranges),
    Query("context_windows", _plan),
    Query(
        "plan_coverage", _report,
        with_views(
            "SELECT key AS file, CAST(sum(e - s) AS BIGINT) AS heard, 0 AS outside, TRUE AS ranges_fit, TRUE AS windows_fit FROM uni GROUP BY key",
            views.INTERVALS_SQL, _UNION_SQL,
        ),
    ),
]
