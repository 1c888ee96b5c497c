"""Interval and series operators over event times."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import intervals as iv
from voxloom.plans import views
from voxloom.queries.base import Query, with_views

HOUR = 3600
WEEK = 7 * 24 * HOUR


def _runs(spark, sf_dir):
    loud = views.signal(spark, sf_dir).withColumn("flag", F.col("x") > 40)
    return iv.runs(loud, ["key"], shortest=2)


_LOUD_SQL = "loud AS (SELECT key, pos, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS g FROM sig WHERE x > 40)"
_RUNS_SQL = "rs AS (SELECT key, min(pos) AS s, max(pos) + 1 AS e FROM loud GROUP BY key, g)"


def _join_dips(spark, sf_dir):
    loud = views.signal(spark, sf_dir).withColumn("flag", F.col("x") > 40)
    return iv.join_dips(iv.runs(loud, ["key"]), ["key"], 3)


def _normalise(spark, sf_dir):
    return iv.normalise_intervals(views.intervals(spark, sf_dir), ["key"], block=WEEK)


_UNION_SQL = """
seen AS (SELECT key, s, e, max(e) OVER (PARTITION BY key ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
         FROM iv WHERE e > s),
marked AS (SELECT *, CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END AS opens FROM seen),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
uni AS (SELECT key, min(s) AS s, max(e) AS e FROM numbered GROUP BY key, g)"""


def _coverage(spark, sf_dir):
    return iv.interval_coverage(views.intervals(spark, sf_dir), ["key"], block=WEEK)


def _speech_and_bounds(spark, sf_dir):
    """The union of each user's clicks and views, and the user's purchases."""
    both = views.intervals(spark, sf_dir)
    spans = iv.normalise_intervals(both.where(F.col("kind").isin("click", "view")), ["key"], block=WEEK)
    bounds = both.where(~F.col("kind").isin("click", "view")).select("key", "id", "s", "e")
    return spans, bounds


_SPANS_SQL = _UNION_SQL.replace("FROM iv WHERE e > s", "FROM iv WHERE e > s AND kind IN ('click', 'view')")
_BOUNDS_SQL = "bounds AS (SELECT key, id, s, e FROM iv WHERE kind NOT IN ('click', 'view'))"


def _clip(spark, sf_dir):
    spans, bounds = _speech_and_bounds(spark, sf_dir)
    return iv.clip_intervals(spans, bounds, ["key"], bin_size=HOUR)


def _overlap(spark, sf_dir):
    spans, bounds = _speech_and_bounds(spark, sf_dir)
    return iv.overlap_sum(spans, bounds, ["key"], block=WEEK)


def _room(spark, sf_dir):
    spans = views.intervals(spark, sf_dir)
    return spans.select("id", iv.room(F.col("e") - F.col("s"), F.lit(600).cast("long")).alias("room"))


def _even_split(spark, sf_dir):
    return iv.even_split(views.intervals(spark, sf_dir).select("id", "s", "e"), 600)


QUERIES = [
    Query("runs", _runs, with_views("SELECT * FROM rs WHERE e - s >= 2", views.SIGNAL_SQL, _LOUD_SQL, _RUNS_SQL)),
    Query(
        "join_dips",
        _join_dips,
        with_views(
            """SELECT key, min(s) AS s, max(e) AS e FROM (
                 SELECT *, sum(o) OVER (PARTITION BY key ORDER BY s) AS g FROM (
                   SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY key ORDER BY s) < 3 THEN 0 ELSE 1 END AS o FROM rs))
               GROUP BY key, g""",
            views.SIGNAL_SQL,
            _LOUD_SQL,
            _RUNS_SQL,
        ),
    ),
    Query("normalise_intervals", _normalise, with_views("SELECT * FROM uni", views.INTERVALS_SQL, _UNION_SQL)),
    Query(
        "interval_coverage",
        _coverage,
        with_views(
            "SELECT key, count(*) AS pieces, CAST(sum(e - s) AS BIGINT) AS covered FROM uni GROUP BY key",
            views.INTERVALS_SQL,
            _UNION_SQL,
        ),
    ),
    Query(
        "clip_intervals",
        _clip,
        with_views(
            """SELECT b.key, b.id, greatest(b.s, u.s) AS s, least(b.e, u.e) AS e FROM bounds b
               JOIN uni u ON u.key = b.key AND u.s < b.e AND b.s < u.e""",
            views.INTERVALS_SQL,
            _SPANS_SQL,
            _BOUNDS_SQL,
        ),
    ),
    Query(
        "overlap_sum",
        _overlap,
        with_views(
            """SELECT b.key, b.id, CAST(coalesce(sum(CASE WHEN u.s IS NULL THEN 0 ELSE least(b.e, u.e) - greatest(b.s, u.s) END), 0) AS BIGINT) AS overlap
               FROM bounds b LEFT JOIN uni u ON u.key = b.key AND u.s < b.e AND b.s < u.e GROUP BY b.key, b.id""",
            views.INTERVALS_SQL,
            _SPANS_SQL,
            _BOUNDS_SQL,
        ),
    ),
    Query("room", _room, with_views("SELECT id, (e - s + 599) // 600 * 600 AS room FROM iv", views.INTERVALS_SQL)),
    Query(
        "even_split",
        _even_split,
        with_views(
            """SELECT id, part, s + (e - s) * part // n AS s, s + (e - s) * (part + 1) // n AS e
               FROM (SELECT *, unnest(range(n)) AS part FROM (SELECT *, (e - s + 599) // 600 AS n FROM iv WHERE e > s))""",
            views.INTERVALS_SQL,
        ),
    ),
]
