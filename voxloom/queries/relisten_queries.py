"""Quiet stretches listened to again, over the event values' levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import relisten as rl
from voxloom.plans import views
from voxloom.queries.base import Query, with_views
from voxloom.queries.signal_queries import _FRAMES_SQL, _LEVELS_SQL, _X_SQL, FRAME, _levels, _sizes

RATIO, RELISTEN, DIP, ENOUGH = 1.05, 5, 2, 2
#: Rounds that the SQL writes out; the last finds nothing on the given tables.
WRITTEN = 4


def _loud(levels):
    return rl.loud_runs(levels, ["key"], ratio=RATIO, relisten=RELISTEN, dip=DIP, enough=ENOUGH)


def _loud_frames(spark, sf_dir):
    return _loud(_levels(spark, sf_dir))


def _spans(spark, sf_dir):
    return rl.speech_spans_volume(
        _levels(spark, sf_dir), _sizes(spark, sf_dir), ["key"], relisten=RELISTEN, ratio=RATIO, dip=DIP, pad=1, frame=FRAME, enough=ENOUGH
    )


def _pauses(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    return rl.quiet_runs(_loud(levels), levels, ["key"], shortest=2)


def _round(k: int) -> str:
    """The CTEs of one round, frame by frame: parts, gates, heard, sounds, near, loud, and what is left."""
    return f"""
p{k} AS MATERIALIZED (SELECT l.key, l.f, l.rms, t.s AS rs, t.e AS re FROM lev l JOIN t{k} t ON t.key = l.key AND l.f >= t.s AND l.f < t.e),
g{k} AS (SELECT key, rs, greatest(1e-3, avg(rms) * {RATIO}, quantile_cont(rms, 0.1) * sqrt(10)) AS gate FROM p{k} GROUP BY key, rs),
h{k} AS MATERIALIZED (SELECT key, rs, re, f FROM (
  SELECT key, rs, re, f, rms, lag(rms, 1) OVER w AS l1, lag(rms, 2) OVER w AS l2, lead(rms, 1) OVER w AS n1, lead(rms, 2) OVER w AS n2 FROM p{k} WINDOW w AS (PARTITION BY key, rs ORDER BY f))
  JOIN g{k} USING (key, rs) WHERE list_sort([coalesce(l2, l1, rms), coalesce(l1, rms), rms, coalesce(n1, rms), coalesce(n2, n1, rms)])[3] > gate),
d{k} AS MATERIALIZED (SELECT *, sum(o) OVER (PARTITION BY key, rs ORDER BY f) AS snd FROM (
  SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY key, rs ORDER BY f) <= {DIP} THEN 0 ELSE 1 END AS o FROM h{k})),
q{k} AS MATERIALIZED (SELECT key, rs, snd, min(f) AS a, max(f) + 1 AS b, count(*) >= {ENOUGH} AS counts FROM d{k} GROUP BY key, rs, snd),
n{k} AS MATERIALIZED (SELECT d.key, d.rs, d.f, d.snd, bool_or(d.f >= q.a - {RELISTEN} AND d.f < q.b + {RELISTEN}) AS kept,
  bool_or(d.f >= q.a - {RELISTEN + ENOUGH} AND d.f < q.b + {RELISTEN + ENOUGH}) AS reached
  FROM d{k} d JOIN q{k} q ON q.key = d.key AND q.rs = d.rs AND q.counts GROUP BY d.key, d.rs, d.f, d.snd),
o{k} AS (SELECT DISTINCT x.key, x.rs, x.snd FROM q{k} x JOIN q{k} y ON y.key = x.key AND y.rs = x.rs AND y.counts AND x.a < y.b + {RELISTEN} AND x.b > y.a - {RELISTEN}),
u{k} AS MATERIALIZED (SELECT key, f FROM n{k} JOIN o{k} USING (key, rs, snd) WHERE reached),
t{k + 1} AS MATERIALIZED (SELECT key, min(f) AS s, max(f) + 1 AS e FROM (
  SELECT p.key, p.rs, p.f, p.f - row_number() OVER (PARTITION BY p.key, p.rs ORDER BY p.f) AS g FROM p{k} p
  SEMI JOIN (SELECT key, rs FROM n{k} WHERE kept) m ON m.key = p.key AND m.rs = p.rs ANTI JOIN (SELECT key, rs, f FROM n{k} WHERE kept) z ON z.key = p.key AND z.rs = p.rs AND z.f = p.f)
  GROUP BY key, rs, g HAVING count(*) >= {RELISTEN})"""


_LOUD_SQL = f"""
lf AS MATERIALIZED (SELECT key, f, rms > greatest(1e-3, avg(rms) OVER (PARTITION BY key) * {RATIO}) AS loud FROM lev),
t0 AS MATERIALIZED (SELECT key, min(f) AS s, max(f) + 1 AS e FROM (SELECT key, f, f - row_number() OVER (PARTITION BY key ORDER BY f) AS g FROM lf WHERE NOT loud) GROUP BY key, g HAVING count(*) >= {RELISTEN}),
{",".join(_round(k) for k in range(WRITTEN))},
ld AS MATERIALIZED (SELECT key, f FROM lf WHERE loud {" ".join(f"UNION SELECT key, f FROM u{k}" for k in range(WRITTEN))}),
lr AS (SELECT key, min(f) AS s, max(f) + 1 AS e FROM (SELECT key, f, f - row_number() OVER (PARTITION BY key ORDER BY f) AS g FROM ld) GROUP BY key, g)"""
_LEVEL_VIEWS = (views.SIGNAL_SQL, _X_SQL, _FRAMES_SQL, _LEVELS_SQL.replace("lev AS (", "lev AS MATERIALIZED ("), _LOUD_SQL)

QUERIES = [
    Query("loud_frames", _loud_frames, with_views("SELECT key, s, e FROM lr", *_LEVEL_VIEWS)),
    Query(
        "speech_spans_volume", _spans,
        with_views(
            f"""SELECT key, greatest(0, min(s) * {FRAME} - 1) AS s, least(any_value(n), max(e) * {FRAME} + 1) AS e FROM (
                  SELECT *, sum(o) OVER (PARTITION BY key ORDER BY s) AS g FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY key ORDER BY s) < {DIP} THEN 0 ELSE 1 END AS o FROM lr))
                JOIN (SELECT key, count(*) AS n FROM xs GROUP BY key) USING (key) GROUP BY key, g""",
            *_LEVEL_VIEWS,
        ),
    ),
    Query(
        "merge_speech_pauses", _pauses,
        with_views(
            """SELECT key, min(f) AS s, max(f) + 1 AS e FROM (SELECT lev.key, lev.f, lev.f - row_number() OVER (PARTITION BY lev.key ORDER BY lev.f) AS g FROM lev ANTI JOIN ld ON ld.key = lev.key AND ld.f = lev.f)
               GROUP BY key, g HAVING count(*) >= 2""",
            *_LEVEL_VIEWS,
        ),
    ),
]
