"""Loudness operators over event values and embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import signal as sg
from voxloom.operators.blocks import sizes_of
from voxloom.plans import views
from voxloom.queries.base import Query, with_views
from voxloom.session import cut_lineage

FRAME = 2
SIZE = 128  # samples of a block


def _samples(spark, sf_dir):
    """Event values scaled to about [0, 0.5], so gates and offsets both act."""
    return views.signal(spark, sf_dir).withColumn("x", F.col("x") / 1000)


def _blocks(spark, sf_dir):
    return views.signal_blocks(spark, sf_dir, SIZE, 1000)


_X_SQL = "xs AS (SELECT key, pos, x / 1000 AS x FROM sig)"
_FRAMES_SQL = f"""
fr AS (SELECT key, pos // {FRAME} AS f, avg(x) AS mean, var_pop(x) AS var FROM xs GROUP BY ALL HAVING count(*) = {FRAME})"""
_LEVELS_SQL = """
cnt AS (SELECT key, count(*) AS n FROM fr GROUP BY key),
smo AS (SELECT a.key, a.f, any_value(a.mean) AS mean, any_value(a.var) AS var, any_value(c.n) AS n, avg(b.mean) AS s
        FROM fr a JOIN cnt c USING (key) JOIN fr b ON b.key = a.key
         AND b.f >= greatest(0, least(a.f - 6, greatest(0, c.n - 12)))
         AND b.f < least(greatest(0, least(a.f - 6, greatest(0, c.n - 12))) + 12, c.n) GROUP BY a.key, a.f),
idx AS (SELECT key, f, n, unnest(range(f - 25, f + 26)) AS j FROM smo),
refl AS (SELECT key, f, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS src FROM (SELECT key, f, n, ((j % (2 * n)) + 2 * n) % (2 * n) AS m FROM idx)),
med AS (SELECT r.key, r.f, quantile_cont(s.s, 0.5) AS o FROM refl r JOIN smo s ON s.key = r.key AND s.f = r.src GROUP BY r.key, r.f),
lev AS (SELECT s.key, s.f, sqrt(var + least(mean * mean, (mean - off) * (mean - off)) + 1e-12) AS rms
        FROM smo s JOIN (SELECT key, f, o * greatest(0, least(1, abs(o) / 1e-3 - 1)) AS off FROM med) m USING (key, f))"""


def _levels(spark, sf_dir):
    frames = sg.framed(_blocks(spark, sf_dir), ["key"], SIZE, FRAME)
    return cut_lineage(sg.frame_levels(frames, ["key"], SIZE // FRAME))


def _frame_signal(spark, sf_dir):
    return sg.frame_signal(_blocks(spark, sf_dir), ["key"], SIZE, FRAME).select("key", "f", F.round("mean", 12).alias("mean"), F.round("var", 12).alias("var"))


def _frame_rms(spark, sf_dir):
    return _levels(spark, sf_dir).select("key", "f", F.round("rms", 8).alias("rms"))


def _gate(spark, sf_dir):
    return sg.relative_gate(_levels(spark, sf_dir), ["key"], 0.6).select("key", F.round("gate", 8).alias("gate"))


def _sizes(spark, sf_dir):
    return sizes_of(_blocks(spark, sf_dir), ["key"])


def _spans(spark, sf_dir):
    flagged = sg.above_gate(_levels(spark, sf_dir), ["key"], ratio=1.1)
    return sg.speech_spans(flagged, _sizes(spark, sf_dir), ["key"], dip=2, pad=1, frame=FRAME)


_SPANS_SQL = f"""
gat AS (SELECT key, greatest(1e-3, avg(rms) * 1.1) AS gate FROM lev GROUP BY key),
lf AS (SELECT key, f, f - row_number() OVER (PARTITION BY key ORDER BY f) AS g FROM lev JOIN gat USING (key) WHERE rms > gate),
lr AS (SELECT key, min(f) AS s, max(f) + 1 AS e FROM lf GROUP BY key, g),
lj AS (SELECT key, min(s) AS s, max(e) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY key ORDER BY s) AS g FROM (
         SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY key ORDER BY s) < 2 THEN 0 ELSE 1 END AS o FROM lr)) GROUP BY key, g),
spn AS (SELECT key, greatest(0, s * {FRAME} - 1) AS s, least(n, e * {FRAME} + 1) AS e FROM lj JOIN (SELECT key, count(*) AS n FROM xs GROUP BY key) USING (key))"""


def _pauses(spark, sf_dir):
    return sg.pauses(sg.above_gate(_levels(spark, sf_dir), ["key"], ratio=1.1), ["key"], shortest=2)


def _has_speech(spark, sf_dir):
    clips = _samples(spark, sf_dir).where(F.col("pos") % 5 == 0).select(
        "key", F.floor(F.col("pos") / 5).alias("id"), F.col("pos").alias("s"), (F.col("pos") + 5).alias("e")
    )
    return sg.filter_has_speech(clips, _spans(spark, sf_dir), ["key"], bin_size=64)


def _power(spark, sf_dir):
    runs = sg.span_power(views.signal_blocks(spark, sf_dir, 16, 1000), ["key"], 8, 16)
    each = runs.select("key", "pos", F.posexplode("power").alias("i", "power"))
    return each.select("key", (F.col("pos") + F.col("i")).alias("pos"), F.round("power", 9).alias("power"))


def _standard(spark, sf_dir):
    out = sg.standardise_windows(
        _blocks(spark, sf_dir), _sizes(spark, sf_dir), ["key"], SIZE, window=20, context=4, tail=6, least=5
    )
    return out.select("key", "win", "core_s", "core_e", "n", F.round("mean", 8).alias("mean"), F.round("scale", 8).alias("scale"))


def _waves(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))


def _normalise(spark, sf_dir):
    ints = _waves(spark, sf_dir).withColumn("x", F.transform("x", lambda v: F.floor(v.cast("double") * 10000)))
    mono = sg.normalise_samples(sg.pcm_to_float(F.col("x"), 2), 3, 18)
    return ints.select("vec_id", F.posexplode(mono).alias("i", "v")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("v", 8).alias("v")
    )


def _scan_samples(spark, sf_dir):
    return _waves(spark, sf_dir).select(
        "vec_id", F.size("x").cast("long").alias("n"),
        F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"),
    )


def _level_match(spark, sf_dir):
    out = sg.level_match_context(F.col("x"), F.lit(20), F.lit(44))
    return _waves(spark, sf_dir).select("vec_id", F.posexplode(out).alias("i", "v")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("v", 7).alias("v")
    )


def _syllable(spark, sf_dir):
    """Each vector's sizes as levels, held quiet over a stretch of its own."""
    quieted = F.transform(
        "x", lambda v, i: F.when((i >= F.col("vec_id") % 40) & (i < F.col("vec_id") % 40 + F.col("vec_id") % 16), F.lit(0.001)).otherwise(F.abs(v) * 3)
    )
    return _waves(spark, sf_dir).select(
        "vec_id", sg.pause_then_syllable(quieted, (F.col("vec_id") % 10).cast("int")).alias("alone")
    )


def _slice(spark, sf_dir):
    blocks = _waves(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 8).alias("file"), (F.col("vec_id") % 8).alias("block"), "x"
    )
    windows = blocks.select(
        "file", F.col("block").alias("piece"), (F.col("block") * 64 + F.col("file") % 50).alias("ws"),
        (F.col("block") * 64 + F.col("file") % 50 + 100).alias("we"),
    )
    cut = sg.slice_pieces(blocks, windows, block=64)
    return cut.select(
        "file", "piece", F.size("x").cast("long").alias("n"),
        F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"),
        F.round(F.get("x", F.size("x") - 1).cast("double"), 7).alias("last"),
    )


_WAVE_SQL = "wv AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings)"

QUERIES = [
    Query("frame_signal", _frame_signal, with_views("SELECT key, f, round(mean, 12) AS mean, round(var, 12) AS var FROM fr", views.SIGNAL_SQL, _X_SQL, _FRAMES_SQL)),
    Query("frame_rms", _frame_rms, with_views("SELECT key, f, round(rms, 8) AS rms FROM lev", views.SIGNAL_SQL, _X_SQL, _FRAMES_SQL, _LEVELS_SQL)),
    Query(
        "relative_gate", _gate,
        with_views("SELECT key, round(greatest(1e-3, avg(rms) * 0.6), 8) AS gate FROM lev GROUP BY key", views.SIGNAL_SQL, _X_SQL, _FRAMES_SQL, _LEVELS_SQL),
    ),
    Query("gated_speech_spans", _spans, with_views("SELECT key, s, e FROM spn", views.SIGNAL_SQL, _X_SQL, _FRAMES_SQL, _LEVELS_SQL, _SPANS_SQL)),
    Query(
        "gated_pauses", _pauses,
        with_views(
            """SELECT key, min(f) AS s, max(f) + 1 AS e FROM (SELECT key, f, f - row_number() OVER (PARTITION BY key ORDER BY f) AS g
                 FROM lev JOIN gat USING (key) WHERE NOT rms > gate) GROUP BY key, g HAVING count(*) >= 2""",
            views.SIGNAL_SQL, _X_SQL, _FRAMES_SQL, _LEVELS_SQL, _SPANS_SQL,
        ),
    ),
    Query(
        "filter_has_speech", _has_speech,
        with_views(
            """SELECT c.key, c.pos // 5 AS id, CAST(sum(least(c.pos + 5, e) - greatest(c.pos, s)) AS BIGINT) AS speech
               FROM xs c JOIN spn USING (key) WHERE c.pos % 5 = 0 AND s < c.pos + 5 AND c.pos < e GROUP BY ALL""",
            views.SIGNAL_SQL, _X_SQL, _FRAMES_SQL, _LEVELS_SQL, _SPANS_SQL,
        ),
    ),
    Query(
        "span_power", _power,
        with_views(
            """SELECT key, pos, round(greatest(0, avg(x * x) OVER w - (avg(x) OVER w) * (avg(x) OVER w)), 9) AS power FROM xs
               WINDOW w AS (PARTITION BY key ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)""",
            views.SIGNAL_SQL, _X_SQL,
        ),
    ),
    Query(
        "standardise_windows", _standard,
        with_views(
            """SELECT c.key, k AS win, cs AS core_s, ce AS core_e, count(*) AS n, round(avg(x), 8) AS mean, round(sqrt(var_pop(x) + 1e-7), 8) AS scale
               FROM (SELECT key, k, k * 20 AS cs, CASE WHEN k = w - 1 THEN n ELSE k * 20 + 20 END AS ce FROM (
                 SELECT *, unnest(range(w)) AS k FROM (SELECT key, count(*) AS n, CASE WHEN count(*) % 20 BETWEEN 1 AND 5 AND count(*) > 20 THEN count(*) // 20 ELSE (count(*) + 19) // 20 END AS w
                 FROM xs GROUP BY key))) c
               JOIN xs ON xs.key = c.key AND xs.pos >= c.cs - 4 AND xs.pos < c.ce + 4 GROUP BY c.key, k, cs, ce HAVING count(*) >= 5""",
            views.SIGNAL_SQL, _X_SQL,
        ),
    ),
    Query(
        "normalise_samples", _normalise,
        with_views("SELECT vec_id, i // 3 AS i, round(avg(floor(v * 10000) / 32768), 8) AS v FROM wv WHERE i < 54 GROUP BY ALL", _WAVE_SQL),
    ),
    Query("scan_samples", _scan_samples, with_views("SELECT vec_id, count(*) AS n, round(sum(v), 6) AS total FROM wv GROUP BY vec_id", _WAVE_SQL)),
    Query(
        "level_match_context", _level_match,
        with_views(
            """SELECT vec_id, i, round(CASE WHEN i < 20 AND a > m AND m > 0 THEN v * m / a WHEN i >= 44 AND b > m AND m > 0 THEN v * m / b ELSE v END, 7) AS v
               FROM wv JOIN (SELECT vec_id, sqrt(avg(v * v) FILTER (WHERE i < 20)) AS a, sqrt(avg(v * v) FILTER (WHERE i BETWEEN 20 AND 43)) AS m,
                                    sqrt(avg(v * v) FILTER (WHERE i >= 44)) AS b FROM wv GROUP BY vec_id) USING (vec_id)""",
            _WAVE_SQL,
        ),
    ),
    Query(
        "pause_then_syllable", _syllable,
        with_views(
            """SELECT v.vec_id, coalesce(bool_or(loud.le > quiet.qe), FALSE) AS alone FROM embeddings v
               LEFT JOIN (SELECT vec_id, min(i) AS qe FROM (SELECT vec_id, i, count(*) OVER (PARTITION BY vec_id, g ORDER BY i) AS c FROM (
                   SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM ql WHERE level < pow(10, -1.25))) WHERE c = 12 GROUP BY vec_id) quiet USING (vec_id)
               LEFT JOIN (SELECT a.vec_id, c.i AS le FROM ql a JOIN ql b ON b.vec_id = a.vec_id AND b.i = a.i + 1 JOIN ql c ON c.vec_id = a.vec_id AND c.i = a.i + 2
                          JOIN (SELECT vec_id, min(i) AS q FROM (SELECT vec_id, i, count(*) OVER (PARTITION BY vec_id, g ORDER BY i) AS c FROM (
                            SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM ql WHERE level < pow(10, -1.25))) WHERE c = 12 GROUP BY vec_id) z
                          ON z.vec_id = a.vec_id AND a.i > z.q
                          WHERE least(a.level, b.level, c.level) > pow(10, -0.75)) loud USING (vec_id) GROUP BY v.vec_id""",
            _WAVE_SQL,
            """ql AS (SELECT vec_id, i, CASE WHEN i >= vec_id % 40 AND i < vec_id % 40 + vec_id % 16 THEN 0.001 ELSE CAST(abs(CAST(v AS FLOAT)) * 3 AS DOUBLE) END AS level
                FROM wv WHERE i >= vec_id % 10)""",
        ),
    ),
    Query(
        "slice_pieces", _slice,
        with_views(
            """SELECT w.file, w.piece, count(*) AS n, round(sum(s.v), 6) AS total, round(max_by(s.v, s.p), 7) AS last
               FROM (SELECT vec_id // 8 AS file, vec_id % 8 AS piece, vec_id % 8 * 64 + vec_id // 8 % 50 AS ws FROM embeddings) w
               JOIN (SELECT vec_id // 8 AS file, vec_id % 8 * 64 + i AS p, v FROM wv) s ON s.file = w.file AND s.p >= w.ws AND s.p < w.ws + 100 GROUP BY ALL""",
            _WAVE_SQL,
        ),
    ),
]
