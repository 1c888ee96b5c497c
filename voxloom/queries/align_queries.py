"""Forced alignment over embedding vectors as frame logits: forty frames to an
utterance, and as its text the likeliest token of every fifth frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import align as al
from voxloom.plans import views
from voxloom.queries.base import Query, with_views

FRAMES = 40
BLANK, SEPARATOR = 0, 1


def emission(spark, sf_dir):
    frames = views.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / FRAMES).alias("utt"), (F.col("vec_id") % FRAMES).cast("int").alias("f"),
        F.transform("embedding", lambda v: v.cast("double") * 20).alias("x"),
    )
    return frames.select("utt", "f", (F.col("f") * 0.02).alias("t"), al.log_softmax(F.col("x")).alias("lp"))


EMISSION_SQL = f"""
lg AS (SELECT vec_id // {FRAMES} AS utt, CAST(vec_id % {FRAMES} AS INTEGER) AS f, unnest(range(64)) AS v, CAST(unnest(embedding) AS DOUBLE) * 20 AS x FROM embeddings),
em AS (SELECT lg.utt, lg.f, lg.v, x - m - ln(z) AS lp FROM lg JOIN
        (SELECT utt, f, any_value(m) AS m, sum(exp(x - m)) AS z FROM (SELECT *, max(x) OVER (PARTITION BY utt, f) AS m FROM lg) GROUP BY utt, f) s USING (utt, f))"""


def targets(spark, sf_dir):
    """Each utterance's likeliest tokens other than blank and separator, two to a word."""
    rows = emission(spark, sf_dir).where(F.col("f") % 5 == 2)
    best = F.array_position("lp", F.array_max(F.slice("lp", 3, 62))) - 1
    return rows.select("utt", F.floor(F.col("f") / 10).cast("int").alias("w"), "f", best.cast("int").alias("id")).groupBy("utt", "w").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "id"))), lambda p: p["id"]).alias("ids")
    ).select("utt", "w", F.lit(0).alias("part"), "ids")


def _softmax(spark, sf_dir):
    return emission(spark, sf_dir).select("utt", "f", F.posexplode("lp").alias("v", "lp")).select(
        "utt", "f", F.col("v").cast("long").alias("v"), F.round("lp", 6).alias("lp")
    )


def _star(spark, sf_dir):
    return al.star_states(emission(spark, sf_dir), SEPARATOR).select("utt", "f", F.round("star", 6).alias("star"))


def _finite(spark, sf_dir):
    frames = emission(spark, sf_dir).withColumn(
        "lp", F.when((F.col("utt") % 4 == 1) & (F.col("f") == 3), F.array(F.lit(float("nan")))).otherwise(F.col("lp"))
    )
    return al.finite_utterances(frames)


def _ids(spark, sf_dir):
    words = views.spread_out(views.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("utt"), F.posexplode(views.split_words(F.lower("text"))).alias("w", "said")
    )
    vocab = {letter: n for n, letter in enumerate("|'abcdefghijklmnopqrstuvwxyz")}
    found = al.spoken_token_ids(words, vocab)
    return found.groupBy("utt").agg(
        F.count("*").alias("words"), F.sum(F.size("ids")).alias("letters"),
        F.sum(F.aggregate("ids", F.lit(0), lambda a, i: a + i)).alias("total"),
    )


def _path(spark, sf_dir):
    return al.ctc_align(emission(spark, sf_dir), targets(spark, sf_dir), blank=BLANK, separator=SEPARATOR)


def _align(spark, sf_dir):
    return _path(spark, sf_dir).select("utt", "w", "part", "f", F.round("short", 5).alias("short"))


def _times(spark, sf_dir):
    return al.word_times(_path(spark, sf_dir)).select("utt", "w", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _score(spark, sf_dir):
    return al.word_times(_path(spark, sf_dir)).select("utt", "w", F.round("score", 5).alias("score"))


def _apply(spark, sf_dir):
    """Turn words moved by spans with every third one missing."""
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", views.split_words(F.col("text")).alias("ws"))
    words = F.transform("ws", lambda w, i: F.struct(w.alias("word"), (i * 8 / F.lit(10.0)).alias("start"), (i * 8 / F.lit(10.0) + 0.5).alias("end")))
    spans = F.transform(
        "ws", lambda w, i: F.when(i % 3 != 1, F.struct((i * 8 / F.lit(10.0) + 0.3).alias("start"), (i * 8 / F.lit(10.0) + 0.9).alias("end")))
    )
    moved = al.apply_alignment(words, spans, F.lit(0.0), F.size("ws") * 0.8)
    return turns.select("conv_id", "turn", F.posexplode(moved).alias("i", "m")).select(
        "conv_id", "turn", F.col("i").cast("long").alias("i"), F.round("m.start", 3).alias("start"), F.round("m.end", 3).alias("end")
    )


def _rank(spark, sf_dir):
    """Each word's readings over its own ten frames and two more on either side."""
    said, frame = targets(spark, sf_dir), F.col("w") * 10
    ways = F.array(F.col("ids"), F.reverse("ids"), F.slice("ids", 1, 1))
    readings = said.select("utt", F.col("w").alias("phrase"), ((frame - 2) * 0.02).alias("start"), ((frame + 12) * 0.02).alias("end"),
        F.posexplode(ways).alias("rank", "way"),
    ).select(
        "utt", "phrase", "rank", "start", "end", F.array(F.struct(F.col("phrase").alias("w"), F.col("way").alias("ids"))).alias("parts"),
    )
    ranked = al.rank_readings(emission(spark, sf_dir), readings, blank=BLANK, separator=SEPARATOR)
    return ranked.select("utt", "phrase", "rank", F.round("score", 4).alias("score"), "best")


def _outcome(spark, sf_dir):
    frames, said = emission(spark, sf_dir), targets(spark, sf_dir)
    words = said.select("utt", "w", F.when(F.col("utt") % 3 == 0, "слово").otherwise("word").alias("word"))
    said = said.where((F.col("utt") % 3 != 0) | (F.col("w") == 0))
    path = al.ctc_align(frames.where((F.col("utt") % 5 != 2) | (F.col("f") < 6)), said, blank=BLANK, separator=SEPARATOR)
    finite = _finite(spark, sf_dir)
    return al.alignment_outcome(words, said, finite, path)


def _known_text(spark, sf_dir):
    """Each utterance reads its own tokens, spelled as letters."""
    alphabet = {chr(0x4E00 + n): n for n in range(2, 64)}
    said = targets(spark, sf_dir)
    spelled = F.array_join(F.transform("ids", lambda i: F.expr("array(" + ",".join(f"'{chr(0x4E00 + n)}'" for n in range(64)) + ")")[i]), "")
    words = said.select("utt", "w", spelled.alias("word"), spelled.alias("said"))
    out = al.align_known_text(emission(spark, sf_dir), words, alphabet, blank=BLANK, separator=SEPARATOR)
    return out.select("utt", "w", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("score", 5).alias("score"))


QUERIES = [
    Query("log_softmax_frames", _softmax, with_views("SELECT utt, f, v, round(lp, 6) AS lp FROM em", EMISSION_SQL)),
    Query(
        "star_states", _star,
        with_views("SELECT utt, f, round(greatest(max(lp) FILTER (WHERE v = 1), max(lp) - 0.5), 6) AS star FROM em GROUP BY utt, f", EMISSION_SQL),
    ),
    Query("finite_utterances", _finite, f"SELECT vec_id // {FRAMES} AS utt, NOT bool_or(vec_id // {FRAMES} % 4 = 1 AND vec_id % {FRAMES} = 3) AS finite FROM embeddings GROUP BY 1"),
    Query(
        "spoken_token_ids", _ids,
        r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS word FROM documents),
           k AS (SELECT doc_id, regexp_replace(word, '[^|''a-z]', '', 'g') AS l FROM w)
           SELECT doc_id AS utt, count(*) AS words, CAST(sum(length(l)) AS BIGINT) AS letters,
             CAST(sum(list_sum(list_transform(string_split(l, ''), lambda c: CASE c WHEN '|' THEN 0 WHEN '''' THEN 1 ELSE ascii(c) - 95 END))) AS BIGINT) AS total
           FROM k WHERE l <> '' GROUP BY doc_id""",
    ),
    Query("ctc_align", _align),
    Query("word_times", _times),
    Query("word_score", _score),
    Query(
        "apply_alignment", _apply,
        r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM conversations),
           r AS (SELECT conv_id, turn, len(ws) * 0.8 AS hi, unnest(range(len(ws))) AS i FROM t),
           p AS (SELECT *, CASE WHEN i % 3 <> 1 THEN least(hi, i * 0.8 + 0.3) END AS s, CASE WHEN i % 3 <> 1 THEN least(hi, i * 0.8 + 0.9) END AS e FROM r),
           n AS (SELECT *, coalesce(lag(e) OVER w, 0) AS lo, coalesce(lead(s) OVER w, hi) AS nx FROM p WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
           u AS (SELECT *, greatest(lo, nx) AS top, least(greatest(i * 0.8, lo), greatest(lo, nx)) AS us FROM n)
           SELECT conv_id, turn, i, CAST(round(coalesce(s, us), 3) AS DOUBLE) AS start,
             CAST(round(coalesce(e, least(greatest(i * 0.8 + 0.5, us), top)), 3) AS DOUBLE) AS "end" FROM u""",
    ),
    Query("rank_readings", _rank),
    Query(
        "alignment_outcome", _outcome,
        f"""SELECT DISTINCT utt, CASE WHEN utt % 3 = 0 AND words > 2 THEN 'other alphabet' WHEN utt % 4 = 1 AND frames > 3 THEN 'failed'
              WHEN utt % 5 = 2 AND words > 1 AND frames > 5 AND utt % 3 <> 0 THEN 'too short' ELSE 'aligned' END AS outcome
            FROM (SELECT vec_id // {FRAMES} AS utt, count(*) AS frames, count(DISTINCT CASE WHEN vec_id % {FRAMES} % 5 = 2 THEN vec_id % {FRAMES} // 10 END) AS words
                  FROM embeddings GROUP BY 1)""",
    ),
    Query("align_known_text", _known_text),
]
