"""Overlapping pieces and second decodes, over the conversation turns.

A turn is a file: ranges of 20 words with 5 words of context either side. An
odd piece times its words 0.03 s later, and a context word in every seven is
heard differently, so neither piece alone has the seams right.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.arrays import part, pinned
from voxloom.operators import reconcile as rc
from voxloom.operators import seams as sm
from voxloom.plans import views
from voxloom.queries.base import Query, with_views

WORD_SAMPLES = 12_800
OWN, CONTEXT = 20, 5


def decoded(spark, sf_dir):
    turns = views.spread_out(views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("file"), views.split_words(F.col("text")).alias("words")
    )
    pieces = turns.withColumn("n", F.size("words")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / OWN).cast("int")))
    )
    first = F.greatest(F.col("piece") * OWN - CONTEXT, F.lit(0))
    stop = F.least(F.col("piece") * OWN + OWN + CONTEXT, F.col("n"))
    bounded = pieces.withColumn("f", first).withColumn("l", stop)
    i = lambda k: F.col("f") + k
    outside = lambda k: (i(k) < F.col("piece") * OWN) | (i(k) >= F.col("piece") * OWN + OWN)
    own = part(F.col("words"), F.col("f"), F.col("l"))
    return bounded.select(
        "file", "piece",
        (F.col("piece") * OWN * WORD_SAMPLES).cast("long").alias("rs"),
        (F.least((F.col("piece") + 1) * OWN, F.col("n")) * WORD_SAMPLES).cast("long").alias("re"),
        (F.col("f") * WORD_SAMPLES).cast("long").alias("ws"), (F.col("l") * WORD_SAMPLES).cast("long").alias("we"),
        F.transform(
            own, lambda w, k: F.concat(F.lit("▁"), w, F.when(outside(k) & (i(k) % 7 == 0), F.lit("x")).otherwise(F.lit("")))
        ).alias("tokens"),
        F.transform(own, lambda w, k: (k * 8) / F.lit(10.0) + F.when(F.col("piece") % 2 == 1, 0.03).otherwise(0.0)).alias("timestamps"),
    )


DECODED_SQL = r"""
turn_lists AS (SELECT conv_id * 100 + turn AS file,
  list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM conversations),
tw AS (SELECT file, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM turn_lists),
pcs AS (SELECT file, n, p AS piece, p * 256000 AS rs, least((p + 1) * 20, n) * 12800 AS re, greatest(p * 20 - 5, 0) * 12800 AS ws,
               least(p * 20 + 25, n) * 12800 AS we FROM (SELECT file, len(ws) AS n, unnest(range((len(ws) + 19) // 20)) AS p FROM turn_lists)),
dec AS (SELECT p.file, p.piece, p.rs, p.re, p.ws, p.we, t.i, t.i - p.ws // 12800 AS k, t.word || CASE WHEN (t.i < p.piece * 20 OR t.i >= p.piece * 20 + 20) AND t.i % 7 = 0 THEN 'x' ELSE '' END AS word,
               p.ws + CAST(floor(((t.i - p.ws // 12800) * 8 / 10.0 + CASE WHEN p.piece % 2 = 1 THEN 0.03 ELSE 0 END)::DOUBLE * 16000) AS BIGINT) AS pt
        FROM pcs p JOIN tw t ON t.file = p.file AND t.i * 12800 >= p.ws AND t.i * 12800 < p.we)"""


def _seams(spark, sf_dir):
    return sm.seams(sm.heard_words(decoded(spark, sf_dir))).where(F.col("left_first") >= 0)


def _matches(spark, sf_dir):
    heard = sm.heard_words(decoded(spark, sf_dir))
    nxt = heard.select("file", (F.col("piece") - 1).alias("piece"), F.col("heard").alias("highs"))
    both = heard.select("file", "piece", F.col("heard").alias("lows")).join(nxt, ["file", "piece"])
    pairs = both.withColumn("pairs", sm.match_sequences()(F.col("lows"), F.col("highs")))
    return pairs.select("file", "piece", F.size("pairs").cast("long").alias("matched"))


def _trim(spark, sf_dir):
    cut = sm.trim_overlaps(decoded(spark, sf_dir))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return cut.groupBy("file").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("text"))


def _regroup(spark, sf_dir):
    pieces = decoded(spark, sf_dir)
    dealt = pieces.groupBy("file").agg(F.count("*").alias("pieces"), F.max("piece").cast("long").alias("last"))
    lost = sm.regroup_check(pieces, pieces.where((F.col("file") % 10 != 3) | (F.col("piece") > 0)))
    return dealt.join(lost.select("file", "results"), "file", "left")


def _skipping(spark, sf_dir):
    """Decodes that skipped words 7 to 13 of every 16."""
    pieces = decoded(spark, sf_dir)
    heard = F.filter(
        F.arrays_zip("tokens", "timestamps"),
        lambda p: ~(F.floor((p["timestamps"] + F.col("ws") / 16000.0) / 0.8 + 0.5) % 16).between(7, 13),
    )
    told = pinned(pieces, z=heard)
    return told.withColumn("tokens", F.col("z.tokens")).withColumn("timestamps", F.col("z.timestamps")).drop("z")


_SKIP_SQL = "skp AS (SELECT * FROM dec WHERE i % 16 NOT BETWEEN 7 AND 13)"
_STRETCH_SQL = """
gp AS (SELECT p.file, p.piece, p.rs, p.re, p.ws, p.we, m.pt, lead(m.pt) OVER (PARTITION BY p.file, p.piece ORDER BY m.pt) AS nx
       FROM pcs p JOIN (SELECT file, piece, pt FROM skp UNION ALL SELECT file, piece, ws - 5120 AS pt FROM pcs) m USING (file, piece)),
st AS (SELECT file, piece, greatest(pt + 5120, rs) AS s, least(coalesce(nx, we), re) AS e FROM gp
       WHERE least(coalesce(nx, we), re) - greatest(pt + 5120, rs) >= 48000)"""

# stretches lie too far apart here for their windows to meet
_WINDOW_SQL = """
rw AS (
  SELECT *, CASE WHEN a0 = ws AND b0 = we THEN s ELSE a0 END AS a, CASE WHEN a0 = ws AND b0 = we THEN e ELSE b0 END AS b
  FROM (SELECT p.*, st.s, st.e, greatest(p.ws, st.s - 32000) AS a0, least(p.we, st.e + 32000) AS b0 FROM st JOIN pcs p USING (file, piece)) WHERE NOT (s = ws AND e = we))"""
_PAIRED_SQL = r"""
keyed AS MATERIALIZED (SELECT *, ws / 16000::DOUBLE + (k * 8 / 10::DOUBLE + CASE WHEN piece % 2 = 1 THEN 0.03::DOUBLE ELSE 0::DOUBLE END) AS told,
                              replace(lower(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')), 'ß', 'ss') AS key FROM dec),
paired AS MATERIALIZED (SELECT l.file, l.piece, l.i, l.k AS lk, r.k AS rk, l.told AS lt, r.told AS rt, l.rs, l.re, l.we, r.ws AS nws, r.rs AS nrs, r.re AS nre
                        FROM keyed l JOIN keyed r ON r.file = l.file AND r.piece = l.piece + 1 AND r.i = l.i AND r.key = l.key WHERE l.key <> '' AND abs(l.told - r.told) <= 0.4)"""


def _untimed(spark, sf_dir):
    found = rc.untimed_stretches(_skipping(spark, sf_dir))
    return found.select("file", "piece", F.explode("stretches").alias("g")).select("file", "piece", "g.s", "g.e")


def _speech(spark, sf_dir):
    """Each run of four words, but for the last half word, is speech."""
    turns = views.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("file"), F.size(views.split_words(F.col("text"))).alias("n")
    )
    k = turns.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int"))))
    return k.select("file", (F.col("k") * 51200).cast("long").alias("s"), (F.col("k") * 51200 + 44800).cast("long").alias("e"))


def _stalled(spark, sf_dir):
    found = rc.stalled_stretches(rc.untimed_stretches(_skipping(spark, sf_dir)), _speech(spark, sf_dir))
    return found.select("file", "piece", "s", "e", "overlap")


def _first_pass(spark, sf_dir):
    pieces = rc.untimed_stretches(_skipping(spark, sf_dir))
    return pieces.withColumn("starts", rc.word_starts(pieces))


def _in_stretches(spark, sf_dir):
    both = _first_pass(spark, sf_dir).select("file", "piece", "stretches")
    full = decoded(spark, sf_dir)
    full = full.withColumn("starts", rc.word_starts(full)).select("file", "piece", "starts")
    joined = both.join(full, ["file", "piece"])
    return joined.select("file", "piece", rc.count_within(F.col("starts"), F.col("stretches")).cast("long").alias("n"))


def _accept(spark, sf_dir):
    full = decoded(spark, sf_dir)
    again = full.withColumn("starts", rc.word_starts(full))
    again = again.withColumn("starts", F.when(F.col("file") % 5 == 0, F.slice("starts", 1, 9)).otherwise(F.col("starts")))
    out = rc.accept_redo(_first_pass(spark, sf_dir), again)
    return out.select("file", "piece", *[F.col(c).cast("long").alias(c) for c in ("skipped_words", "before", "after")], "accepted")


def _redo(spark, sf_dir):
    pieces = rc.untimed_stretches(_skipping(spark, sf_dir))
    out = pieces.withColumn("redo", rc.redo_windows(F.col("ws"), F.col("we"), F.col("stretches")))
    return out.select("file", "piece", F.posexplode("redo").alias("k", "g")).select(
        "file", "piece", F.col("k").cast("long").alias("k"), "g.s", "g.e"
    )


def _near_cut(spark, sf_dir):
    pieces = decoded(spark, sf_dir)
    near = rc.words_near_cut(rc.spoken_words(pieces), F.col("re"))
    return pieces.withColumn("near", near).select("file", "piece", F.explode("near").alias("w")).select(
        "file", "piece", "w.first", "w.last", "w.key"
    )


def _asked(spark, sf_dir):
    """The last word of each piece, against what the next piece heard."""
    pieces = decoded(spark, sf_dir)
    pieces = pinned(pieces, spoken=rc.spoken_words(pieces))
    nxt = pieces.select("file", (F.col("piece") - 1).alias("piece"), F.col("spoken").alias("other"))
    return pieces.join(nxt, ["file", "piece"]).select(
        "file", "piece", F.element_at("spoken", -1)["word"].alias("word"), F.element_at("spoken", -1)["first"].alias("at"),
        F.element_at("spoken", -2)["word"].alias("before"), F.col("other").alias("spoken"),
    )


def _fuzzy(spark, sf_dir):
    return rc.fuzzy_heard(_asked(spark, sf_dir)).select("file", "piece", "heard")


def _spoken_at(spark, sf_dir):
    return _asked(spark, sf_dir).select(
        "file", "piece", rc.spoken_at(F.col("spoken"), F.col("at"), F.col("before")).alias("spoken")
    )


def _made_up(spark, sf_dir):
    """Each piece ending at its last word, which one or both of two more decodes miss."""
    pieces = decoded(spark, sf_dir)
    pieces = pinned(pieces, spoken=rc.spoken_words(pieces)).where(F.size("spoken") > 0)
    missed = F.slice("spoken", F.lit(1), F.size("spoken") - 1)
    again = F.array(missed, F.when(F.col("file") % 3 == 0, F.col("spoken")).otherwise(missed))
    asked = pieces.withColumn("again", again).withColumn("we", F.element_at("spoken", -1)["first"] + 8000)
    asked = asked.withColumn("begin", F.col("ws")).withColumn("levels", F.array_repeat(F.lit(1.0), 100))
    return rc.drop_made_up_endings(asked).select("file", "piece", F.col("dropped").cast("long").alias("dropped"), F.size("tokens").cast("long").alias("kept"))


def _endings(spark, sf_dir):
    pieces = decoded(spark, sf_dir)
    levels = F.transform(
        F.sequence(F.lit(0), (F.floor((F.col("we") - F.col("ws")) / 320) - 1).cast("int")),
        lambda f: F.when(
            f >= F.floor((F.col("we") - F.col("ws")) / 320) - 3 - F.col("file") % 5, F.lit(0.01)
        ).otherwise(0.5 + (f % 10) / 20.0),
    )
    asked = pieces.withColumn("starts", rc.word_starts(pieces)).withColumn("levels", levels)
    asked = asked.withColumn("starts", F.transform("starts", lambda s: s + F.when(F.col("file") % 3 == 0, 2000).otherwise(0)))
    return rc.select_endings(asked).select("file", "piece", "begin", F.round("top", 6).alias("top"))


QUERIES = [
    Query(
        "match_sequences", _matches,
        with_views(
            """SELECT a.file, a.piece, (SELECT count(*) FROM paired p WHERE p.file = a.file AND p.piece = a.piece) AS matched
               FROM pcs a JOIN pcs b ON b.file = a.file AND b.piece = a.piece + 1""",
            DECODED_SQL, _PAIRED_SQL,
        ),
    ),
    Query(
        "seam", _seams,
        with_views(
            """SELECT file, piece, coalesce(max(lk) FILTER (WHERE early) + 1, 0)::INT AS left_first, coalesce(min(lk) FILTER (WHERE NOT early), 1073741824)::INT AS left_stop,
                 coalesce(max(rk) FILTER (WHERE early) + 1, 0)::INT AS right_first, coalesce(min(rk) FILTER (WHERE NOT early), 1073741824)::INT AS right_stop
               FROM (SELECT *, greatest(lt, rt) < re / 16000::DOUBLE AS early, least(1::DOUBLE, (re - rs) / 32000::DOUBLE, (nre - re) / 32000::DOUBLE) AS reach FROM paired WHERE nrs = re AND NOT (we = re AND nws = re))
               WHERE abs(lt - re / 16000::DOUBLE) <= reach AND abs(rt - re / 16000::DOUBLE) <= reach GROUP BY file, piece""",
            DECODED_SQL, _PAIRED_SQL,
        ),
    ),
    Query(
        "trim_overlaps", _trim,
        with_views(
            r"""SELECT file, regexp_replace(string_agg(word, ' ' ORDER BY i), '\s([^\p{L}\p{N}_''])', '\1', 'g') AS text FROM tw GROUP BY file""", DECODED_SQL
        ),
    ),
    Query(
        "flatten_and_regroup", _regroup,
        with_views(
            "SELECT file, count(*) AS pieces, max(piece) AS last, CASE WHEN file % 10 = 3 THEN count(*) - 1 END AS results FROM pcs GROUP BY file", DECODED_SQL
        ),
    ),
    Query("untimed_stretches", _untimed, with_views("SELECT * FROM st", DECODED_SQL, _SKIP_SQL, _STRETCH_SQL)),
    Query(
        "stalled_stretches", _stalled,
        with_views(
            """SELECT st.file, st.piece, st.s, st.e, CAST(sum(least(st.e, sp.e) - greatest(st.s, sp.s)) AS BIGINT) AS overlap
               FROM st JOIN (SELECT file, k * 51200 AS s, k * 51200 + 44800 AS e FROM (SELECT file, unnest(range((len(ws) + 3) // 4)) AS k FROM turn_lists)) sp
                 ON sp.file = st.file AND sp.s < st.e AND st.s < sp.e GROUP BY ALL HAVING overlap >= 48000""",
            DECODED_SQL, _SKIP_SQL, _STRETCH_SQL,
        ),
    ),
    Query(
        "words_in_stretches", _in_stretches,
        with_views(
            """SELECT p.file, p.piece, count(d.pt) AS n FROM pcs p LEFT JOIN st USING (file, piece)
               LEFT JOIN dec d ON d.file = p.file AND d.piece = p.piece AND d.pt >= st.s AND d.pt < st.e GROUP BY ALL""",
            DECODED_SQL, _SKIP_SQL, _STRETCH_SQL,
        ),
    ),
    Query(
        "accept_redo", _accept,
        with_views(
            """SELECT *, skipped_words >= 2 AND after >= before AS accepted FROM (
                 SELECT p.file, p.piece,
                   (SELECT count(*) FROM st JOIN rd d USING (file, piece) WHERE st.file = p.file AND st.piece = p.piece AND d.pt >= st.s AND d.pt < st.e - 5120) AS skipped_words,
                   (SELECT count(*) FROM skp d WHERE d.file = p.file AND d.piece = p.piece AND d.pt >= p.rs AND d.pt < p.re) AS before,
                   (SELECT count(*) FROM rd d WHERE d.file = p.file AND d.piece = p.piece AND d.pt >= p.rs AND d.pt < p.re) AS after FROM pcs p)""",
            DECODED_SQL, _SKIP_SQL, _STRETCH_SQL, "rd AS (SELECT * FROM dec WHERE file % 5 <> 0 OR k < 9)",
        ),
    ),
    Query(
        "redo_windows", _redo,
        with_views("SELECT file, piece, row_number() OVER (PARTITION BY file, piece ORDER BY s) - 1 AS k, a AS s, b AS e FROM rw", DECODED_SQL, _SKIP_SQL, _STRETCH_SQL, _WINDOW_SQL),
    ),
    Query(
        "words_near_cut", _near_cut,
        with_views(
            r"SELECT file, piece, pt AS first, pt AS last, replace(lower(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')), 'ß', 'ss') AS key FROM dec WHERE abs(pt - re) <= 16000",
            DECODED_SQL,
        ),
    ),
    Query("fuzzy_heard", _fuzzy),
    Query(
        "spoken_at", _spoken_at,
        with_views(
            r"""SELECT a.file, a.piece, coalesce(bool_or(o.pt BETWEEN a.pt - 1600 AND a.pt + 2400 AND o.key <> b.key), FALSE) AS spoken
               FROM (SELECT *, replace(lower(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')), 'ß', 'ss') AS key, row_number() OVER (PARTITION BY file, piece ORDER BY i DESC) AS r FROM dec) a
               JOIN (SELECT file, piece, replace(lower(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')), 'ß', 'ss') AS key, row_number() OVER (PARTITION BY file, piece ORDER BY i DESC) AS r FROM dec) b
                 ON b.file = a.file AND b.piece = a.piece AND b.r = 2 AND a.r = 1
               JOIN (SELECT file, piece - 1 AS piece, pt, replace(lower(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')), 'ß', 'ss') AS key FROM dec) o
                 ON o.file = a.file AND o.piece = a.piece GROUP BY ALL""",
            DECODED_SQL,
        ),
    ),
    Query(
        "select_endings", _endings,
        with_views(
            """SELECT file, piece, any_value(begin) AS begin, round(quantile_cont(level, 0.95), 6) AS top
               FROM (SELECT file, piece, begin, f, n, CASE WHEN f >= n - 3 - file % 5 THEN 0.01::DOUBLE ELSE 0.5 + (f % 10) / 20::DOUBLE END AS level FROM (
                 SELECT *, (we - ws) // 320 AS n, unnest(range((begin - ws) // 320, (we - ws) // 320)) AS f FROM ends))
               GROUP BY file, piece HAVING count(*) >= 5 AND max(level) FILTER (WHERE f >= n - 5) <= quantile_cont(level, 0.95) * pow(10, -0.75)""",
            DECODED_SQL,
            """heard AS (SELECT file, piece, ws, we, list(x ORDER BY i) AS xs, count(*) FILTER (WHERE x < we - 12000) AS early
                 FROM (SELECT *, pt + CASE WHEN file % 3 = 0 THEN 2000 ELSE 0 END AS x FROM dec WHERE we = re) GROUP BY file, piece, ws, we),
               ends AS (SELECT *, greatest(ws, we - 256000, least(we - 128000, xs[greatest(early, 1)] - 16000)) AS begin FROM heard WHERE len(xs) >= 2 AND xs[len(xs)] >= we - 12000)""",
        ),
    ),
    Query("drop_made_up_endings", _made_up),
]
