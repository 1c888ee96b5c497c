"""Tokens to words, segments and documents, over the conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import text as tx
from voxloom.functions import tokens as tk
from voxloom.functions.arrays import unroll
from voxloom.operators import words as wd
from voxloom.operators.retime import retime_words
from voxloom.plans import views
from voxloom.queries.base import Query, with_views
from voxloom.sources import sinks

W = r"[^\p{L}\p{N}_]"


def _six(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _glued(spark, sf_dir):
    """Document text with markers put in, and a price glued to each line's start."""
    return views.spread_out(views.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.replace(F.replace("text", F.lit(" "), F.lit("▁ ")), F.lit("\n"), F.lit("$5 x£1.10 \n")).alias("text")
    )


def _clean_text(spark, sf_dir):
    return _glued(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


_CLEAN_SQL = r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, '▁', ' '), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'),
       '[\s\p{Z}]+', ' ', 'g'), '(\p{L})([$£€])', '\1 \2', 'g') AS text
FROM (SELECT doc_id, replace(replace(text, ' ', '▁ '), chr(10), '$5 x£1.10 ' || chr(10)) AS t FROM documents)"""


def _decode_tokens(spark, sf_dir):
    results = views.token_rows(spark, sf_dir)
    return results.select("file", "piece", tx.decode_tokens(F.col("tokens")).alias("text"))


def _bad_times(results):
    return results.withColumn(
        "timestamps",
        F.transform(
            "timestamps",
            lambda t, i: F.when(i % 7 == 3, F.lit(float("nan")))
            .when(i % 11 == 5, F.lit(-1.0))
            .when(i % 13 == 7, F.lit(None).cast("double"))
            .when(i % 17 == 0, F.lit(float("inf")))
            .otherwise(t),
        ),
    )


def _repair(spark, sf_dir):
    results = _bad_times(views.token_rows(spark, sf_dir))
    return unroll(results, ["file", "piece"], tk.repair_timestamps(F.col("tokens"), F.col("timestamps")), "pos", "t")


def _scan_results(spark, sf_dir):
    results = wd.extract(_bad_times(views.token_rows(spark, sf_dir)))
    return results.select(
        "file", "piece", "text", F.size("tokens").alias("n_tokens"),
        F.round(F.aggregate("timestamps", F.lit(0.0), lambda a, t: a + t), 4).alias("sum_t"),
    )


_GOOD_SQL = """
good AS (SELECT *, coalesce(last_value(CASE WHEN pos % 7 = 3 OR pos % 11 = 5 OR pos % 13 = 7 OR pos % 17 = 0 THEN NULL ELSE t END IGNORE NULLS)
         OVER (PARTITION BY file, piece ORDER BY pos ROWS UNBOUNDED PRECEDING), 0.0) AS gt FROM tok)"""


def _seam_key(spark, sf_dir):
    docs = views.dealt_by(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", F.explode(views.split_words(F.col("text"))).alias("word"))
    return words.groupBy("doc_id", tx.seam_key(F.col("word")).alias("k")).agg(F.count("*").alias("n"))


def _group(spark, sf_dir):
    return wd.group_tokens_to_words(views.token_rows(spark, sf_dir)).withColumn("w", F.col("w").cast("long"))


def _word_bounds(spark, sf_dir):
    words = wd.word_bounds(views.token_rows(spark, sf_dir))
    return words.select("file", "piece", F.col("w").cast("long").alias("w"), "word", *_six("start", "end"))


def _segments(spark, sf_dir):
    return wd.segment_bounds(views.token_rows(spark, sf_dir))


def _segment_bounds(spark, sf_dir):
    return _segments(spark, sf_dir).select("file", "piece", *_six("start", "end"), "text")


_SEGMENTS_SQL = r"""
heard AS (
  SELECT file, piece, any_value(chunk_start) AS cs, any_value(chunk_end) AS ce, min_by(t, pos) AS t0, max_by(t, pos) AS t1,
         string_agg(replace(tok, '▁', ' '), '' ORDER BY pos) AS raw
  FROM tok GROUP BY file, piece),
seg AS (
  SELECT file, piece, start, least(greatest(start, ce), greatest(start, cs + t1 + 0.32)) AS "end", text
  FROM (SELECT *, least(ce, greatest(cs, cs + t0)) AS start,
               regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '\s([^\p{L}\p{N}_''])', '\1', 'g'), '\s([^\p{L}\p{N}_''])', '\1', 'g'),
               '\s+', ' ', 'g'), '(\p{L})([$£€])', '\1 \2', 'g') AS text FROM heard)
  WHERE text <> '')"""


def _moved(words):
    """Words moved as an aligner might: an odd one 0.5 s later, an even one 0.4 s sooner."""
    return F.transform(
        words,
        lambda w, i: F.struct(
            w["word"].alias("word"),
            (w["start"] + F.when(i % 2 == 0, -0.4).otherwise(0.5)).alias("start"),
            (w["end"] + F.when(i % 2 == 0, -0.4).otherwise(0.5)).alias("end"),
        ),
    )


def _cover(spark, sf_dir):
    pieces = wd.piece_words(views.token_rows(spark, sf_dir)).withColumn("words", _moved(F.col("words")))
    covered = wd.cover(F.col("segment"), F.col("words"))
    return pieces.where(F.col("segment").isNotNull()).select("file", "piece", covered.alias("c")).select(
        "file", "piece", F.round("c.start", 6).alias("start"), F.round("c.end", 6).alias("end")
    )


def _spread(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file"), F.col("turn").alias("piece"), views.split_words(F.col("text")).alias("ws")
    )
    shared = tk.spread(F.col("ws"), F.col("piece") * 60.0, F.col("piece") * 60.0 + F.size("ws") * 0.3)
    return unroll(turns, ["file", "piece"], shared, "i", "p").select(
        "file", "piece", F.col("i").cast("long").alias("i"), F.col("p.word").alias("word"),
        F.floor(F.col("p.start") * 1000 + 0.501).alias("start"), F.floor(F.col("p.end") * 1000 + 0.501).alias("end"),
    )


def _stitch(spark, sf_dir):
    whole = wd.stitch_transcript(wd.piece_words(views.token_rows(spark, sf_dir)))
    return whole.select(
        "file", "text", F.size("segments").cast("long").alias("n_segments"), F.size("words").cast("long").alias("n_words"),
        F.round(F.get("words", F.size("words") - 1)["end"], 6).alias("last_end"),
    )


def _retime(spark, sf_dir):
    """Turn words against a pause over the last third of every fifth word."""
    pieces = wd.piece_words(views.token_rows(spark, sf_dir)).where(F.size("words") > 0)
    gaps = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 5).cast("int")),
        lambda k: F.struct((F.col("chunk_start") + k * 4.0 + 0.5).alias("s"), (F.col("chunk_start") + k * 4.0 + 0.9).alias("e")),
    )
    inside = F.filter(gaps, lambda g: g["e"] <= F.col("chunk_end"))
    moved = retime_words(F.col("words"), inside, F.col("chunk_start"), F.col("chunk_end"))
    return unroll(pieces, ["file", "piece"], moved, "w", "m").select(
        "file", "piece", "w", F.round("m.start", 6).alias("start"), F.round("m.end", 6).alias("end")
    )


def _text_sink(spark, sf_dir):
    return sinks.text_documents(_segments(spark, sf_dir))


def _srt_sink(spark, sf_dir):
    return sinks.srt_documents(_segments(spark, sf_dir))


def _vtt_sink(spark, sf_dir):
    return sinks.vtt_documents(_segments(spark, sf_dir))


def _rounded(array, names):
    return F.transform(
        array,
        lambda s: F.struct(*[(F.round(s[n], 3) if n in ("start", "end") else s[n]).alias(n) for n in names]),
    )


def _verbose_sink(spark, sf_dir):
    whole = wd.stitch_transcript(wd.piece_words(views.token_rows(spark, sf_dir))).select(
        "file", "text", F.lit("en").alias("language"), (F.size("segments") * 60.0).alias("duration"),
        _rounded(F.col("segments"), ("start", "end", "text")).alias("segments"),
        _rounded(F.col("words"), ("word", "start", "end")).alias("words"),
    )
    return sinks.verbose_json_documents(whole, with_words=True)


def _alignment_sink(spark, sf_dir):
    pieces = wd.piece_words(views.token_rows(spark, sf_dir))
    scored = F.transform(
        F.col("words"),
        lambda w, i: F.struct(
            w["word"].alias("word"),
            F.when(i % 9 != 4, F.round(w["start"], 3)).alias("start"),
            F.when(i % 9 != 4, F.round(w["end"], 3)).alias("end"),
            F.when(i % 9 != 4, (i % 8) / F.lit(8.0)).alias("score"),
        ),
    )
    aligned = pieces.select(
        F.concat_ws("-", "file", "piece").alias("file"), F.lit("letters").alias("aligner"), F.lit("en").alias("language"),
        (F.col("chunk_start") + 30.0).alias("duration"), scored.alias("words"),
    )
    return sinks.alignment_documents(aligned)


def _batch_sink(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return sinks.batch_documents(
        turns.select(
            F.col("conv_id").alias("batch"), F.col("turn").alias("ord"),
            F.concat(F.lit("turn-"), F.col("turn"), F.lit(".wav")).alias("filename"),
            tx.clean_text(F.col("text")).alias("text"), (F.col("turn") * 60.0 + 60.0).alias("duration"),
        )
    )


def _srt_sql(sep: str, numbered: bool) -> str:
    def stamp(c):
        ms = f"CAST(round_even({c} * 1000, 0) AS BIGINT)"
        return f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"

    cue = f"{stamp('start')} || ' --> ' || {stamp(chr(34) + 'end' + chr(34))} || chr(10) || text || chr(10)"
    if numbered:
        cue = "CAST(n AS VARCHAR) || chr(10) || " + cue
    head = "" if numbered else "'WEBVTT' || chr(10) || chr(10) || "
    return (
        f"SELECT file, {head}string_agg({cue}, chr(10) ORDER BY piece) AS value FROM "
        "(SELECT *, row_number() OVER (PARTITION BY file ORDER BY piece) AS n FROM seg) GROUP BY file"
    )


QUERIES = [
    Query("clean_text", _clean_text, _CLEAN_SQL),
    Query(
        "decode_tokens",
        _decode_tokens,
        with_views(
            r"""SELECT file, piece, regexp_replace(regexp_replace(regexp_replace(raw, '^\s', ''), '\s([^\p{L}\p{N}_''])', '\1', 'g'), '\s([^\p{L}\p{N}_''])', '\1', 'g') AS text
               FROM (SELECT file, piece, string_agg(replace(tok, '▁', ' '), '' ORDER BY pos) AS raw FROM tok GROUP BY ALL)""",
            views.TOKENS_SQL,
        ),
    ),
    Query("repair_timestamps", _repair, with_views("SELECT file, piece, pos, gt AS t FROM good", views.TOKENS_SQL, _GOOD_SQL)),
    Query(
        "scan_asr_results",
        _scan_results,
        with_views(
            "SELECT s.file, s.piece, s.text, count(*) AS n_tokens, round(sum(gt ORDER BY pos), 4) AS sum_t FROM good JOIN seg s USING (file, piece) GROUP BY ALL",
            views.TOKENS_SQL,
            _GOOD_SQL,
            _SEGMENTS_SQL,
        ),
    ),
    Query(
        "seam_key",
        _seam_key,
        with_views(
            f"""SELECT doc_id, replace(lower(regexp_replace(word, '{W}', '', 'g')), 'ß', 'ss') AS k, count(*) AS n
                FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM documents)
                WHERE word <> '' GROUP BY ALL"""
        ),
    ),
    Query(
        "group_tokens_to_words",
        _group,
        with_views("SELECT file, piece, w, word, first, last FROM wd", views.TOKENS_SQL),
    ),
    Query(
        "word_bounds",
        _word_bounds,
        with_views('SELECT file, piece, w, word, round(start, 6) AS start, round("end", 6) AS "end" FROM timed', views.TOKENS_SQL),
    ),
    Query(
        "segment_bounds",
        _segment_bounds,
        with_views('SELECT file, piece, round(start, 6) AS start, round("end", 6) AS "end", text FROM seg', views.TOKENS_SQL, _SEGMENTS_SQL),
    ),
    Query(
        "cover_segments",
        _cover,
        with_views(
            """SELECT s.file, s.piece, round(least(s.start, min_by(m.start, w)), 6) AS start, round(greatest(s."end", max_by(m."end", w)), 6) AS "end"
               FROM seg s JOIN (SELECT file, piece, w, start + CASE WHEN w % 2 = 0 THEN -0.4 ELSE 0.5 END AS start,
                                       "end" + CASE WHEN w % 2 = 0 THEN -0.4 ELSE 0.5 END AS "end" FROM timed) m USING (file, piece)
               GROUP BY s.file, s.piece, s.start, s."end" """,
            views.TOKENS_SQL,
            _SEGMENTS_SQL,
        ),
    ),
    Query(
        "spread_by_length",
        _spread,
        with_views(
            """SELECT file, piece, i, word, CAST(floor((piece * 60.0 + 0.3 * n * (upto - length(word)) / total) * 1000 + 0.501) AS BIGINT) AS start,
                      CAST(floor((piece * 60.0 + 0.3 * n * upto / total) * 1000 + 0.501) AS BIGINT) AS "end"
               FROM (SELECT *, sum(length(word)) OVER (PARTITION BY file, piece ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto,
                            sum(length(word)) OVER (PARTITION BY file, piece) AS total, count(*) OVER (PARTITION BY file, piece) AS n FROM turn_words)""",
            views.TOKENS_SQL,
        ),
    ),
    Query(
        "stitch_transcript",
        _stitch,
        with_views(
            """SELECT file, text, n_segments, n_words, last_end FROM
               (SELECT file, string_agg(text, ' ' ORDER BY piece) AS text, count(*) AS n_segments FROM seg GROUP BY file)
               JOIN (SELECT file, count(*) AS n_words, round(max_by("end", piece * 100000 + w), 6) AS last_end FROM timed GROUP BY file) USING (file)""",
            views.TOKENS_SQL,
            _SEGMENTS_SQL,
        ),
    ),
    Query("retime_words", _retime),
    Query("sink_text", _text_sink, with_views("SELECT file, string_agg(text, ' ' ORDER BY piece) AS value FROM seg GROUP BY file", views.TOKENS_SQL, _SEGMENTS_SQL)),
    Query("sink_srt", _srt_sink, with_views(_srt_sql(",", True), views.TOKENS_SQL, _SEGMENTS_SQL)),
    Query("sink_vtt", _vtt_sink, with_views(_srt_sql(".", False), views.TOKENS_SQL, _SEGMENTS_SQL)),
    Query(
        "sink_verbose_json",
        _verbose_sink,
        with_views(
            """SELECT file, CAST(to_json({'task': 'transcribe', 'language': 'en', 'duration': CAST(n AS DOUBLE) * 60, 'text': text,
                 'segments': segments, 'words': words}) AS VARCHAR) AS value FROM
               (SELECT file, count(*) AS n, string_agg(text, ' ' ORDER BY piece) AS text,
                  list({'id': id, 'seek': 0, 'start': round(start, 3), 'end': round("end", 3), 'text': text, 'tokens': CAST([] AS INTEGER[]),
                        'temperature': CAST(0 AS DOUBLE), 'avg_logprob': CAST(0 AS DOUBLE), 'compression_ratio': CAST(0 AS DOUBLE),
                        'no_speech_prob': CAST(0 AS DOUBLE)} ORDER BY piece) AS segments
                FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY piece) - 1 AS id FROM seg) GROUP BY file)
               JOIN (SELECT file, list({'start': round(start, 3), 'end': round("end", 3), 'word': word} ORDER BY piece, w) AS words
                     FROM timed GROUP BY file) USING (file)""",
            views.TOKENS_SQL,
            _SEGMENTS_SQL,
        ),
    ),
    Query(
        "sink_alignment_json",
        _alignment_sink,
        with_views(
            """SELECT CAST(file AS VARCHAR) || '-' || CAST(piece AS VARCHAR) AS file, CAST(to_json({'aligner': 'letters', 'language': 'en',
                 'duration': CAST(piece * 60 + 30 AS DOUBLE), 'words': list({'word': word,
                   'start': CASE WHEN w % 9 <> 4 THEN least(CAST(piece * 60 + 30 AS DOUBLE), round(start, 3)) END,
                   'end': CASE WHEN w % 9 <> 4 THEN least(CAST(piece * 60 + 30 AS DOUBLE), round("end", 3)) END,
                   'score': CASE WHEN w % 9 <> 4 THEN CAST(w % 8 AS DOUBLE) / 8 END} ORDER BY w)}) AS VARCHAR) AS value
               FROM timed GROUP BY file, piece""",
            views.TOKENS_SQL,
        ),
    ),
    Query(
        "sink_batch_json",
        _batch_sink,
        r"""SELECT conv_id AS batch, CAST(to_json({'batch_size': count(*), 'results': list({'filename': 'turn-' || turn || '.wav',
              'text': regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '(\p{L})([$£€])', '\1 \2', 'g'),
              'duration': CAST(turn * 60 + 60 AS DOUBLE)} ORDER BY turn)}) AS VARCHAR) AS value FROM conversations GROUP BY conv_id""",
    ),
]
