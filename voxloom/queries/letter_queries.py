"""Spelling for an aligner, over the documents' words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from voxloom.functions import letters as lt
from voxloom.functions import text as tx
from voxloom.functions.arrays import at
from voxloom.plans import views
from voxloom.queries.base import Query, with_views

WORDS_SQL = r"""
dl AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM dl)"""
_NAMES_SQL = "nm AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in lt.NAMES.items()) + ") v(k, name))"

_CHARS = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c)]
# NFKC is NFC of the text with each such character written as what it is compatible to
_FOLD_SQL = "cf AS (SELECT MAP {" + ", ".join(f"'{c}': '{unicodedata.normalize('NFKD', c).replace("'", "''")}'" for c in _CHARS) + "} AS m)"
_NFKC_SQL = f"""nk AS (SELECT doc_id, CASE WHEN regexp_matches(word, '{lt.MAY_FOLD}')
              THEN nfc_normalize(array_to_string(list_transform(regexp_extract_all(word, '(?s).'), lambda c: coalesce(m[c], c)), '')) ELSE word END AS word FROM dw, cf)"""


def _words(spark, sf_dir):
    docs = views.spread_out(views.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", views.split_words(F.col("text")).alias("ws"))


def _counted(spark, sf_dir, said):
    # the outer form, since a filter on the array's size would split each text twice
    words = _words(spark, sf_dir).select("doc_id", F.explode_outer("ws").alias("word")).where(F.col("word").isNotNull())
    rows = words.withColumn("said", said(F.col("word")))
    return rows.groupBy("doc_id", "said").agg(F.count("*").alias("n"))


def _starts(spark, sf_dir):
    rows = _words(spark, sf_dir).select("doc_id", "ws", F.posexplode("ws").alias("i", "word"))
    opens = tx.is_sentence_start(at(F.col("ws"), F.col("i") - 1))
    return rows.withColumn("o", opens).where("o").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.col("i").cast("long")).alias("places"),
        F.count_if(tx.capitalise(F.col("word")) == F.col("word")).alias("capital"),
    )


def _other(spark, sf_dir):
    """Every seventh document's words written in another alphabet."""
    rows = _words(spark, sf_dir).select(F.col("doc_id").alias("chunk"), F.explode("ws").alias("word"))
    swapped = rows.withColumn("word", F.when(F.col("chunk") % 7 == 0, F.translate("word", "aeiourstln", "аеиоурстлн")).otherwise(F.col("word")))
    return lt.filter_other_alphabet(swapped.withColumn("said", lt.english_letters(F.col("word"))))


def _accents(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("PLAN "), F.when(F.col("p_partkey") % 3 == 0, "ZEE").when(F.col("p_partkey") % 3 == 1, "aych").otherwise("BEE")).alias("said")
    )
    return parts.select("id", F.explode(lt.accent_variants(F.col("said"))).alias("said"))


QUERIES = [
    Query(
        "align_letters_english", lambda s, d: _counted(s, d, lt.english_letters),
        with_views(
            r"""SELECT doc_id, said, count(*) AS n FROM (
                  SELECT doc_id, i, coalesce(string_agg(coalesce(nm.name, tk), ' ' ORDER BY p), '') AS said FROM (
                    SELECT doc_id, i, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS tk, unnest(range(greatest(len(ts), 1))) AS p FROM (
                      SELECT doc_id, i, list_filter(regexp_split_to_array(strip_accents(upper(replace(replace(replace(replace(replace(replace(word, '%', ' PERCENT'), '&', ' AND '), '+', ' PLUS '), '@', ' AT '), '-', ' '), 'ß', 'SS'))), '\s+'), lambda t: t <> '') AS ts FROM dw))
                  LEFT JOIN nm ON nm.k = trim(tk, '.,!?;:"''()') GROUP BY doc_id, i) GROUP BY ALL""",
            WORDS_SQL, _NAMES_SQL,
        ),
    ),
    Query(
        "align_letters_any", lambda s, d: _counted(s, d, lt.any_letters),
        with_views(
            r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(translate(word, '’‘ʼ', ''''''''), '[^\p{L}\p{M}''\-]', ' ', 'g'), '\s+'),
                  lambda p: trim(p, '''-')), lambda p: p <> ''), ' ') AS said, count(*) AS n FROM nk GROUP BY ALL""",
            WORDS_SQL, _FOLD_SQL, _NFKC_SQL,
        ),
    ),
    Query(
        "sentence_start", _starts,
        with_views(
            r"""SELECT doc_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS places, count(*) FILTER (WHERE l = '' OR upper(l) = l) AS capital FROM (
                  SELECT doc_id, i, regexp_extract(word, '\p{L}') AS l, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS pw FROM dw)
                WHERE pw IS NULL OR (regexp_matches(pw, '[.!?]["'')\]”’]*$') AND regexp_replace(lower(pw), '^["''(\[“‘]+', '') NOT IN ("""
            + ", ".join(f"'{a}'" for a in tx.ABBREVIATIONS) + ")) GROUP BY doc_id",
            WORDS_SQL,
        ),
    ),
    Query(
        "filter_other_alphabet", _other,
        with_views(
            r"""SELECT doc_id AS chunk, 2 * count(*) FILTER (WHERE regexp_matches(w, '\p{L}') AND NOT regexp_matches(strip_accents(upper(replace(replace(w, '-', ' '), 'ß', 'SS'))), '[A-Z]')
                  AND NOT regexp_matches(w, '[%&+@]'))
                  > count(*) FILTER (WHERE regexp_matches(w, '\p{L}')) AS other
                FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN translate(word, 'aeiourstln', 'аеиоурстлн') ELSE word END AS w FROM dw) GROUP BY doc_id""",
            WORDS_SQL,
        ),
    ),
    Query(
        "accent_variants", _accents,
        """SELECT p_partkey AS id, 'PLAN ' || CASE p_partkey % 3 WHEN 0 THEN 'ZEE' WHEN 1 THEN 'aych' ELSE 'BEE' END AS said FROM part
           UNION ALL SELECT p_partkey, 'PLAN ' || CASE p_partkey % 3 WHEN 0 THEN 'ZED' ELSE 'haych' END FROM part WHERE p_partkey % 3 < 2""",
    ),
]
