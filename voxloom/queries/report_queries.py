"""Run summaries over line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import reports
from voxloom.plans import views
from voxloom.queries.base import Query, with_views


def _runs(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("run"),
        F.col("l_quantity").alias("duration"), (F.col("l_extendedprice") / 7000).alias("secs"),
    )


BENCH_SQL = "bench AS (SELECT l_orderkey AS file, l_linenumber AS run, l_quantity AS duration, l_extendedprice / 7000 AS secs FROM lineitem)"
_PER_FILE = """
per_file AS (SELECT file, count(*) AS runs, max(duration) AS duration, avg(secs) AS avg_secs, min(secs) AS min_secs, max(secs) AS max_secs,
  coalesce(stddev_samp(secs), 0) AS std_secs, avg(secs / duration) AS avg_rtf, avg(CASE WHEN secs > 0 THEN duration / secs ELSE 0 END) AS avg_speedup
  FROM bench GROUP BY file)"""
_MEASURES = ("avg_secs", "min_secs", "max_secs", "std_secs", "avg_rtf", "avg_speedup")


def _summary(spark, sf_dir):
    per_file = reports.runtime_summary(_runs(spark, sf_dir))
    return per_file.select("file", "runs", "duration", *[F.round(m, 10).alias(m) for m in _MEASURES])


def _overall(spark, sf_dir):
    whole = reports.overall_summary(reports.runtime_summary(_runs(spark, sf_dir)))
    return whole.select("files", *[F.round(c, 4).alias(c) for c in whole.columns if c != "files"])


def _select(spark, sf_dir):
    files = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"), F.col("o_totalprice").alias("size"), (F.col("o_totalprice") / 1000).alias("duration")
    )
    return reports.select_bench_files(files, 50, longest=6.0).select("file", "size")


def _timings(spark, sf_dir):
    jobs = views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_suppkey") % 5).alias("model"), F.col("l_quantity").alias("duration"),
        F.col("l_linenumber").cast("long").alias("chunks"), (F.col("l_tax") * 100).alias("decode_ms"),
        (F.col("l_discount") * 1000).alias("infer_ms"), (F.col("l_tax") * 100 + F.col("l_discount") * 1000).alias("total_ms"),
    )
    out = reports.stage_timings(jobs)
    return out.select("model", "jobs", "chunks", "audio", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_ms")])


def _cards(spark, sf_dir):
    suppliers = views.table(spark, sf_dir, "supplier").join(
        views.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    variants = suppliers.select(
        F.concat(F.lit("model-"), F.col("n_regionkey")).alias("name"), F.lit("org").alias("author"),
        F.col("n_name").alias("language"), F.concat(F.lit("q"), F.col("s_suppkey") % 4).alias("quantization"),
    )
    cards = reports.catalogue_cards(variants)
    return cards.select("name", "author", F.array_join("languages", ",").alias("languages"), F.array_join("quantizations", ",").alias("quantizations"))


def _forced_cuts(spark, sf_dir):
    """Pieces of 5000 s over each user's span; intervals as speech, errors as words."""
    spans = views.intervals(spark, sf_dir).withColumnRenamed("key", "file")
    size = spans.groupBy("file").agg(F.min("s").alias("a"), F.max("e").alias("b"))
    k = size.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a") - 1) / 5000))))
    pieces = k.select("file", (F.col("a") + F.col("k") * 5000).alias("rs"), (F.col("a") + F.col("k") * 5000 + 5000).alias("re"))
    words = spans.where(F.col("kind") == "error").select("file", "s", "e")
    return reports.forced_cut_report(pieces, spans.select("file", "s", "e"), words, deep=600, bin_size=3600)


QUERIES = [
    Query(
        "forced_cut_report", _forced_cuts,
        with_views(
            """SELECT p.file, p.pieces, coalesce(c.in_speech, 0) AS in_speech, coalesce(c.in_word, 0) AS in_word, coalesce(c.deep, 0) AS deep
               FROM (SELECT file, count(*) AS pieces FROM pieces GROUP BY file) p LEFT JOIN (
                 SELECT file, count(*) AS in_speech, count(*) FILTER (WHERE depth IS NOT NULL) AS in_word, count(*) FILTER (WHERE depth > 600) AS deep FROM (
                   SELECT c.file, c.re, max(CASE WHEN iv.kind = 'error' THEN least(c.re - iv.s, iv.e - c.re) END) AS depth
                   FROM (SELECT * FROM pieces WHERE last = 0) c JOIN iv ON iv.key = c.file AND iv.s < c.re AND c.re < iv.e GROUP BY c.file, c.re) GROUP BY file) c USING (file)""",
            views.INTERVALS_SQL,
            """pieces AS (SELECT key AS file, a + k * 5000 + 5000 AS re, CASE WHEN k = (b - a - 1) // 5000 THEN 1 ELSE 0 END AS last
                 FROM (SELECT *, unnest(range((b - a - 1) // 5000 + 1)) AS k FROM (SELECT key, min(s) AS a, max(e) AS b FROM iv GROUP BY key)))""",
        ),
    ),
    Query(
        "runtime_summary", _summary,
        with_views("SELECT file, runs, duration, " + ", ".join(f"round({m}, 10) AS {m}" for m in _MEASURES) + " FROM per_file", BENCH_SQL, _PER_FILE),
    ),
    Query(
        "overall_summary", _overall,
        with_views(
            """SELECT count(*) AS files, round(avg(avg_secs), 4) AS avg_secs, round(avg(avg_rtf), 4) AS avg_rtf, round(avg(avg_speedup), 4) AS avg_speedup,
                 round(sum(duration), 4) AS total_audio, round(sum(avg_secs * runs), 4) AS total_secs FROM per_file""",
            BENCH_SQL, _PER_FILE,
        ),
    ),
    Query(
        "select_bench_files", _select,
        """SELECT o_orderkey AS file, o_totalprice AS size FROM orders
           ORDER BY o_totalprice / 1000 BETWEEN 5 AND 6 DESC, o_totalprice, o_orderkey LIMIT 50""",
    ),
    Query(
        "stage_timings", _timings,
        """SELECT 'm' || CAST(l_suppkey % 5 AS VARCHAR) AS model, count(*) AS jobs, CAST(sum(l_linenumber) AS BIGINT) AS chunks, sum(l_quantity) AS audio,
             round(avg(l_tax * 100), 6) AS avg_decode_ms, round(avg(l_discount * 1000), 6) AS avg_infer_ms, round(avg(l_tax * 100 + l_discount * 1000), 6) AS avg_total_ms,
             round(max(l_tax * 100), 6) AS max_decode_ms, round(max(l_discount * 1000), 6) AS max_infer_ms, round(max(l_tax * 100 + l_discount * 1000), 6) AS max_total_ms
           FROM lineitem GROUP BY 1""",
    ),
    Query(
        "catalogue_cards", _cards,
        """SELECT 'model-' || n_regionkey AS name, 'org' AS author, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS languages,
             string_agg(DISTINCT 'q' || CAST(s_suppkey % 4 AS VARCHAR), ',' ORDER BY 'q' || CAST(s_suppkey % 4 AS VARCHAR)) AS quantizations
           FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    ),
]
