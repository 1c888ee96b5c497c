"""Requests, catalogue checks and batches, over orders, parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import batching, requests as rq
from voxloom.plans import views
from voxloom.queries.base import Query, with_views

# Suppliers stand in for models: name S<key>, quantizations by key, languages by nation.
MODELS_SQL = """
models AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey AS k,
  CASE WHEN s_suppkey % 3 = 0 THEN ['fp32'] WHEN s_suppkey % 3 = 1 THEN ['fp32', 'int8'] ELSE ['fp16', 'fp32', 'int8'] END AS quantizations,
  CASE WHEN s_suppkey % 4 = 0 THEN 'en' ELSE 'multi' END AS lang FROM supplier)"""

REQUESTS_SQL = """
req AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'Nobody' ELSE ' S' || CAST(o_custkey % 12 AS VARCHAR) END ||
    CASE o_orderkey % 5 WHEN 0 THEN ':INT8' WHEN 1 THEN ':' WHEN 2 THEN ':fp32' ELSE '' END AS model,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'fp32' ELSE 'int8' END AS quant,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'auto' WHEN 3 THEN 'en' WHEN 4 THEN 'de' WHEN 5 THEN 'EN' ELSE 'eng-x' END AS language
  FROM orders)"""


def _models(spark, sf_dir):
    k = F.col("s_suppkey")
    lists = (
        F.when(k % 3 == 0, F.array(F.lit("fp32")))
        .when(k % 3 == 1, F.array(F.lit("fp32"), F.lit("int8")))
        .otherwise(F.array(F.lit("fp16"), F.lit("fp32"), F.lit("int8")))
    )
    return views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k).alias("name"), k.alias("k"), lists.alias("quantizations"),
        F.when(k % 4 == 0, "en").otherwise("multi").alias("lang"),
    )


def _requests(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(o % 11 == 0, F.lit("Nobody")).otherwise(F.concat(F.lit(" S"), c % 12))
    suffix = F.when(o % 5 == 0, ":INT8").when(o % 5 == 1, ":").when(o % 5 == 2, ":fp32").otherwise("")
    return views.table(spark, sf_dir, "orders").select(
        o.alias("id"), F.concat(name, suffix).alias("model"),
        F.when(o % 3 == 1, "fp32").when(o % 3 == 2, "int8").alias("quant"),
        F.when(o % 7 == 1, "").when(o % 7 == 2, "auto").when(o % 7 == 3, "en").when(o % 7 == 4, "de")
        .when(o % 7 == 5, "EN").when(o % 7 == 6, "eng-x").alias("language"),
    )


_PARSED_SQL = """
parsed AS (SELECT id, language, lower(trim(split_part(model, ':', 1))) AS name, quant,
  CASE WHEN contains(model, ':') AND trim(split_part(model, ':', 2)) = '' THEN 'empty quantization'
       WHEN contains(model, ':') AND quant IS NOT NULL AND quant <> lower(trim(split_part(model, ':', 2))) THEN 'conflicting quantization' END AS reject,
  CASE WHEN contains(model, ':') THEN lower(trim(split_part(model, ':', 2))) ELSE quant END AS q FROM req)"""


def _parse(spark, sf_dir):
    return rq.parse_variant_key(_requests(spark, sf_dir)).select("id", "name", "quantization", "reject")


def _resolve(spark, sf_dir, default=None):
    entries = _models(spark, sf_dir).withColumn("default_quantization", F.element_at("quantizations", -1))
    parsed = rq.parse_variant_key(_requests(spark, sf_dir))
    return rq.resolve_names(parsed, entries, default_quantization=default).select("id", "name", "quantization", "reject")


def _resolve_sql(fallback):
    return with_views(
        f"""SELECT id, name, CASE WHEN why IS NULL THEN q2 END AS quantization, why AS reject FROM (
              SELECT *, CASE WHEN reject IS NOT NULL THEN reject WHEN k IS NULL THEN 'unknown name'
                             WHEN NOT list_contains(quantizations, q2) THEN 'unknown quantization' END AS why
              FROM (SELECT p.*, m.k, m.quantizations, coalesce(p.q, {fallback}) AS q2 FROM parsed p LEFT JOIN models m USING (name)))""",
        MODELS_SQL, REQUESTS_SQL, _PARSED_SQL,
    )


def _check_language(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", rq.valid_language(F.col("language")).alias("valid"))


def _bridge(spark, sf_dir):
    models = _models(spark, sf_dir)
    return models.select(
        F.col("name").alias("aligner"),
        F.explode(F.when(F.col("lang") == "en", F.array(F.lit("en"))).otherwise(F.array(F.lit("en"), F.lit("de")))).alias("language"),
    )


def _aligner_language(spark, sf_dir):
    asked = _requests(spark, sf_dir).withColumn("aligner", F.lower(F.trim(F.substring_index("model", ":", 1))))
    return rq.check_aligner_language(asked, _bridge(spark, sf_dir)).select("id", "covered")


def _options(spark, sf_dir):
    asked = _requests(spark, sf_dir).select(
        "id", F.lower(F.trim(F.substring_index("model", ":", 1))).alias("model"), "language",
        F.when(F.col("id") % 4 == 0, True).when(F.col("id") % 4 == 1, False).alias("retime_words"),
        F.when(F.col("id") % 6 == 0, True).alias("vad_filter"),
        F.when(F.col("id") % 2 == 0, True).alias("spoken_numbers"),
        F.when(F.col("id") % 9 == 0, "wide").alias("aligner"),
    )
    models = _models(spark, sf_dir).select(
        F.col("name").alias("model"),
        F.when(F.col("lang") == "en", F.array(F.lit("en"))).otherwise(F.array(F.lit("en"), F.lit("de"))).alias("languages"),
    )
    return rq.effective_options(asked, models, retime=True, numbers_aligner="letters").drop("model", "aligner")


def _bounds(spark, sf_dir):
    models = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("model"), (F.col("p_partkey") % 2 == 0).alias("timed"),
        (F.col("p_size") + 10).alias("chunk_target_sec"), (F.col("p_size") + 10 + F.col("p_partkey") % 20).alias("chunk_max_sec"),
    )
    return rq.chunk_bounds(models)


def _limits(spark, sf_dir):
    files = views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(F.floor(F.col("o_totalprice") * 200)).cast("long").alias("n_bytes"),
        (F.col("o_totalprice") / 50).alias("duration"), (F.col("o_orderkey") % 60).alias("chunks"),
    )
    return rq.enforce_limits(files, max_files=14).select("batch", "ord", "reject")


def _validate(spark, sf_dir):
    k = F.col("p_partkey")
    variants = views.table(spark, sf_dir, "part").select(
        F.when(k % 97 == 0, "Part").otherwise(F.concat(F.lit("m"), F.floor(k / 3))).alias("name"),
        F.lit("tdt").alias("entry_type"),
        F.when(k % 53 == 0, F.array(F.lit("EN"))).otherwise(F.array(F.lit("en"))).alias("languages"),
        F.col("p_size").alias("target"), F.lit(45).alias("maximum"),
        F.when(k % 3 == 0, "fp32").when((k % 3 == 1) & (k % 10 == 0), "fp32x").when(k % 3 == 1, "int8").otherwise("FP16").alias("quantization"),
        F.col("p_brand").alias("repo"), F.when(k % 31 == 0, "abc").otherwise(F.repeat(F.lit("a1"), 20)).alias("revision"),
        F.create_map(F.lit("model"), F.concat(F.lit("f"), k % 2)).alias("files"),
    )
    return rq.validate_variants(variants)


_JOBS_SQL = "jobs AS (SELECT 'm' || CAST(o_custkey % 3 AS VARCHAR) AS model, o_orderkey // 64 AS shard, o_orderkey AS ord, CAST(floor(o_totalprice * 5) AS BIGINT) AS n FROM orders)"


def _jobs(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"), F.floor(F.col("o_orderkey") / 64).alias("shard"),
        F.col("o_orderkey").alias("ord"), F.floor(F.col("o_totalprice") * 5).alias("n"),
    )


def _pack(spark, sf_dir):
    return batching.pack_batches(_jobs(spark, sf_dir), max_padded=4_000_000)


def _pack_sql(cap):
    return f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY model, shard ORDER BY ord) AS r FROM jobs),
packed AS (
  SELECT model, shard, ord, n, r, CAST(0 AS BIGINT) AS batch, 1 AS rows, n AS longest FROM numbered WHERE r = 1
  UNION ALL
  SELECT x.model, x.shard, x.ord, x.n, x.r, CASE WHEN x.f THEN x.batch + 1 ELSE x.batch END, CASE WHEN x.f THEN 1 ELSE x.rows + 1 END,
         CASE WHEN x.f THEN x.n ELSE greatest(x.longest, x.n) END
  FROM (SELECT j.*, p.batch, p.rows, p.longest, p.rows >= 4 OR (p.rows + 1) * greatest(p.longest, j.n) > {cap} AS f
        FROM packed p JOIN numbered j ON j.model = p.model AND j.shard = p.shard AND j.r = p.r + 1) x)"""


_PACK_SQL = _pack_sql(4_000_000)


def _waste(spark, sf_dir):
    return batching.padding_report(_pack(spark, sf_dir)).withColumn("waste", F.round("waste", 9))


def _echo():
    """A stand-in recogniser: hears a text as its length and first word, and
    fails on a batch holding a one-word text."""

    def model(texts):
        if any(" " not in text for text in texts):
            raise ValueError("nothing heard")
        return [{"n_chars": len(text), "first": text.split(None, 1)[0]} for text in texts]

    return model


def _score(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return batching.score_with_model(
        turns, _echo, payload="text", keys="conv_id long, turn long", schema="n_chars long, first string", max_rows=1
    ).drop("error")


def _together(name):
    """A stand-in model that tells with whom a text was heard; m2 hears no batch of three."""

    def model(texts):
        if name == "m2" and len(texts) == 3:
            raise ValueError("three at once")
        return [{"heard_by": name, "together": len(texts), "longest": max(len(t or "") for t in texts)} for t in texts]

    return model


def _score_packed(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"), F.lit(0).alias("shard"), F.col("doc_id").alias("ord"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text",
    )
    packed = batching.pack_batches(docs, max_padded=3000, slice_rows=32).drop("n").join(docs, ["model", "shard", "ord"])
    scored = batching.score_batches(
        packed, _together, payload="text", keys="ord long, batch long", schema="heard_by string, together int, longest int"
    )
    return scored.withColumnRenamed("ord", "doc_id")


_SCORE_PACKED_SQL = f"""
WITH RECURSIVE jobs AS (SELECT 'm' || CAST(doc_id % 3 AS VARCHAR) AS model, (row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1) // 32 AS shard,
     doc_id AS ord, CAST(coalesce(length(text), 0) AS BIGINT) AS n FROM documents), {_pack_sql(3000)},
told AS (SELECT model, ord AS doc_id, shard * 32 + batch AS batch, CAST(count(*) OVER b AS INTEGER) AS together, CAST(max(n) OVER b AS INTEGER) AS longest FROM packed WINDOW b AS (PARTITION BY model, shard, batch))
SELECT doc_id, batch, CASE WHEN ok THEN model END AS heard_by, CASE WHEN ok THEN together END AS together, CASE WHEN ok THEN longest END AS longest,
       CASE WHEN NOT ok THEN 'ValueError: three at once' END AS error FROM (SELECT *, NOT (model = 'm2' AND together = 3) AS ok FROM told)"""


def _isolate(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars"), F.lit("kept").alias("first"))
    redo = batching.score_with_model(
        docs, _echo, payload="text", keys="doc_id long", schema="n_chars long, first string", max_rows=1
    )
    return batching.keep_first_on_failure(docs.drop("text"), redo, ["doc_id"], ["n_chars", "first"])


QUERIES = [
    Query(
        "parse_variant_key", _parse,
        with_views("SELECT id, name, CASE WHEN reject IS NULL THEN q END AS quantization, reject FROM parsed", REQUESTS_SQL, _PARSED_SQL),
    ),
    Query("resolve_model", lambda s, d: _resolve(s, d, "fp32"), _resolve_sql("'fp32'")),
    Query("resolve_aligner", _resolve, _resolve_sql("m.quantizations[-1]")),
    Query(
        "check_language_code", _check_language,
        with_views(
            "SELECT id, coalesce(language, '') IN ('', 'auto') OR regexp_full_match(coalesce(language, ''), '[a-z]{2,3}') AS valid FROM req", REQUESTS_SQL
        ),
    ),
    Query(
        "check_aligner_language", _aligner_language,
        with_views(
            """SELECT id, coalesce(CASE WHEN coalesce(language, '') IN ('', 'auto') THEN 'en' ELSE language END IN ('en', CASE WHEN m.lang = 'multi' THEN 'de' ELSE 'en' END), FALSE)
               AND m.k IS NOT NULL AS covered FROM req LEFT JOIN models m ON m.name = lower(trim(split_part(model, ':', 1)))""",
            MODELS_SQL, REQUESTS_SQL,
        ),
    ),
    Query(
        "effective_options", _options,
        with_views(
            """SELECT id, lg AS language, CASE id % 4 WHEN 1 THEN FALSE ELSE TRUE END AS retime_words, id % 6 = 0 AS vad_filter,
                 id % 2 = 0 AND eng AS spoken_numbers,
                 CASE WHEN id % 9 = 0 THEN 'wide' WHEN id % 2 = 0 AND eng THEN 'letters' END AS hears_with
               FROM (SELECT *, coalesce(lg, '') IN ('', 'auto', 'en') AS eng FROM (
                 SELECT r.id, CASE WHEN m.lang = 'en' THEN 'en' ELSE r.language END AS lg FROM req r
                 LEFT JOIN models m ON m.name = lower(trim(split_part(model, ':', 1)))))""",
            MODELS_SQL, REQUESTS_SQL,
        ),
    ),
    Query(
        "chunk_bounds", _bounds,
        """SELECT p_partkey AS model, CAST(p_size + 10 AS DOUBLE) AS target, CAST(p_size + 10 + p_partkey % 20 AS DOUBLE) AS maximum,
             least(20.0, p_size + 10)::DOUBLE AS minimum,
             CASE WHEN p_partkey % 2 = 0 THEN least(5.0, (p_size + 10 + p_partkey % 20) / 4.0)::DOUBLE ELSE 0.0::DOUBLE END AS context FROM part""",
    ),
    Query(
        "enforce_limits", _limits,
        """SELECT batch, ord, CASE WHEN files > 14 THEN 'too many files' WHEN b <= 0 THEN 'empty' WHEN b > 268435456 THEN 'file too large'
             WHEN upto > 536870912 THEN 'batch too large' WHEN price / 50 > 7200 THEN 'audio too long' WHEN chunks > 512 THEN 'too many chunks' END AS reject
           FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS files, sum(b) OVER (PARTITION BY batch ORDER BY ord) AS upto,
                        sum(ord % 60) OVER (PARTITION BY batch) AS chunks FROM (
             SELECT o_custkey AS batch, o_orderkey AS ord, o_totalprice AS price,
                    CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 200) AS BIGINT) END AS b FROM orders))""",
    ),
    Query(
        "validate_catalogue", _validate,
        """WITH v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 0 THEN 'Part' ELSE 'm' || CAST(p_partkey // 3 AS VARCHAR) END AS name, p_size, p_brand,
             CASE WHEN p_partkey % 3 = 0 THEN 'fp32' WHEN p_partkey % 3 = 1 AND p_partkey % 10 = 0 THEN 'fp32x' WHEN p_partkey % 3 = 1 THEN 'int8' ELSE 'FP16' END AS q,
             CASE WHEN p_partkey % 31 = 0 THEN 'abc' ELSE repeat('a1', 20) END AS rev FROM part)
           SELECT DISTINCT name, 'name not lower case' AS rule FROM v WHERE name <> lower(name)
           UNION SELECT name, 'quantization not lower case' FROM v WHERE q <> lower(q)
           UNION SELECT name, 'bad chunk bounds' FROM v WHERE NOT (p_size > 0 AND p_size <= 45)
           UNION SELECT name, 'bad revision' FROM v WHERE NOT regexp_full_match(rev, '[0-9a-f]{40}')
           UNION SELECT name, 'bad languages' FROM v WHERE k % 53 = 0
           UNION SELECT name, 'no fp32' FROM v GROUP BY name HAVING NOT bool_or(q = 'fp32')
           UNION SELECT name, 'same files' FROM v GROUP BY name, p_brand, rev, k % 2 HAVING count(*) > 1""",
    ),
    Query("pack_batches", _pack, "WITH RECURSIVE " + _JOBS_SQL + "," + _PACK_SQL + " SELECT model, shard, ord, n, batch FROM packed"),
    Query(
        "padding_report", _waste,
        "WITH RECURSIVE " + _JOBS_SQL + "," + _PACK_SQL + """ SELECT model, count(*) AS batches, CAST(sum(c) AS BIGINT) AS rows,
           round(1 - sum(audio) / sum(c * top), 9) AS waste FROM (SELECT model, shard, batch, count(*) AS c, max(n) AS top, sum(n) AS audio FROM packed GROUP BY ALL) GROUP BY model""",
    ),
    Query("score_batches", _score_packed, _SCORE_PACKED_SQL),
    Query(
        "score_with_model", _score,
        r"""SELECT conv_id, turn, CASE WHEN contains(text, ' ') THEN length(text) END AS n_chars,
              CASE WHEN contains(text, ' ') THEN regexp_extract(text, '\S+') END AS first FROM conversations""",
    ),
    Query(
        "isolate_failures", _isolate,
        r"""SELECT doc_id, CASE WHEN contains(text, ' ') THEN length(text) ELSE n_chars END AS n_chars,
              CASE WHEN contains(text, ' ') THEN regexp_extract(text, '\S+') ELSE 'kept' END AS first FROM documents""",
    ),
]
