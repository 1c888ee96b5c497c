"""Forced cuts of each user's event values, moved to quiet points."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import cuts, reports
from voxloom.operators.intervals import even_split
from voxloom.plans import views
from voxloom.queries.base import Query, with_views

BLOCK, LIMIT, TAIL = 32, 40, 20
SMALL = cuts.Cutting(rate=100, step=1, search=5, quiet_span=4, dip_span=2, frame=2, local=12, gap_span=2, gap_side=8, gap_run=2)


def _signal(spark, sf_dir):
    """blocks(file, block, x) and sizes(file, total)."""
    sig = views.signal(spark, sf_dir).select(F.col("key").alias("file"), "pos", (F.col("x") / 1000).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    blocks = sig.groupBy("file", F.floor(F.col("pos") / BLOCK).alias("block")).agg(ordered.alias("_o")).select("file", "block", F.col("_o.x").alias("x"))
    return blocks, sig.groupBy("file").agg(F.count(F.lit(1)).alias("total"))


def _gaps(spark, sf_dir):
    blocks, sizes = _signal(spark, sf_dir)
    points = sizes.where("total > 5").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 6) / 10))).alias("cut")).withColumn("point", F.col("cut") * 10 + 5)
    return cuts.in_gap(points, blocks, sizes, block=BLOCK, cutting=SMALL).select("file", "cut", F.round("gap", 9).alias("gap"))


def _cuts(spark, sf_dir):
    blocks, sizes = _signal(spark, sf_dir)
    none = F.lit(None).cast("bigint")
    ranges = sizes.select("file", F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("s"), F.col("total").alias("e"), none.alias("latest"), none.alias("earliest"))
    out = cuts.quiet_cuts(ranges, blocks, sizes, LIMIT, block=BLOCK, cutting=SMALL)
    return out.select("file", F.posexplode("cuts").alias("k", "at")).select("file", F.col("k").cast("long").alias("k"), "at")


def _split(spark, sf_dir):
    """All but a user's last 20 values, and those, which meet; the pause between
    them may change hands."""
    blocks, sizes = _signal(spark, sf_dir)
    long = sizes.where(F.col("total") > TAIL)
    edge = F.col("total") - TAIL
    span = lambda s, e: F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
    both = lambda a, b: long.select("file", F.explode(F.array(span(F.lit(0), a), span(b, F.col("total")))).alias("p")).select("file", "p.s", "p.e")
    ranges = both(edge, edge).withColumn("stretch", F.lit(0).cast("bigint"))
    out = cuts.split_all(ranges, both(edge - 4, edge + 3), blocks, sizes, LIMIT, block=BLOCK, cutting=SMALL, bin_size=256)
    return out.select("file", "s", "e")


def _compare(spark, sf_dir):
    """Even parts against parts at quiet points; a word is five values of every seven."""
    blocks, sizes = _signal(spark, sf_dir)
    none = F.lit(None).cast("bigint")
    ranges = sizes.select("file", F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("s"), F.col("total").alias("e"), none.alias("latest"), none.alias("earliest"))
    moved = cuts.quiet_cuts(ranges, blocks, sizes, LIMIT, block=BLOCK, cutting=SMALL)
    parts = moved.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.struct(F.get("cuts", k - 1).alias("rs"), F.get("cuts", k).alias("re")))).alias("p"))
    even = even_split(ranges.select("file", "s", "e"), LIMIT).select("file", F.col("s").alias("rs"), F.col("e").alias("re"))
    k = sizes.select("file", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("total") / 7))).alias("k"))
    words = k.select("file", (F.col("k") * 7).alias("s"), (F.col("k") * 7 + 5).alias("e"))
    return reports.compare_plans(even, parts.select("file", "p.rs", "p.re"), words, deep=1, within=SMALL.search, block=256)


_SIZE_SQL = """
xs AS MATERIALIZED (SELECT key, pos, x / 1000 AS x FROM sig),
size AS (SELECT key, count(*) AS n, count(*) AS total FROM xs GROUP BY key),
pts AS MATERIALIZED (SELECT key, total, n, c, c * 10 + 5 AS p FROM (SELECT key, total, n, unnest(range((n + 4) // 10)) AS c FROM size) WHERE c * 10 + 5 < n)"""


def _gap_sql(points: str, name: str) -> str:
    """Gaps of points(key, n, c, p), from the variance of two samples at each place."""
    return f"""
lv_{name} AS MATERIALIZED (
  SELECT g.key, g.c, g.p, g.y, coalesce(var_pop(x.x), 0) AS level FROM (SELECT key, c, p, unnest(range(greatest(0, p - 8), least(total, p + 8) + 1)) AS y FROM {points}) g
  JOIN xs x ON x.key = g.key AND x.pos >= g.y - 1 AND x.pos < g.y + 1 GROUP BY g.key, g.c, g.p, g.y),
gt_{name} AS (SELECT key, c, 0.7 * least(max(level) FILTER (WHERE y < p), max(level) FILTER (WHERE y > p)) AS gate FROM lv_{name} GROUP BY key, c),
rn_{name} AS (SELECT l.key, l.c, max(y) FILTER (WHERE y < p AND level > gate) AS below, min(y) FILTER (WHERE y > p AND level > gate) AS above, min(y) AS a, max(y) AS b,
                     bool_or(y = p AND level <= gate) AS still FROM lv_{name} l JOIN gt_{name} USING (key, c) GROUP BY l.key, l.c),
gap_{name} AS MATERIALIZED (
  SELECT key, c, CASE WHEN still AND coalesce(above, b + 1) - coalesce(below, a - 1) - 2 >= 2
                      THEN (SELECT avg(level) FROM lv_{name} l WHERE l.key = r.key AND l.c = r.c AND l.y > coalesce(below, a - 1) AND l.y < coalesce(above, b + 1)) END AS gap
  FROM rn_{name} r)"""


def _cut_sql(size: str, given_up: int) -> str:
    """The cheapest chain of each range [0, n) of `size`(key, n, total), whose end may come `given_up` earlier."""
    return f"""
size_cut AS MATERIALIZED ({size}),
inner_cuts AS MATERIALIZED (SELECT key, total, n, parts, c, n * c // parts AS p FROM (SELECT key, total, n, (n + {LIMIT - 1}) // {LIMIT} AS parts, unnest(range(1, (n + {LIMIT - 1}) // {LIMIT})) AS c FROM size_cut)),
{_gap_sql("inner_cuts", "cut")},
loc AS (SELECT key, c, quantile_cont(level, 0.5) + 1e-12 AS local FROM (
  SELECT f.key, f.c, f.m, var_pop(x.x) AS level FROM (SELECT key, c, unnest(range(greatest(0, p - 12), least(n, p + 12) - 1, 2)) + 1 AS m FROM inner_cuts) f
  JOIN xs x ON x.key = f.key AND x.pos >= f.m - 1 AND x.pos < f.m + 1 GROUP BY f.key, f.c, f.m) GROUP BY key, c),
cand AS MATERIALIZED (
  SELECT g.key, g.c, g.p, g.y, var_pop(x.x) AS raw FROM (SELECT key, c, p, unnest(range(p - 5, p + 6)) AS y FROM inner_cuts) g
  JOIN xs x ON x.key = g.key AND x.pos >= g.y - 2 AND x.pos < g.y + 2 GROUP BY g.key, g.c, g.p, g.y),
here AS (SELECT d.key, d.c, d.raw / local AS level, (SELECT var_pop(x) FROM xs WHERE xs.key = d.key AND xs.pos >= d.p - 1 AND xs.pos < d.p + 1) / local AS dip FROM cand d JOIN loc USING (key, c) WHERE d.y = d.p),
priced AS MATERIALIZED (
  SELECT d.key, d.c, d.y, d.raw / local + 0.01 * abs(d.y - d.p) / 100 AS cost FROM cand d JOIN loc USING (key, c) JOIN here h USING (key, c) LEFT JOIN gap_cut g USING (key, c)
  WHERE d.y = d.p OR (least(h.level, h.dip) >= 0.5 AND CASE WHEN g.gap IS NOT NULL THEN d.raw <= g.gap * 0.05 AND d.raw / local <= 0.02 ELSE d.raw / local <= h.level * 0.5 END)
  UNION ALL SELECT key, parts, n - d, 0.01 * d / 100 FROM (SELECT key, n, (n + {LIMIT - 1}) // {LIMIT} AS parts, unnest(range({given_up} + 1)) AS d FROM size_cut)),
chain AS (
  SELECT key, 0::BIGINT AS c, 0::BIGINT AS y, 0::DOUBLE AS cost, [0::BIGINT] AS path FROM size_cut
  UNION ALL
  SELECT p.key, p.c, p.y, min(r.cost) + any_value(p.cost), list_append(arg_min(r.path, r.cost), p.y) FROM chain r
  JOIN priced p ON p.key = r.key AND p.c = r.c + 1 AND p.y - r.y <= {LIMIT} GROUP BY p.key, p.c, p.y),
done AS (SELECT s.key, coalesce(any_value(c.path), list_transform(range(any_value((s.n + {LIMIT - 1}) // {LIMIT}) + 1), lambda k: any_value(s.n) * k // any_value((s.n + {LIMIT - 1}) // {LIMIT}))) AS path
         FROM size_cut s LEFT JOIN (SELECT key, c, arg_min(path, cost) AS path FROM chain GROUP BY key, c) c ON c.key = s.key AND c.c = (s.n + {LIMIT - 1}) // {LIMIT} GROUP BY s.key)"""

QUERIES = [
    Query("in_gap", _gaps, with_views("SELECT key AS file, c AS cut, round(gap, 9) AS gap FROM gap_all", views.SIGNAL_SQL, _SIZE_SQL, _gap_sql("pts", "all"))),
    Query(
        "quiet_cuts", _cuts,
        with_views("SELECT key AS file, unnest(range(len(path))) AS k, unnest(path) AS \"at\" FROM done", views.SIGNAL_SQL, _SIZE_SQL, _cut_sql("SELECT key, n, total FROM size", 0)).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    Query(
        "split_all", _split,
        with_views(
            f"""SELECT key AS file, path[k] AS s, path[k + 1] AS e FROM (SELECT key, path, unnest(range(1, len(path))) AS k FROM done)
                UNION ALL SELECT key, path[len(path)], total FROM done JOIN size_cut USING (key)""",
            views.SIGNAL_SQL, _SIZE_SQL, _cut_sql(f"SELECT key, n - {TAIL} AS n, n AS total FROM size WHERE n > {TAIL}", 4),
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    Query(
        "plan_quality_report", _compare,
        with_views(
            """SELECT key AS file, count(*) FILTER (WHERE a) AS cuts_a, count(*) FILTER (WHERE NOT a) AS cuts_b, count(*) FILTER (WHERE a AND depth > 0) AS in_word_a,
                 count(*) FILTER (WHERE NOT a AND depth > 0) AS in_word_b, count(*) FILTER (WHERE a AND depth > 1) AS deep_a, count(*) FILTER (WHERE NOT a AND depth > 1) AS deep_b,
                 count(*) FILTER (WHERE a AND gone IS NOT NULL) AS aligned, count(*) FILTER (WHERE a AND gone <> p) AS moved,
                 count(*) FILTER (WHERE a AND greatest(0, least(gone % 7, 5 - gone % 7)) < depth) AS better, count(*) FILTER (WHERE a AND greatest(0, least(gone % 7, 5 - gone % 7)) > depth) AS worse
               FROM (SELECT *, greatest(0, least(p % 7, 5 - p % 7)) AS depth FROM (
                 SELECT key, p, TRUE AS a, (SELECT arg_min(q.p, abs(q.p - i.p) * 1000000 + q.p) FROM qc q WHERE q.key = i.key AND abs(q.p - i.p) <= 5) AS gone FROM inner_cuts i
                 UNION ALL SELECT key, p, FALSE, NULL FROM qc)) GROUP BY key""",
            views.SIGNAL_SQL, _SIZE_SQL, _cut_sql("SELECT key, n, total FROM size", 0),
            "qc AS MATERIALIZED (SELECT key, path[k] AS p FROM (SELECT key, path, unnest(range(2, len(path))) AS k FROM done))",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
]
