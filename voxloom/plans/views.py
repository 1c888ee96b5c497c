"""Operator inputs derived from the star-schema and text tables.

No audio comes with those tables, so a view stands in for each input: an event
value per user for a signal, an event with a length for an interval, a turn's
words for a recogniser's tokens. Every view reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.arrays import pinned
from voxloom.operators.blocks import reblocked
from voxloom.operators.scan import ordinal

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows dealt out to every core where the files give fewer splits than that
    would keep busy; a corpus with splits to spare is left as it is read. The
    raw rows are moved, before the work that makes them larger."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


SHARES = 16  # parts that a split of the files is dealt into where a part's rows are held in a map


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key into as many parts as grow with the files, so that what
    a task holds for its groups does not, and groups of that key are not moved again."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, SHARES * rows.rdd.getNumPartitions()), key)


def epoch_us(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sig(key, pos, x): a user's event values in time order."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), epoch_us("ts").alias("_us"), "event_id", F.col("value").alias("x")
    )
    ranked = ordinal(events, ["key"], ["_us", "event_id"], F.floor(F.col("_us") / DAY_US))
    return ranked.select("key", "pos", "x")


SIGNAL_SQL = """
sig AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
               value AS x FROM events)"""


def signal_blocks(spark: SparkSession, sf_dir: str, size: int, scale: float = 1.0) -> DataFrame:
    """The same signal, over `scale`, as blocks(key, block, x): a user's day of
    events is a chunk, and the chunks of all days are cut anew."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), epoch_us("ts").alias("us"), "event_id", (F.col("value") / scale).alias("x")
    )
    days = events.groupBy("key", F.floor(F.col("us") / DAY_US).alias("ord")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "x"))), lambda e: e["x"]).alias("x")
    )
    return reblocked(days, ["key"], size)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iv(key, id, kind, s, e): an event's second, and `value` minutes on."""
    events = table(spark, sf_dir, "events")
    start = F.floor(epoch_us("ts") / 1_000_000)
    return events.select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"),
        start.alias("s"),
        (start + F.floor(F.col("value") * 60 + 0.5)).alias("e"),
    )


INTERVALS_SQL = """
iv AS (SELECT user_id AS key, event_id AS id, event_type AS kind, epoch_us(ts) // 1000000 AS s,
              epoch_us(ts) // 1000000 + CAST(floor(value * 60 + 0.5) AS BIGINT) AS e FROM events)"""



def split_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results(file, piece, tokens, timestamps): each turn's words cut into
    three-character tokens, 0.8 s per word and 0.1 s per token. A word marker
    opens the first token, or, for every fifth word, stands alone before it."""
    turns = spread_out(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    token = lambda tok, tenths: F.struct(tok.alias("tok"), (tenths / F.lit(10.0)).alias("t"))

    def of_word(word: Column, i: Column) -> Column:
        lone = i % 5 == 3
        cut = F.transform(
            F.sequence(F.lit(0), F.floor((F.char_length(word) - 1) / 3).cast("int")),
            lambda k: token(
                F.concat(F.when((k == 0) & ~lone, F.lit("▁")).otherwise(F.lit("")), F.substring(word, k * 3 + 1, F.lit(3))),
                i * 8 + k,
            ),
        )
        return F.when(lone, F.concat(F.array(token(F.lit("▁"), i * 8)), cut)).otherwise(cut)

    pieces = F.flatten(F.transform(split_words(F.col("text")), of_word))
    cut = turns.select(F.col("conv_id").alias("file"), F.col("turn").cast("int").alias("piece"), "text")
    return pinned(cut, p=pieces).select(
        "file",
        "piece",
        F.col("p.tok").alias("tokens"),
        F.col("p.t").alias("timestamps"),
        (F.col("piece") * 60.0).alias("chunk_start"),
        (F.col("piece") * 60.0 + 60.0).alias("chunk_end"),
    )


TOKENS_SQL = r"""
turn_lists AS (
  SELECT conv_id AS file, CAST(turn AS INTEGER) AS piece,
         list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM conversations),
turn_words AS (SELECT file, piece, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM turn_lists),
tok AS (
  SELECT file, piece, i, k, row_number() OVER (PARTITION BY file, piece ORDER BY i, k) - 1 AS pos,
         CASE WHEN k = -1 THEN '▁' ELSE CASE WHEN k = 0 AND i % 5 <> 3 THEN '▁' ELSE '' END || substr(word, k * 3 + 1, 3) END AS tok,
         (i * 8 + greatest(k, 0)) / 10.0 AS t, piece * 60.0 AS chunk_start, piece * 60.0 + 60.0 AS chunk_end
  FROM (SELECT *, unnest(range(CASE WHEN i % 5 = 3 THEN -1 ELSE 0 END, (length(word) + 2) // 3)) AS k FROM turn_words)),
wd AS (
  SELECT *, row_number() OVER (PARTITION BY file, piece ORDER BY i) - 1 AS w,
         lead(first_t) OVER (PARTITION BY file, piece ORDER BY i) AS next_t FROM (
    SELECT file, piece, i, chunk_start, chunk_end, string_agg(CASE WHEN tok LIKE '▁%' THEN substr(tok, 2) ELSE tok END, '' ORDER BY pos) AS word,
           min(pos) FILTER (WHERE tok <> '▁') AS first, max(pos) AS last, min(t) FILTER (WHERE tok <> '▁') AS first_t, max(t) AS last_t
    FROM tok GROUP BY file, piece, i, chunk_start, chunk_end)),
timed AS (
  SELECT file, piece, w, word, start, least(chunk_end, greatest(start, least(coalesce(chunk_start + next_t, chunk_end), chunk_start + last_t + 0.32))) AS "end"
  FROM (SELECT *, least(chunk_end, greatest(chunk_start, chunk_start + first_t)) AS start FROM wd))"""
