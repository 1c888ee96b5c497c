"""Spoken and written numbers, over prices, order keys and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import numbers as nb
from voxloom.operators import numbers as no
from voxloom.plans import views
from voxloom.queries.base import Query, with_views
from voxloom.session import cut_lineage

# The words of 0 to 999 for the SQL side, from lists.
WORDS_SQL = f"""
ones AS (SELECT list_value({', '.join(repr(w) for w in nb.ONES)}) AS o, list_value({', '.join(repr(w) for w in nb.TENS)}) AS t),
small AS (SELECT n, CASE WHEN n < 20 THEN o[n + 1] ELSE t[n // 10 + 1] || CASE WHEN n % 10 > 0 THEN '-' || o[n % 10 + 1] ELSE '' END END AS w
          FROM (SELECT unnest(range(100)) AS n), ones),
w3 AS (SELECT h * 100 + n AS k, CASE WHEN h = 0 THEN w ELSE o[h + 1] || ' hundred' || CASE WHEN n > 0 THEN ' ' || w ELSE '' END END AS us,
              CASE WHEN h = 0 THEN w ELSE o[h + 1] || ' hundred' || CASE WHEN n > 0 THEN ' and ' || w ELSE '' END END AS gb
       FROM (SELECT unnest(range(10)) AS h), small, ones)"""
NUMS_SQL = """
nums AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 1000) AS BIGINT) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1009 WHEN 2 THEN 0 ELSE 1 END
            // CASE WHEN o_orderkey % 4 = 3 THEN 100000 ELSE 1 END AS n FROM orders),
said AS (SELECT id, n, CASE WHEN n = 0 THEN 'zero' ELSE trim(
    CASE WHEN n // 1000000000 % 1000 > 0 THEN b.us || ' billion ' ELSE '' END || CASE WHEN n // 1000000 % 1000 > 0 THEN m.us || ' million ' ELSE '' END ||
    CASE WHEN n // 1000 % 1000 > 0 THEN t.us || ' thousand ' ELSE '' END || CASE WHEN n % 1000 > 0 THEN u.us ELSE '' END) END AS us,
  CASE WHEN n = 0 THEN 'zero' ELSE trim(
    CASE WHEN n // 1000000000 % 1000 > 0 THEN b.gb || ' billion ' ELSE '' END || CASE WHEN n // 1000000 % 1000 > 0 THEN m.gb || ' million ' ELSE '' END ||
    CASE WHEN n // 1000 % 1000 > 0 THEN t.gb || ' thousand ' ELSE '' END || CASE WHEN n >= 1000 AND n % 1000 BETWEEN 1 AND 99 THEN 'and ' ELSE '' END ||
    CASE WHEN n % 1000 > 0 THEN u.gb ELSE '' END) END AS gb
  FROM nums JOIN w3 b ON b.k = n // 1000000000 % 1000 JOIN w3 m ON m.k = n // 1000000 % 1000 JOIN w3 t ON t.k = n // 1000 % 1000 JOIN w3 u ON u.k = n % 1000)"""


def _numbers(spark, sf_dir):
    o = F.col("o_orderkey")
    base = F.floor(F.col("o_totalprice") * 1000) * F.when(o % 4 == 1, 1009).when(o % 4 == 2, 0).otherwise(1)
    n = F.when(o % 4 == 3, nb.div(base, 100000)).otherwise(base)
    return views.table(spark, sf_dir, "orders").select(o.alias("id"), n.cast("long").alias("n"))


def _cardinal(spark, sf_dir):
    return _numbers(spark, sf_dir).select("id", nb.cardinal(F.col("n")).alias("us"), nb.cardinal(F.col("n"), True).alias("gb"))


def _ordinal(spark, sf_dir):
    words = nb.cardinal(F.col("n"))
    return _numbers(spark, sf_dir).select("id", nb.ordinal(words).alias("nth"), nb.plural(words).alias("many"))


def _pairs(spark, sf_dir):
    digits = F.col("o_orderkey").cast("string")
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), nb.in_pairs(digits).alias("pairs"), nb.digit_words(digits).alias("digits"),
        nb.digit_words(digits, "oh").alias("oh"), nb.cents((F.col("o_orderkey") % 100)).alias("cents"),
    )


def _codes(spark, sf_dir):
    codes = views.table(spark, sf_dir, "orders").select(F.lpad((F.col("o_orderkey") * 11).cast("string"), 7, "0").alias("code"))
    return codes.select("code", F.posexplode(nb.recitations(F.col("code"))).alias("rank", "said"))


def _values(spark, sf_dir):
    o = F.col("o_orderkey")
    written = (
        F.when(o % 5 == 0, F.concat(F.lit("$"), F.format_string("%.2f", F.col("o_totalprice"))))
        .when(o % 5 == 1, F.concat((o % 3000).cast("string"), F.lit("s")))
        .when(o % 5 == 2, F.concat((o % 12 + 1).cast("string"), F.lit(":00")))
        .when(o % 5 == 3, F.concat(F.lit("00"), o.cast("string")))
        .otherwise(F.concat(F.lit("-"), o.cast("string")))
    )
    rows = views.table(spark, sf_dir, "orders").select(o.alias("id"), written.alias("w"))
    return rows.select("id", F.explode(no.written_values(F.col("w"))).alias("v")).select(
        "id", F.col("v.parse").cast("long").alias("parse"), F.col("v.i").cast("long").alias("i"),
        F.round(F.col("v.number").cast("double"), 2).alias("number"), F.col("v.decade").alias("decade"), F.col("v.digits").alias("digits"),
    )


def _documents(spark, sf_dir):
    docs = views.spread_out(views.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.split("text", r"\s+").alias("words"))


def _mentions(spark, sf_dir):
    """Digit words of the documents, split into their parts."""
    words = _documents(spark, sf_dir).select("doc_id", F.posexplode("words").alias("pos", "word")).where(F.col("word").rlike(r"\d"))
    n = words.withColumn("n", nb.numeral(F.col("word"))).where(F.col("n").isNotNull())
    return n.select("doc_id", "pos", "word", "n.*")


def _kinds(spark, sf_dir):
    found = _mentions(spark, sf_dir)
    n = F.struct(*[F.col(c) for c in nb.NUMERAL])
    return found.groupBy(nb.kind(n).alias("kind")).agg(F.count("*").alias("n"))


def _phrases(spark, sf_dir):
    found = no.phrases(_documents(spark, sf_dir), "doc_id", F.col("words"))
    return found.select("doc_id", "pos", "width", "kind", "word", F.size("readings").alias("ways"), no.option(F.get("readings", F.lit(0))).alias("first"))


def _verbalise(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return no.verbalise(docs, "doc_id", "words", no.phrases(docs, "doc_id", F.col("words"))).select("doc_id", "said")


def _inside(spark, sf_dir):
    """Every part with its size, brand and key inside words, said out."""
    texts = views.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.format_string("MP%d at %s for %dm", F.col("p_size"), F.col("p_brand"), F.col("p_partkey") % 90 + 10).alias("said"),
    )
    return no.say_digits(texts, ["p_partkey"])


_BELOW_HUNDRED_SQL = """
ones AS (SELECT ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen',
                 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS o, ['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS t),
nums AS (SELECT n, CASE WHEN n < 20 THEN o[n] WHEN n % 10 = 0 THEN t[n // 10 - 1] ELSE t[n // 10 - 1] || '-' || o[n % 10] END AS w FROM ones, range(1, 100) r(n))"""


def _priced(spark, sf_dir):
    """Every part's price, as text with a price in it."""
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.format_string("$%.2f", "p_retailprice").alias("w"))
    return parts.select("p", F.array(F.lit("for"), F.col("w"), F.lit("each")).alias("words"))


def _rivals(spark, sf_dir):
    found = cut_lineage(no.mentions(_priced(spark, sf_dir), "p", F.col("words")))
    return no.rivals(found, "p")


def _needs(spark, sf_dir):
    found = cut_lineage(no.mentions(_priced(spark, sf_dir), "p", F.col("words")))
    return no.needs_audio(found, no.rivals(found, "p"), "p")


def _choose(spark, sf_dir):
    """Line items as scored readings of their order's number."""
    l = views.table(spark, sf_dir, "lineitem")
    one = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    n = F.col("l_linenumber")
    scored = one.select(
        F.col("l_orderkey").alias("k"), (n > 4).alias("rival"), n.alias("rank"),
        F.when(n == 1, "two pounds ten").when(n == 2, "two pounds ten pence").otherwise(F.concat(F.lit("way "), n)).alias("said"),
        (F.col("q") - 50).alias("score"),
    )
    return no.choose_reading(scored, ["k"])


_CHOOSE_SQL = """
WITH s AS (SELECT l_orderkey AS k, l_linenumber > 4 AS rival, l_linenumber AS rank, max(l_quantity) - 50 AS score,
     CASE l_linenumber WHEN 1 THEN 'two pounds ten' WHEN 2 THEN 'two pounds ten pence' ELSE 'way ' || l_linenumber END AS said FROM lineitem GROUP BY ALL),
own AS (SELECT * FROM s WHERE NOT rival QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, rank) = 1),
oth AS (SELECT * FROM s WHERE rival QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, rank) = 1)
SELECT k, CASE WHEN oth.score > own.score + 20 THEN oth.said WHEN own.rank = 2 AND b.k IS NOT NULL AND own.score - b.score < 8 THEN b.said ELSE own.said END AS said
FROM (SELECT DISTINCT k FROM s) LEFT JOIN own USING (k) LEFT JOIN oth USING (k) LEFT JOIN (SELECT * FROM s WHERE rank = 1) b USING (k)"""


def _zeros(spark, sf_dir):
    said = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), nb.digit_words(F.col("o_orderkey").cast("string"), "oh").alias("said")
    )
    return no.zero_variants(said, ["id"])


_ZEROS_SQL = """
WITH d AS (SELECT o_orderkey AS id, unnest(string_split(CAST(o_orderkey AS VARCHAR), '')) AS x, generate_subscripts(string_split(CAST(o_orderkey AS VARCHAR), ''), 1) - 1 AS i FROM orders),
t AS (SELECT id, i, x, CASE x WHEN '0' THEN 'oh' WHEN '1' THEN 'one' WHEN '2' THEN 'two' WHEN '3' THEN 'three' WHEN '4' THEN 'four' WHEN '5' THEN 'five'
        WHEN '6' THEN 'six' WHEN '7' THEN 'seven' WHEN '8' THEN 'eight' ELSE 'nine' END AS w FROM d)
SELECT a.id, CAST(a.i AS INTEGER) AS slot, CAST(v.rank AS INTEGER) AS rank, string_agg(CASE WHEN b.i = a.i THEN v.z ELSE b.w END, ' ' ORDER BY b.i) AS said
FROM t a JOIN t b USING (id) CROSS JOIN (VALUES (0, 'oh'), (1, 'zero'), (2, 'nought')) v(rank, z) WHERE a.x = '0' GROUP BY ALL"""


def _liked(ways):
    """A score that hangs on the whole text, with many ties: a digit of its digest."""
    return ways.withColumn("score", F.conv(F.substring(F.md5("said"), 1, 1), 16, 10).cast("double"))


def _zero_choice(spark, sf_dir):
    said = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), nb.digit_words(F.col("o_orderkey").cast("string"), "oh").alias("said")
    )
    return no.choose_zeros(said, ["id"], _liked)


_ZERO_CHOICE_SQL = """
WITH RECURSIVE o AS (SELECT o_orderkey AS id, string_split(CAST(o_orderkey AS VARCHAR), '') AS d FROM orders),
z AS (SELECT id, list_transform(d, lambda x: CASE x WHEN '0' THEN 'oh' WHEN '1' THEN 'one' WHEN '2' THEN 'two' WHEN '3' THEN 'three' WHEN '4' THEN 'four'
        WHEN '5' THEN 'five' WHEN '6' THEN 'six' WHEN '7' THEN 'seven' WHEN '8' THEN 'eight' ELSE 'nine' END) AS t,
        list_filter(range(1, len(d) + 1), lambda i: d[i] = '0') AS slots FROM o),
c AS (SELECT id, t, slots, 0 AS r FROM z
      UNION ALL
      SELECT id, CASE WHEN ha >= hb AND ha >= hd THEN a WHEN hb >= hd THEN b ELSE d END, slots, r + 1
      FROM (SELECT *, substr(md5(array_to_string(a, ' ')), 1, 1) AS ha, substr(md5(array_to_string(b, ' ')), 1, 1) AS hb, substr(md5(array_to_string(d, ' ')), 1, 1) AS hd
            FROM (SELECT id, slots, r, t AS a, list_concat(list_concat(t[:slots[r + 1] - 1], ['zero']), t[slots[r + 1] + 1:]) AS b,
                         list_concat(list_concat(t[:slots[r + 1] - 1], ['nought']), t[slots[r + 1] + 1:]) AS d FROM c WHERE r < len(slots)))
)
SELECT id, array_to_string(t, ' ') AS said FROM c WHERE r = len(slots)"""


def _match(spark, sf_dir):
    """Part keys said in three ways, matched against how their sizes are written."""
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("n"), F.col("p_partkey").alias("k"))
    spoken = parts.select("id", F.split(F.concat(F.lit("it is "), nb.cardinal(F.col("k") % 60), F.lit(" here")), " ").alias("words"))
    found = parts.select("id", F.lit(0).alias("pos"), nb.amounts(F.col("n")).alias("options"))
    return no.match_said_to_written(spoken, found, ["id"])


QUERIES = [
    Query("cardinal_words", _cardinal, with_views("SELECT id, us, gb FROM said", WORDS_SQL, NUMS_SQL)),
    Query(
        "ordinal_plural_words", _ordinal,
        with_views(
            """SELECT id, head || CASE tail WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third' WHEN 'five' THEN 'fifth' WHEN 'eight' THEN 'eighth'
                 WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth' ELSE CASE WHEN tail LIKE '%y' THEN left(tail, -1) || 'ieth' ELSE tail || 'th' END END AS nth,
                 head || CASE WHEN tail LIKE '%y' THEN left(tail, -1) || 'ies' ELSE tail || 's' END AS many
               FROM (SELECT id, regexp_extract(us, '([^ -]+)$', 1) AS tail, left(us, length(us) - length(regexp_extract(us, '([^ -]+)$', 1))) AS head FROM said)""",
            WORDS_SQL, NUMS_SQL,
        ),
    ),
    Query(
        "pair_and_digit_words", _pairs,
        with_views(
            """SELECT o_orderkey AS id, (SELECT string_agg(z[CAST(c AS INTEGER) + 1], ' ' ORDER BY p) FROM dg WHERE dg.k = o_orderkey) AS digits,
                 (SELECT string_agg(CASE WHEN c = '0' THEN 'oh' ELSE z[CAST(c AS INTEGER) + 1] END, ' ' ORDER BY p) FROM dg WHERE dg.k = o_orderkey) AS oh,
                 CASE WHEN o_orderkey % 100 < 10 THEN 'oh ' || (SELECT o FROM ones)[o_orderkey % 100 + 1] ELSE (SELECT w FROM small WHERE n = o_orderkey % 100) END AS cents,
                 (SELECT CASE WHEN bool_or(pr = '00' AND (p = 1 OR p < mx)) THEN NULL ELSE string_agg(CASE WHEN pr = '00' THEN 'hundred'
                    WHEN length(pr) = 2 AND pr LIKE '0%' THEN 'oh ' || (SELECT w FROM small WHERE n = CAST(pr AS INTEGER)) ELSE (SELECT w FROM small WHERE n = CAST(pr AS INTEGER)) END, ' ' ORDER BY p) END
                  FROM prs WHERE prs.k = o_orderkey) AS pairs
               FROM orders""",
            WORDS_SQL,
            """dg AS (SELECT k, p, substr(CAST(k AS VARCHAR), p, 1) AS c, (SELECT o FROM ones) AS z FROM (SELECT o_orderkey AS k, unnest(range(1, length(CAST(o_orderkey AS VARCHAR)) + 1)) AS p FROM orders))""",
            """prs AS (SELECT k, p, max(p) OVER (PARTITION BY k) AS mx, CASE WHEN length(d) % 2 = 0 THEN substr(d, p * 2 - 1, 2) WHEN p = 1 THEN substr(d, 1, 1) ELSE substr(d, p * 2 - 2, 2) END AS pr
               FROM (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS d, unnest(range(1, (length(CAST(o_orderkey AS VARCHAR)) + 1) // 2 + 1)) AS p FROM orders))""",
        ),
    ),
    Query("recite_code", _codes),
    Query(
        "written_values", _values,
        """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders)
           SELECT k AS id, 0 AS parse, 0 AS i, round(p, 2) AS number, FALSE AS decade, '' AS digits FROM o WHERE k % 5 = 0
           UNION ALL SELECT k, 0, 0, k % 3000, TRUE, '' FROM o WHERE k % 5 = 1
           UNION ALL SELECT k, 1, 0, k % 3000 % 100, TRUE, '' FROM o WHERE k % 5 = 1 AND k % 3000 >= 100
           UNION ALL SELECT k, 0, 0, (k % 12 + 1) * 100, FALSE, '' FROM o WHERE k % 5 = 2
           UNION ALL SELECT k, 1, 0, k % 12 + 1, FALSE, '' FROM o WHERE k % 5 = 2
           UNION ALL SELECT k, 0, 0, k, FALSE, '00' || k FROM o WHERE k % 5 = 3
           UNION ALL SELECT k, 0, 0, -k, FALSE, '' FROM o WHERE k % 5 = 4""",
    ),
    Query("scan_number_mentions", _mentions),
    Query("classify_number", _kinds),
    Query("number_phrases", _phrases),
    Query("default_verbalisation", _verbalise),
    Query(
        "say_digits", _inside,
        with_views(
            """SELECT p_partkey, 'MP ' || a.w || ' at ' || regexp_replace(p_brand, '[0-9]+$', '') || ' ' || b.w || ' for ' || c.w || ' m' AS said
               FROM part JOIN nums a ON a.n = p_size JOIN nums b ON b.n = CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) JOIN nums c ON c.n = p_partkey % 90 + 10""",
            _BELOW_HUNDRED_SQL,
        ),
    ),
    Query("rivals", _rivals),
    Query("needs_audio_flag", _needs),
    Query("choose_reading", _choose, _CHOOSE_SQL),
    Query("zero_variants", _zeros, _ZEROS_SQL),
    Query("choose_zeros", _zero_choice, _ZERO_CHOICE_SQL),
    Query(
        "match_said_to_written", _match,
        "SELECT p_partkey AS id, 0 AS pos FROM part WHERE p_partkey % 60 = p_size",
    ),
]
