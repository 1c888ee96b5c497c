"""The registered queries over the corpus tables: one for each numbered operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.chat import canonical_turns, formatted, loss_texts, read_back
from voxloom.llm.common import table
from voxloom.llm.decontamination import leaks
from voxloom.llm.fingerprints import edited_pairs
from voxloom.llm.jaccard import jaccard_join
from voxloom.llm.language import language_id
from voxloom.llm.packing import pack
from voxloom.llm.quality import quality_scores
from voxloom.llm.search import ranked_search
from voxloom.llm.suffix_dedup import deduplicated
from voxloom.llm.token_files import through_files
from voxloom.llm.token_counts import count_tokens
from voxloom.llm.warc import archived
from voxloom.llm.whitening import whitened


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once strings of 50 bytes from earlier documents are gone."""
    kept = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return edited_pairs(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and the number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels outside the held-out fold."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through whole-stream archives, normalised, and read back."""
    return archived(table(spark, sf_dir, "pages")).drop("payload", "url")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM m"""


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document through coded files and back."""
    return through_files(table(spark, sf_dir, "documents")).drop("ids")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.inline(F.expr("array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role))")),
    ).withColumn("text", F.lit(said))
    chats = formatted(canonical_turns(rows.unionByName(odd)))
    back = chats.select(
        "conv_id", read_back(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars")
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>|pad>|unk>|bos>|eos>)'))
            + length('<|turn|><|says|><|end|>') + length(role) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_all, sum(n)::BIGINT AS terms_all FROM docs),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
asked AS (
  SELECT item_id, term, count(*) AS said FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, sum(said * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // terms_all))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 largest components, whitened."""
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labels outside the held-out fold."""
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_fingerprints": op2_fingerprints, "op3_jaccard": op3_jaccard, "op4_quality": op4_quality, "op5_warc": op5_warc, "op6_token_files": op6_token_files, "op7_token_counts": op7_token_counts, "op8_packing": op8_packing, "op9_decontamination": op9_decontamination,
           "op10_chat_formatting": op10_chat_formatting,
           "op11_lexical_search": op11_lexical_search, "op12_whitening": op12_whitening, "op13_language": op13_language}
SQL = {"op5_warc": OP5_SQL, "op10_chat_formatting": OP10_SQL, "op11_lexical_search": OP11_SQL}
