"""What the operators read: audio objects, sample blocks, recogniser results,
model catalogues and alphabets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.requests import MAX_UPLOAD_BYTES

RESULTS = "file string, piece int, text string, tokens array<string>, timestamps array<double>"
SAMPLES = "file string, block long, x array<float>"
VARIANT = "struct<repo:string,revision:string,files:map<string,string>>"
ENTRY = (
    "name string, family string, entry_type string, languages array<string>, chunk_target_sec double, chunk_max_sec double, "
    f"quantizations map<string,{VARIANT}>"
)


def scan_audio_files(spark: SparkSession, path: str, *, max_bytes: int = MAX_UPLOAD_BYTES, glob: str = "*") -> DataFrame:
    """(path, length, content, reject): objects over the cap keep a reason and
    lose their content, which is then never read. Spark plans no split for an
    object of no bytes, so those do not appear; compare with a listing to find
    them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    kept = found.where(F.col("length") <= max_bytes).select("path", "length", "content", F.lit(None).cast("string").alias("reject"))
    refused = found.select("path", "length").where(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("binary").alias("content"), F.lit("file too large").alias("reject")
    )
    return kept.unionByName(refused)


def scan_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).parquet(path)


def scan_asr_results(spark: SparkSession, path: str, *, form: str = "json") -> DataFrame:
    """Results as a recogniser writes them; tokens and times are null for one
    that gives text only."""
    return spark.read.schema(RESULTS).format(form).load(path)


def scan_catalogue(spark: SparkSession, path: str, defaults: dict[str, dict[str, str]]) -> DataFrame:
    """A catalogue of JSON entries to one row per quantization, files an entry
    leaves out filled in by its type."""
    if not defaults:
        raise ValueError("name the default files of at least one entry type")
    table = F.create_map(*[
        v for kind, files in defaults.items()
        for v in (F.lit(kind), F.create_map(*[F.lit(x) for pair in files.items() for x in pair]))
    ])
    entries = spark.read.schema(ENTRY).json(path)
    rows = entries.select(*[c for c in entries.columns if c != "quantizations"], F.explode("quantizations").alias("quantization", "v"))
    empty = F.create_map().cast("map<string,string>")
    given = F.coalesce("v.files", empty)
    preset = F.coalesce(F.try_element_at(table, F.col("entry_type")), empty)
    merged = F.map_concat(F.map_filter(preset, lambda k, _v: ~F.array_contains(F.map_keys(given), k)), given)
    return rows.select(*[c for c in rows.columns if c != "v"], "v.repo", "v.revision", merged.alias("files"))


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) from lines of a token and its id; the token may be a space,
    and blank lines are none."""
    lines = spark.read.text(path).where(F.col("value") != "")
    return lines.select(
        F.regexp_extract("value", r"^(.*) (\d+)$", 1).alias("token"), F.regexp_extract("value", r"^(.*) (\d+)$", 2).cast("int").alias("id")
    )


def scan_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) from one JSON object of tokens to ids."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
