"""Requests against a catalogue: names resolved, options defaulted, limits
kept. Nothing raises on one bad row; a row carries its reject reason instead.

The catalogue dimensions are broadcast only where Spark's own size check
allows it; no hint is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default limits.
MAX_UPLOAD_BYTES = 256 * 1024 * 1024
MAX_BATCH_FILES = 16
MAX_BATCH_BYTES = 512 * 1024 * 1024
MAX_AUDIO_SECONDS = 7200.0
MAX_CHUNKS = 512
CONTEXT_SEC = 5.0
MIN_CHUNK_SEC = 20.0


def parse_variant_key(df: DataFrame, value: str = "model", quantization: str = "quant") -> DataFrame:
    """`name[:quantization]` as `name` and `quantization`, with `reject`:
    nothing after the colon, or a quantization column that says otherwise."""
    raw, given = F.col(value), F.lower(F.trim(F.col(quantization)))
    suffix = F.lower(F.trim(F.regexp_extract(raw, r"^[^:]*:(.*)$", 1)))
    colon = F.instr(raw, ":") > 0
    reject = F.when(colon & (suffix == ""), F.lit("empty quantization")).when(
        colon & given.isNotNull() & (given != suffix), F.lit("conflicting quantization")
    )
    return df.select(
        *[F.col(c) for c in df.columns if c not in ("name", "quantization", "reject")],
        F.lower(F.trim(F.substring_index(raw, ":", 1))).alias("name"),
        F.when(reject.isNull(), F.coalesce(F.when(colon, suffix), given)).alias("quantization"),
        reject.alias("reject"),
    )


def resolve_names(
    parsed: DataFrame, entries: DataFrame, *, default_quantization: str | None = None
) -> DataFrame:
    """Parsed requests joined to entries(name, quantizations array[,
    default_quantization]): unknown names and quantizations get a reason."""
    joined = parsed.join(entries.withColumn("_known", F.lit(True)), "name", "left")
    fallback = F.lit(default_quantization) if default_quantization else F.col("default_quantization")
    quantization = F.coalesce(F.col("quantization"), fallback)
    reject = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("_known").isNull(), F.lit("unknown name"))
        .when(~F.array_contains("quantizations", quantization), F.lit("unknown quantization"))
    )
    return joined.withColumn("reject", reject).withColumn("quantization", F.when(reject.isNull(), quantization)).drop("_known")


def language_or_default(language: Column, default: str = "en") -> Column:
    code = F.coalesce(F.trim(language), F.lit(""))
    return F.when(code.isin("", "auto"), F.lit(default)).otherwise(code)


def valid_language(language: Column) -> Column:
    """A bare code of two or three lower-case letters, empty, or auto."""
    code = F.coalesce(language, F.lit(""))
    return (code == "") | (code == "auto") | code.rlike(r"^[a-z]{2,3}$")


def check_aligner_language(requests: DataFrame, bridge: DataFrame, *, default: str = "en") -> DataFrame:
    """requests(aligner, language) with `covered`: the bridge(aligner,
    language) holds the pair, or there is no language and nothing to align."""
    asked = requests.withColumn("_code", language_or_default(F.col("language"), default))
    pairs = bridge.select("aligner", F.col("language").alias("_code"), F.lit(True).alias("_hit")).distinct()
    return asked.join(pairs, ["aligner", "_code"], "left").withColumn(
        "covered", F.col("_hit").isNotNull() | (F.col("_code") == "")
    ).drop("_hit", "_code")


def effective_options(
    requests: DataFrame, models: DataFrame, *, retime: bool = False, vad_filter: bool = False, speak: bool = False,
    numbers_aligner: str | None = None, default_language: str = "en",
) -> DataFrame:
    """Per-request answers where a request leaves an option out. English-only
    models force the language; numbers are said out in English only."""
    joined = requests.join(models.select(F.col("model"), "languages"), "model", "left")
    language = F.when(F.col("languages") == F.array(F.lit("en")), F.lit("en")).otherwise(F.col("language"))
    english = language_or_default(language, default_language) == "en"
    spoken = english & F.coalesce(F.col("spoken_numbers"), F.lit(speak))
    return joined.select(
        *[F.col(c) for c in requests.columns if c not in ("language", "retime_words", "vad_filter", "spoken_numbers")],
        language.alias("language"),
        F.coalesce("retime_words", F.lit(retime)).alias("retime_words"),
        F.coalesce("vad_filter", F.lit(vad_filter)).alias("vad_filter"),
        spoken.alias("spoken_numbers"),
        F.when(spoken, F.coalesce(F.col("aligner"), F.lit(numbers_aligner))).otherwise(F.col("aligner")).alias("hears_with"),
    )


def chunk_bounds(models: DataFrame) -> DataFrame:
    """models(model, timed, chunk_target_sec, chunk_max_sec) to the four bounds."""
    context = F.when(F.col("timed"), F.least(F.lit(CONTEXT_SEC), F.col("chunk_max_sec") / 4)).otherwise(F.lit(0.0))
    return models.select(
        "model",
        F.col("chunk_target_sec").cast("double").alias("target"),
        F.col("chunk_max_sec").cast("double").alias("maximum"),
        F.least(F.lit(MIN_CHUNK_SEC), F.col("chunk_target_sec").cast("double")).alias("minimum"),
        context.alias("context"),
    )


def enforce_limits(
    files: DataFrame, *, max_seconds: float = MAX_AUDIO_SECONDS, max_chunks: int = MAX_CHUNKS,
    max_files: int = MAX_BATCH_FILES, max_bytes: int = MAX_BATCH_BYTES, max_upload: int = MAX_UPLOAD_BYTES,
) -> DataFrame:
    """files(batch, ord, n_bytes, duration, chunks) with `reject`. A batch's
    totals are aggregated first and joined back, so a huge batch is counted in
    parallel; only a batch within the file limit is small enough to add up in
    order, and every file of a larger one is rejected anyway."""
    totals = files.groupBy("batch").agg(F.count("*").alias("_files"), F.sum("chunks").alias("_chunks"))
    joined = files.join(totals, "batch")
    small = joined.where(F.col("_files") <= max_files)
    window = Window.partitionBy("batch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    summed = small.withColumn("_upto", F.sum("n_bytes").over(window))
    large = joined.where(F.col("_files") > max_files).withColumn("_upto", F.lit(None).cast("long"))
    reject = (
        F.when(F.col("_files") > max_files, F.lit("too many files"))
        .when(F.col("n_bytes") <= 0, F.lit("empty"))
        .when(F.col("n_bytes") > max_upload, F.lit("file too large"))
        .when(F.col("_upto") > max_bytes, F.lit("batch too large"))
        .when(F.col("duration") > max_seconds, F.lit("audio too long"))
        .when(F.col("_chunks") > max_chunks, F.lit("too many chunks"))
    )
    return summed.unionByName(large).withColumn("reject", reject).drop("_files", "_chunks", "_upto")


def violations(catalogue: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(name, rule) for every rule a row breaks: one pass, no union of scans."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules]), lambda r: r.isNotNull())
    return catalogue.select("name", F.explode(broken).alias("rule"))


def validate_variants(variants: DataFrame) -> DataFrame:
    """variants(name, entry_type, languages, target, maximum, quantization,
    repo, revision, files map) to (name, rule): field rules by row, and the
    rules that need an entry's variants together."""
    by_row = violations(
        variants,
        [
            ("name not lower case", F.col("name") != F.lower("name")),
            ("quantization not lower case", F.col("quantization") != F.lower("quantization")),
            ("bad chunk bounds", ~((F.col("target") > 0) & (F.col("target") <= F.col("maximum")))),
            ("bad revision", ~F.coalesce(F.col("revision").rlike("^[0-9a-f]{40}$"), F.lit(False))),
            ("bad languages", (F.size("languages") <= 0) | F.exists("languages", lambda c: ~c.rlike("^[a-z]{2,3}$"))),
            ("no repo", F.col("repo").isNull()),
        ],
    ).distinct()
    no_default = (
        variants.groupBy("name").agg(F.max((F.col("quantization") == "fp32").cast("int")).alias("d")).where(F.col("d") == 0)
    ).select("name", F.lit("no fp32").alias("rule"))
    loads = F.struct("repo", "revision", F.array_sort(F.map_entries("files")).alias("files"))
    same = (
        variants.groupBy("name", F.xxhash64(loads).alias("h"), loads.alias("loads")).agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("name", F.lit("same files").alias("rule"))
        .distinct()
    )
    return by_row.unionByName(no_default).unionByName(same)
