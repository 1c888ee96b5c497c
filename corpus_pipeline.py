"""The corpus job: stages that each take all documents the last one kept.

A document that the quality classifier rejects goes; of each group of near
copies the one with the smallest id stays; strings that an earlier document
holds too are cut out of the text, whose row stays even if nothing is left of
it; documents that leak a benchmark item go; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import apart, table, written
from voxloom.llm.decontamination import leaks
from voxloom.llm.jaccard import jaccard_join
from voxloom.llm.packing import pack
from voxloom.llm.quality import THRESHOLD, fit, scored
from voxloom.llm.suffix_dedup import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where(F.col(apart(docs) + "score") >= THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the ids that go are written, so that their size decides how they are joined
    gone = written(jaccard_join(docs).where("class_id <> doc_id").select("doc_id"), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = deduplicated(docs, as_text=True)
    p = apart(docs)
    cut, left = F.col(p + "removed") > 0, F.col(p + "kept")
    text, n_chars = F.when(cut, left).otherwise(F.col("text")), F.when(cut, F.char_length(left).cast("bigint")).otherwise(F.col("n_chars"))
    return kept.select(*[{"text": text, "n_chars": n_chars}[c].alias(c) if c in ("text", "n_chars") else F.col(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = written(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]
#: Learned scores, MinHash candidates and tokens are not for SQL to state: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
