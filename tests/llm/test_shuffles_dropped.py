"""What a written step shuffled does not stay on disk while the next one shuffles."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from voxloom.llm.common import written
from voxloom.llm.suffix_dedup import deduplicated


def _shuffled(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for folder in folders for p in Path(folder).rglob("shuffle_*.data")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    rows = spark.range(1000).withColumn("x", F.xxhash64("id"))
    assert len(written(rows.repartition(3, "x"), "dealt").columns) == 2
    left = set()
    for _ in range(20):
        left = _shuffled(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_last_query_of_a_dedup_shuffles_texts_once(spark):
    text = "the same fifty bytes and more of them stand in both of these two texts, which differ "
    docs = spark.createDataFrame([(1, text + "here"), (2, "and " + text + "there"), (3, "another")], "doc_id bigint, text string")
    out = deduplicated(docs, as_text=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r.doc_id: r._removed for r in out.collect()} == {1: 0, 2: len(text), 3: 0}
