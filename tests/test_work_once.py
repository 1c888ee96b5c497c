"""Work that is done once: arrays that filters must not make anew, frames, alphabets."""

import pandas as pd
from pyspark.sql import functions as F

from voxloom.functions.tokens import word_spans
from voxloom.operators import align, batching, numbers
from voxloom.operators import reconcile as rc
from voxloom.plans import views
from voxloom.queries.registry import REGISTRY

MARK = 0.123456


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_of_an_ending_are_made_once(spark):
    row = (1, 0, 320_000, 0, 320_000, [1000, 310_000])
    pieces = spark.createDataFrame([row], "file long, piece int, re long, ws long, we long, starts array<long>")
    levels = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda f: F.when(f >= 990, 0.01).otherwise(MARK) + F.col("file") * 0)
    out = rc.select_endings(pieces.withColumn("levels", levels))
    assert _plan(out).count(str(MARK)) == 1
    assert [(r["begin"], round(r["top"], 6)) for r in out.collect()] == [(64_000, MARK)]


def test_calls_of_one_frame_come_back_as_one_frame():
    def fails(texts):
        raise ValueError("no")

    def counts(texts):
        return [{"n": len(t) if t else None} for t in texts]

    keys = pd.DataFrame({"id": range(5)})
    frames = list(batching._scored(keys, [(["a", "bc"], counts), (["x"], fails), ([None, "d"], counts)], ["n"]))
    assert [list(f["id"]) for f in frames] == [[0, 1, 3, 4], [2]]
    assert list(frames[0]["n"]) == [1, 2, None, 1] and list(frames[1]["error"]) == ["ValueError: no"]


def test_a_number_in_many_rows_is_read_once(spark, monkeypatch):
    split, written = [], numbers.cut_lineage

    def counted(df):
        out = written(df)
        split.append(out.count() if "_after" in df.columns else 0)
        return out

    monkeypatch.setattr(numbers, "cut_lineage", counted)
    rows = [(i, "for" if i % 2 else "with", "7", "each") for i in range(6)] + [(6, "a", "7", "each"), (7, None, "7", None)]
    out = numbers.read_phrases(spark.createDataFrame(rows, "id long, previous string, word string, following string"))
    assert sorted(r["id"] for r in out.collect()) == list(range(8))
    assert max(split) == 3


def test_tokens_of_a_plain_piece_take_no_pattern_each(spark):
    odd = [(1, ["▁ab", "c", "▁", "d▁"]), (2, ["▁ab", "c\u00a0", "▁", "\u3000", "\td"]), (3, ["▁ab", None, " c "]), (4, []), (5, None)]
    out = spark.createDataFrame(odd, "id long, tokens array<string>").select("id", word_spans(F.col("tokens")).alias("s"))
    assert _plan(out).count("regexp_replace") == 1  # in the branch of pieces with other spaces than blanks
    told = {r["id"]: r["s"] and [tuple(w) for w in r["s"]] for r in out.collect()}
    assert told[1] == [("abc", 0, 1), ("d", 3, 3)] and told[2] == [("abc", 0, 1), ("d", 4, 4)]
    assert told[3] == [("ab", 0, 0), ("c", 2, 2)] and told[4] == told[5] == []


def test_word_keys_of_a_document_are_counted_where_it_was_dealt(spark, tmp_path):
    spark.createDataFrame([(i, f"a{i} b b") for i in range(40)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a split for each file
    try:
        docs = views.dealt_by(views.table(spark, str(tmp_path), "documents"), "doc_id")
        out = REGISTRY["seam_key"].run(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert docs.rdd.getNumPartitions() == 3 * views.SHARES and plan.count("Exchange") == 1
    assert sorted((r["k"], r["n"]) for r in out.where("doc_id = 7").collect()) == [("a7", 1), ("b", 2)]
