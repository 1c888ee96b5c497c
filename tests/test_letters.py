"""Words as an aligner's letters, by example."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.functions import letters as lt
from voxloom.queries.registry import REGISTRY

WORDS = {
    "stop.": ("STOP.", "stop"), "(\"end\"": ('("END"', "end"), "nought!": ("NAWT", "nought"), "a,": ("A,", "a"), "b": ("BEE", "b"),
    "b.": ("BEE", "b"), "it'": ("IT'", "it"), "don't": ("DON'T", "don't"), "well-read": ("WELL READ", "well-read"), "five%": ("FIVE PERCENT", "five"),
    "café": ("CAFE", "café"), "one two": ("ONE TWO", "one two"), "up\n": ("UP", "up"), "?!": ("?!", ""), "": ("", ""),
}


def test_plain_words_are_said_as_any_others(spark):
    frame = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = frame.select("w", lt.english_letters(F.col("w")).alias("e"), lt.any_letters(F.col("w")).alias("a")).collect()
    assert {r.w: (r.e, r.a) for r in got} == WORDS


@pytest.mark.parametrize("name", ["align_letters_english", "align_letters_any"])
def test_a_text_is_split_into_words_once(spark, name):
    plan = REGISTRY[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.count("text#") > 0
    assert "size(filter(split(" not in plan


FOLDED = {
    "ﬁne": "fine", "e\u0301te\u0301": "été", "ŉa": "na", "Ｃａｆé!": "Café", "x²": "x", "½": "", "…no™": "noTM", "ĳs": "ijs",
    "\u1112\u1161\u11ab": "한", "q\u0307\u0323": "q\u0323\u0307", "«Москва»": "Москва", "Straße.": "Straße", "ﷺ": "صلى الله عليه وسلم",
}


def test_letters_of_any_script_are_those_of_the_compatible_form(spark):
    got = spark.createDataFrame([(w,) for w in FOLDED], "w string").select("w", lt.any_letters(F.col("w")).alias("a")).collect()
    assert {r.w: r.a for r in got} == FOLDED


def test_the_query_and_its_sql_read_the_compatible_form(spark, tmp_path):
    pd.DataFrame({"doc_id": [1, 2], "text": [" ".join(FOLDED), "plain été ﬁne"]}).to_parquet(tmp_path / "documents.parquet")
    query = REGISTRY["align_letters_any"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = sorted(tuple(r) for r in query.run(spark, str(tmp_path)).select("doc_id", "said", "n").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, said, n FROM ({query.sql})").fetchall())
    assert {(2, "plain", 1), (2, "été", 1), (2, "fine", 1)} <= set(got)
