"""User-function surface (X2), class names (F11) and the CSV sink with nested columns."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.functions.text import choice_label, class_name
from kappaflow.plans.methods import score_rows
from kappaflow.sources.files import write_csv


def test_score_rows_adds_columns_and_isolates_errors(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x")], "report_id long, TEXT_REPORT string")

    def fn(row):
        return {"n_words": len(row["TEXT_REPORT"].split()), "first": row["TEXT_REPORT"][0]}

    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("first", T.StringType())])
    got = {r["report_id"]: (r["n_words"], r["first"]) for r in score_rows(df, fn, schema, partitions=2).collect()}
    assert got == {1: (3, "a"), 2: (None, None), 3: (1, "x")}


def test_class_and_choice_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "c int")
    got = [(r["k"], r["l"]) for r in df.select(class_name("c").alias("k"), choice_label("c").alias("l")).collect()]
    assert got[0] == ("Normal", "Neither grade is appropriate")
    assert got[2] == ("Critical", "Manual grade is better")
    assert got[3] == (None, "Both grades are the same")


def test_csv_sink_writes_nested_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 4], "line one\nline \"two\"")], "report_id long, p array<int>, t string")
    path = str(tmp_path / "out")
    write_csv(df, path)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            .collect()[0])
    assert back["p"] == "[1,4]" and back["t"] == "line one\nline \"two\""
