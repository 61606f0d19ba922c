"""Grouping rules (Q9, Q10), decoding (N6, N7), templates (F4) and special functions."""

import math

from pyspark.sql import functions as F

from kappaflow.functions.decode import decode_response, parse_list_cell
from kappaflow.functions.grouping import binary_group, group_membership, group_threshold
from kappaflow.functions.stats import erfc, ln_gamma
from kappaflow.functions.text import clean_text, fill_template
from kappaflow.schemas import FINDING, GRADE_EXPLAINED


def test_grouping_null_zero_six(spark):
    df = spark.createDataFrame([(None,), (0,), (6,), (2,), (5,)], "x int")
    got = df.select("x", group_threshold("x").alias("t"), group_membership("x").alias("m"),
                    binary_group("x").alias("b")).collect()
    d = {r["x"]: (r["t"], r["m"], r["b"]) for r in got}
    assert d[None] == (2, None, 0)
    assert d[0] == (0, 0, 0)
    assert d[6] == (2, 6, 1)
    assert d[2] == (0, 0, 1) and d[5] == (2, 2, 1)


def test_decode_tiers(spark):
    rows = [('Sure: {"grade": 4, "explanation": "x"} done',), ('{"grade": 3',), ("nope",),
            ('{"grade": "abc", "explanation": "y"}',), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r["d"] for r in df.select(decode_response("t", GRADE_EXPLAINED, ["grade", "explanation"]).alias("d")).collect()]
    assert (got[0]["grade"], got[0]["explanation"], got[0]["status"]) == (4, "x", "ok")
    assert got[1]["grade"] is None and got[1]["status"] == "no_json"
    assert got[2]["status"] == "no_json"
    assert got[3]["grade"] is None and got[3]["status"] == "malformed"
    assert got[4]["status"] == "no_response"


def test_python_literal_cell(spark):
    cell = "[{'finding': 14, 'location': \"pt's apex\", 'temporal': None}]"
    df = spark.createDataFrame([(cell,), ("None",), (None,), ("garbage",)], "t string")
    got = [r["p"] for r in df.select(parse_list_cell("t", FINDING).alias("p")).collect()]
    assert len(got[0]) == 1 and got[0][0]["finding"] == "14" and got[0][0]["location"] == "pt's apex"
    assert got[0][0]["temporal"] is None
    assert got[1] == [] and got[2] == [] and got[3] == []


def test_hole_inside_report_is_kept(spark):
    df = spark.createDataFrame([("grade is ${grade_algo} here", 3)], "rpt string, g int")
    out = df.select(fill_template("A=${grade_algo} R=${rpt}", {"grade_algo": F.col("g"), "rpt": F.col("rpt")})
                    .alias("p")).collect()[0]["p"]
    assert out == "A=3 R=grade is ${grade_algo} here"


def test_clean_text(spark):
    t = "CHEST of 12-Jan-2024:\n\n\nLungs clear.\n\nAccession No:A123\n  "
    got = spark.createDataFrame([(t,)], "t string").select(clean_text("t").alias("c")).collect()[0]["c"]
    assert got == "Lungs clear."


def test_erfc_and_lgamma_close_to_python(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 6.0, -1.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", erfc(F.col("x")).alias("e"), ln_gamma(F.abs("x") + 1.0).alias("g")).collect()
    for r in got:
        assert abs(r["e"] - math.erfc(r["x"])) <= 1.2e-7 * max(1.0, math.erfc(r["x"])) + 1e-300
        assert abs(r["g"] - math.lgamma(abs(r["x"]) + 1.0)) < 1e-9


def test_list_cells_keep_words_inside_quotes(spark):
    from pyspark.sql import types as T
    el = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])
    cells = ["[{'a': 'None seen', 'b': None, 'c': True}]", '[{"a": "it\'s: None, True", \'b\': False}]', "[{'a': 'it\\'s None'}]", "None", "junk '"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["p"]] for r in df.select("i", parse_list_cell("t", el).alias("p")).collect()}
    assert got[0] == [("None seen", None, "true")]
    assert got[1] == [("it's: None, True", "false", None)]
    assert got[2] == [("it's None", None, None)]
    assert got[3] == got[4] == []


def test_decode_flags_values_out_of_range(spark):
    from kappaflow.schemas import JUDGE
    rows = [(0, '{"grade": 0, "choice": 1, "explanation": ""}'), (1, '{"grade": 3, "choice": 7, "explanation": ""}'),
            (2, '{"grade": 6, "choice": 1, "explanation": ""}'), (3, '{"grade": 3, "choice": 2, "explanation": "e"}')]
    df = spark.createDataFrame(rows, "i int, t string").select("i", decode_response("t", JUDGE).alias("d"))
    got = {r["i"]: (r["d"]["status"], r["d"]["grade"]) for r in df.collect()}
    assert got == {0: ("out_of_range", None), 1: ("out_of_range", None), 2: ("out_of_range", None), 3: ("ok", 3)}
