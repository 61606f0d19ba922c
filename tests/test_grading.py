"""Hand-written cases of FIXTURES section 3 against the real dictionaries (rules Q1-Q7)."""

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from kappaflow.operators.encode import encode_mentions
from kappaflow.operators.grading import encode_extraction, grade_extraction, grade_reports, mention_priority
from kappaflow.schemas import EXTRACTION, LEXICON
from kappaflow.sources.dictionaries import DEVICES, DIAGNOSES, FINDINGS, lexicon_df, lexicon_rows

MENTION_SCHEMA = ("report_id long, mention_id long, kind string, term_raw string, temporal int, "
                  "uncertainty int, placement int")


def per_kind_lexicon(spark):
    rows = lexicon_rows(FINDINGS, "finding") + lexicon_rows(DEVICES, "device") + lexicon_rows(DIAGNOSES, "diagnosis")
    return spark.createDataFrame(rows, LEXICON)


def grade_long(spark, rows):
    m = spark.createDataFrame(rows, MENTION_SCHEMA)
    enc = encode_mentions(m, per_kind_lexicon(spark))
    return {r["report_id"]: r.asDict() for r in grade_reports(mention_priority(enc)).collect()}


def grade_nested(spark, payload):
    df = spark.createDataFrame([(1, payload)], f"report_id long, payload {EXTRACTION.simpleString()}")
    enc = encode_extraction(df, lexicon_df(spark, FINDINGS), lexicon_df(spark, DEVICES), lexicon_df(spark, DIAGNOSES))
    return grade_extraction(enc).collect()[0].asDict(recursive=True)


def f(term, temporal="not mentioned", unc="not mentioned"):
    return {"finding": term, "location": None, "system": "Lung", "temporal": temporal, "uncertainty": unc}


def test_uncertain_finding(spark):
    g = grade_long(spark, [(1, 1, "finding", "consolidation", 4, 1, 3)])
    assert g[1]["max_finding_priority"] == 3 and g[1]["overall_max_priority"] == 3


def test_lower_clamp(spark):
    assert grade_long(spark, [(1, 1, "finding", "normal", 4, 1, 3)])[1]["max_finding_priority"] == 1


def test_finding_temporal_has_no_effect(spark):
    assert grade_long(spark, [(1, 1, "finding", "consolidation", 3, 0, 3)])[1]["max_finding_priority"] == 4


def test_malpositioned_and_suboptimal_device(spark):
    g = grade_long(spark, [(1, 1, "device", "NG tube", 4, 2, 2), (2, 2, "device", "NG tube", 4, 2, 1)])
    assert g[1]["max_line_priority"] == 5 and g[2]["max_line_priority"] == 3


def test_stable_diagnosis(spark):
    g = grade_long(spark, [(1, 1, "diagnosis", "Pneumonia", 3, 2, 3), (1, 2, "finding", "nodule", 4, 0, 3)])
    assert g[1]["max_diagnosis_priority"] == 3


def test_diagnosis_only_overall_is_one(spark):
    g = grade_long(spark, [(1, 1, "diagnosis", "P1 finding", 0, 2, 3)])
    assert g[1]["max_diagnosis_priority"] == 5 and g[1]["overall_max_priority"] == 1
    n = grade_nested(spark, {"findings_all": [], "devices_all": [],
                             "diagnoses_all": [{"diagnosis": "P1 finding", "temporal": "new"}]})
    assert n["max_diagnosis_priority"] == 5 and n["overall_max_priority"] == 1


def test_nothing_extracted(spark):
    n = grade_nested(spark, {"findings_all": [], "devices_all": [], "diagnoses_all": []})
    assert n["findings_priorities"] == [1] and n["lines_priorities"] == [1] and n["diagnoses_priorities"] == [1]
    assert (n["max_finding_priority"], n["max_line_priority"], n["max_diagnosis_priority"],
            n["overall_max_priority"]) == (1, 1, 1, 1)


def test_report_without_mentions_gets_empty_grades(spark):
    m = spark.createDataFrame([(1, 1, "finding", "mass", 0, 0, 3)], MENTION_SCHEMA)
    reports = spark.createDataFrame([(1,), (2,)], "report_id long")
    g = grade_reports(mention_priority(encode_mentions(m, per_kind_lexicon(spark))), reports)
    got = {r["report_id"]: r["overall_max_priority"] for r in g.collect()}
    assert got == {1: 4, 2: 1}


def test_unknown_finding_takes_nearest(spark):
    m = spark.createDataFrame([(1, 1, "finding", "nodules", 4, 0, 3)], MENTION_SCHEMA)
    r = encode_mentions(m, per_kind_lexicon(spark)).collect()[0]
    assert r["term"] == "nodule" and r["idx"] == list(FINDINGS).index("nodule") and r["match"] == "nearest"


def test_unknown_device_is_skipped(spark):
    g = grade_long(spark, [(1, 1, "device", "foo tube", 4, 2, 2), (1, 2, "finding", "granuloma", 4, 0, 3)])
    assert g[1]["n_lines"] == 0 and g[1]["max_line_priority"] == 1 and g[1]["overall_max_priority"] == 3


def test_tie_goes_to_first_term(spark):
    lex = spark.createDataFrame([(0, "abc", 2), (1, "abd", 5)], "idx int, term string, priority int")
    m = spark.createDataFrame([(1, 1, "finding", "abx", 4, 0, 3)], MENTION_SCHEMA)
    r = encode_mentions(m, lex).collect()[0]
    assert r["idx"] == 0 and r["distance"] == 1


def test_letter_case_is_not_matched(spark):
    m = spark.createDataFrame([(1, 1, "diagnosis", "lung collapse", 4, 0, 3)], MENTION_SCHEMA)
    assert encode_mentions(m, per_kind_lexicon(spark)).collect()[0]["idx"] is None


def test_overall_not_below_any_priority_and_in_range(spark):
    from kappaflow.plans.q_grading import grade_semialgo_df
    from conftest import SF_SMALL
    g = grade_semialgo_df(spark, SF_SMALL)
    bad = g.where((F.col("overall_max_priority") < 1) | (F.col("overall_max_priority") > 5)
                  | ((F.col("n_findings") + F.col("n_lines") > 0)
                     & ((F.col("overall_max_priority") < F.col("max_finding_priority"))
                        | (F.col("overall_max_priority") < F.col("max_line_priority"))))).count()
    assert bad == 0


def test_nested_equals_long(spark):
    from kappaflow.plans.q_grading import grade_nested_df, grade_semialgo_df
    from conftest import SF_SMALL
    a = {r["report_id"]: r["overall_max_priority"] for r in grade_semialgo_df(spark, SF_SMALL).collect()}
    b = {r["report_id"]: r["overall_max_priority"] for r in grade_nested_df(spark, SF_SMALL).collect()}
    assert a == b and len(a) > 0


def test_raising_a_priority_never_lowers_overall(spark):
    rows = [(1, 1, "finding", "nodule", 4, 0, 3), (1, 2, "device", "PICC", 4, 0, 0),
            (2, 3, "finding", "granuloma", 4, 1, 3)]
    m = spark.createDataFrame(rows, MENTION_SCHEMA)
    lex = per_kind_lexicon(spark)
    up = lex.withColumn("priority", F.when(F.col("term") == "nodule", 5).otherwise(F.col("priority")))
    base = {r["report_id"]: r["overall_max_priority"] for r in grade_reports(mention_priority(encode_mentions(m, lex))).collect()}
    more = {r["report_id"]: r["overall_max_priority"] for r in grade_reports(mention_priority(encode_mentions(m, up))).collect()}
    assert all(more[k] >= base[k] for k in base)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("block, no_index", [(1, 1024), (7, 1024), (1024, 1024), (7, 0), (1024, 0)])
def test_nearest_is_the_first_minimum(spark, block, no_index):
    """By blocks and by the segment index, whatever the distance."""
    import random
    rnd = random.Random(5 + block)
    alpha = "abcde"
    terms = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(2, 9))) for _ in range(60)})
    lex = spark.createDataFrame([(i, t, i % 5 + 1) for i, t in enumerate(terms)], "idx int, term string, priority int")
    qs = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 12))) for _ in range(120)] + ["x" * 40, "ab" * 20]
    m = spark.createDataFrame([(i, i, "finding", q, 4, 0, 3) for i, q in enumerate(qs)], MENTION_SCHEMA)
    got = {r["mention_id"]: (r["distance"], r["idx"]) for r in encode_mentions(m, lex, block=block, no_index=no_index).collect()}
    assert got == {i: min((edit_distance(q, t), k) for k, t in enumerate(terms)) for i, q in enumerate(qs)}


def test_candidates_hold_every_entry_within_the_radius(spark):
    """No entry within the radius is missed by the index: all pairs against the edit distance."""
    import random

    from pyspark.sql import functions as F

    from kappaflow.operators.nearest import entry_keys, term_keys
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(0, 11))) for _ in range(90)})
    asked = []
    for w in words:  # near texts, by up to five edits
        for _ in range(3):
            x = list(w)
            for _ in range(rnd.randint(0, 5)):
                at = rnd.randint(0, len(x))
                x[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
            asked.append("".join(x))
    e = spark.createDataFrame([(w,) for w in words], "e string")
    q = spark.createDataFrame([(w,) for w in sorted(set(asked))], "q string")
    for radius in (1, 2, 4):
        pairs = (q.select("q", F.explode(term_keys(F.col("q"), radius)).alias("k")).join(e.select("e", F.explode(entry_keys(F.col("e"), radius)).alias("k")), "k")
                 .select("q", "e").distinct().collect())
        found = {(r["q"], r["e"]) for r in pairs}
        assert {(a, b) for a in set(asked) for b in words if edit_distance(a, b) <= radius} <= found


def test_index_leaves_no_blocks_for_near_terms(spark):
    """Misspellings within the last radius never meet the dictionary as a whole."""
    from kappaflow.operators import nearest
    lex = spark.createDataFrame([(i, f"term number {i * 7919}", i % 5 + 1) for i in range(3000)], "idx int, term string, priority int")
    terms = spark.createDataFrame([(f"tern nmber {i * 7919}",) for i in range(0, 3000, 100)], "term_raw string")
    seen = nearest.nearest_in_blocks
    try:
        nearest.nearest_in_blocks = None  # a call would fail
        got = {r["term_raw"]: r["idx"] for r in nearest.nearest_terms(terms, lex).collect()}
    finally:
        nearest.nearest_in_blocks = seen
    assert got == {f"tern nmber {i * 7919}": i for i in range(0, 3000, 100)}


def test_a_repeated_dictionary_term_counts_once(spark):
    """First place, last priority; the nested form and the long form agree, and rows without a key keep their codes."""
    lex = spark.createDataFrame([(0, "mass", 4), (1, "nodule", 3), (2, "mass", 2), (3, None, 5)], "idx int, term string, priority int")
    m = spark.createDataFrame([(1, 1, "finding", "mass", 4, 0, 3), (2, 1, "finding", None, 4, 0, 3)], MENTION_SCHEMA)
    assert sorted((r["report_id"], r["idx"], r["priority"]) for r in encode_mentions(m, lex).collect()) == [(1, 0, 2), (2, None, None)]
    from kappaflow.schemas import EXTRACTION
    finding = {"finding": "mass", "location": None, "system": None, "temporal": None, "uncertainty": None}
    rows = [(k, {"findings_all": [finding], "devices_all": [], "diagnoses_all": []}) for k in (None, None, 5, 5)]
    rows += [(6, {"findings_all": [], "devices_all": None, "diagnoses_all": []}), (7, None)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("report_id", T.LongType()), T.StructField("payload", EXTRACTION)]))
    got = grade_extraction(encode_extraction(df, lex, lex, lex)).collect()
    assert sorted(((-1 if r["report_id"] is None else r["report_id"]), r["overall_max_priority"]) for r in got) == [
        (-1, 2), (-1, 2), (5, 2), (5, 2), (6, 1), (7, 1)]


def test_dictionary_never_reaches_the_driver(spark):
    """No dictionary scalar in the plans."""
    lex = spark.createDataFrame([(0, "abc", 2)], "idx int, term string, priority int")
    m = spark.createDataFrame([(1, 1, "finding", "abx", 4, 0, 3)], MENTION_SCHEMA)
    plan = encode_mentions(m, lex)._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" not in plan and "scalar-subquery" not in plan
    assert encode_mentions(m, lex.where("false")).collect()[0]["match"] is None
