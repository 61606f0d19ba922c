"""Offline annotation (M1, M4) and rule grading (M2) on the example reports of the grading prompt."""

import pytest

from kappaflow.operators.annotate import annotate_mentions, diagnosis_cues, rule_grade
from kappaflow.sources.dictionaries import FINDINGS, lexicon_df

EXAMPLES = [
    (1, "Both lungs are well aerated. The hila look ordinary.", 1),
    (2, "Cardiomegaly is noted. A moderate pleural effusion tracks up the left side.", 4),
    (3, "No pleural effusion or consolidation; the heart size is not accurately assessed.", 2),
    (4, "Compared with the film of 3 May. No cardiomegaly. No nodule.", 1),
    (5, "There is no pneumothorax.", 1),
    (6, "The bones are intact with no pleural effusion.", 1),
    (7, "There is no evidence of tuberculosis.", 1),
    (8, "No change in the large pneumothorax.", 5),
    (9, "No pneumothorax, but there is consolidation on the right.", 4),
    (10, "Stable tuberculosis in the left apex.", 3),
    (11, "The known tumour is unchanged, with new consolidation.", 4),
    (12, "A nasogastric tube is in place.", 3),
    (13, "The endotracheal tube ends above the carina.", 4),
    (14, "The nasogastric tube is malpositioned.", 5),
    (15, "Malignancy cannot be excluded.", 4),
]


@pytest.fixture
def examples(spark):
    return spark.createDataFrame([(i, t) for i, t, _ in EXAMPLES], "report_id long, TEXT_REPORT string")


def test_rule_grade_on_prompt_examples(spark, examples):
    got = {r["report_id"]: r["grade"] for r in rule_grade(examples).collect()}
    assert got == {i: g for i, _, g in EXAMPLES}


def test_annotate_drops_negated_and_reads_cues(spark, examples):
    rows = annotate_mentions(examples, lexicon_df(spark, FINDINGS)).collect()
    found = {(r["report_id"], r["term"]): r for r in rows}
    assert found[(2, "pleural effusion")]["negated"] is False
    assert found[(3, "consolidation")]["negated"] is True
    assert found[(3, "pleural effusion")]["negated"] is True
    assert found[(5, "pneumothorax")]["negated"] is True and found[(8, "pneumothorax")]["negated"] is False
    assert found[(9, "pneumothorax")]["negated"] is True and found[(9, "consolidation")]["negated"] is False
    t = spark.createDataFrame([(9, "Possibly new nodules in the right apex.")], "report_id long, TEXT_REPORT string")
    r = annotate_mentions(t, lexicon_df(spark, FINDINGS)).collect()[0]
    assert (r["term"], r["uncertainty"], r["temporal"], r["negated"]) == ("nodule", 1, 0, False)


def test_diagnosis_cues(spark):
    t = spark.createDataFrame([(1, "Suggestive of infection. Malignancy cannot be excluded."),
                               (2, "No evidence of tuberculosis."), (3, "There is no evidence of tuberculosis.")], "report_id long, TEXT_REPORT string")
    got = sorted((r["report_id"], r["diagnosis"]) for r in diagnosis_cues(t).collect())
    assert got == [(1, "Lung cancer"), (1, "Pneumonia")]


def test_strategies_are_equal_on_planted_reports(spark):
    from conftest import SF_SMALL
    from kappaflow.sources import adapters as A
    ar, lx = A.annotated_reports(spark, SF_SMALL), A.lexicon(spark, SF_SMALL)
    cols = ["report_id", "sent_no", "idx", "term", "negated", "uncertainty", "temporal", "placement"]
    a = sorted(tuple(r) for r in annotate_mentions(ar, lx, strategy="automaton").select(*cols).collect())
    b = sorted(tuple(r) for r in annotate_mentions(ar, lx, strategy="join").select(*cols).collect())
    assert a == b and len(a) > 0


def test_the_longest_match_is_kept(spark):
    t = spark.createDataFrame([(1, "Loculated pleural effusions on the left. Small pleural effusion.")],
                              "report_id long, TEXT_REPORT string")
    got = sorted((r["sent_no"], r["term"]) for r in
                 annotate_mentions(t, lexicon_df(spark, FINDINGS), strategy="join").collect())
    want = sorted((r["sent_no"], r["term"]) for r in annotate_mentions(t, lexicon_df(spark, FINDINGS), strategy="automaton").collect())
    assert got == want == [(0, "loculated pleural effusion"), (1, "pleural effusion")]


@pytest.mark.parametrize("strategy", ["automaton", "join"])
def test_hyphens_and_doubled_spaces(spark, strategy):
    """Terms are found and blanked, and negations seen, whatever stands between their words."""
    terms = ["air-fluid level", "end on vessel", "new mass", "--"]
    lexicon = spark.createDataFrame(list(enumerate(terms)), "idx int, term string")
    reports = [(1, "There is no air-fluid level."), (2, "No end-on vessel."), (3, "An  air-fluid  levels is seen."), (4, "A new  mass is seen."),
               (5, "Stable air fluid level."), (6, "An end on vessel; the patient's heart is normal.")]
    t = spark.createDataFrame(reports, "report_id long, TEXT_REPORT string")
    got = sorted((r["report_id"], r["term"], r["negated"], r["temporal"]) for r in annotate_mentions(t, lexicon, strategy=strategy).collect())
    assert got == [(1, "air-fluid level", True, 4), (2, "end on vessel", True, 4), (3, "air-fluid level", False, 4), (4, "new mass", False, 4),
                   (5, "air-fluid level", False, 3), (6, "end on vessel", False, 4)]
    short = annotate_mentions(t, lexicon.where("idx = 0"), strategy=strategy).collect()
    assert sorted((r["report_id"], r["negated"]) for r in short) == [(1, True), (3, False), (5, False)]


NAMED = [
    ("No mass but massive consolidation.", 4), ("No effusion on the left; pleural effusion on the right.", 4),
    ("No pneumothorax is seen and there is a new consolidation.", 4), ("No pleural effusion, large pneumothorax on the right.", 5),
    ("Pneumothorax is excluded.", 1), ("Bilateral pleural effusions.", 4), ("Several masses in the lung.", 4), ("Patchy airspace opacities.", 4),
    ("Multiple pulmonary nodules.", 3), ("Vascular calcifications are seen.", 2), ("A hazy opacity", 4), ("Calcified adenopathy.", 3),
    ("a small pleural effusion", 3), ("Small left and right pleural effusions.", 3), ("A moderate pleural effusion; small mass.", 4),
    ("Pneumothorax is not excluded.", 5), ("Tumour cannot be entirely excluded.", 4), ("No consolidation, effusion, or pneumothorax, though a mass is seen.", 4),
    ("Without pneumothorax or consolidation but with cardiomegaly.", 3), ("No nodule and no mass.", 1), (None, 1), ("", 1), (" \n.", 1),
    ("No pneumothorax. Pneumothorax.", 5), ("The lungs are free of consolidation, nodule and mass.", 1),
]


def test_rule_grade_reads_scopes_and_plurals(spark):
    t = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(NAMED)], "report_id long, TEXT_REPORT string")
    got = {r["report_id"]: r["grade"] for r in rule_grade(t).collect()}
    assert [(x, got[i]) for i, (x, _) in enumerate(NAMED)] == NAMED


def test_planted_cases_agree_with_the_reader(spark):
    """Every case on its own: grade, diagnosis and mentions as the list says."""
    from kappaflow.sources.adapters import CASES
    t = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "report_id long, TEXT_REPORT string")
    assert {r["report_id"]: r["grade"] for r in rule_grade(t).collect()} == {i: c[1] for i, c in enumerate(CASES)}
    assert {r["report_id"]: r["diagnosis"] for r in diagnosis_cues(t).collect()} == {i: c[2] for i, c in enumerate(CASES) if c[2]}
    for strategy in ("automaton", "join"):
        got = sorted((r["report_id"], r["start"], r["term"], int(r["negated"]), r["uncertainty"], r["temporal"], r["placement"])
                     for r in annotate_mentions(t, lexicon_df(spark, FINDINGS), strategy=strategy).collect())
        assert got == sorted((i, c[0].index(m[0]), *m[1:]) for i, c in enumerate(CASES) for m in c[3])


@pytest.mark.parametrize("strategy", ["automaton", "join"])
def test_overlaps_offsets_and_odd_reports(spark, strategy):
    """Leftmost and longest without overlaps; terms spelt alike both count; a term wins over another's plural."""
    terms = ["left lung", "lung base", "base", "Left-Lung", "mass", "masses", "opacities", "x y z", "y", None, ""]
    lexicon = spark.createDataFrame(list(enumerate(terms)), "idx int, term string")
    reports = [(1, "The left lung base. Base"), (2, "Masses, mass"), (3, "no opacity"), (4, "x y; x y z"), (5, None), (None, "BASE"), (7, "y"), (7, "y"),
               (7, "no y"), (8, "\u0130\u0130 base \U0001f600 y")]
    t = spark.createDataFrame(reports, "report_id long, TEXT_REPORT string").selectExpr("*", "1 AS idx", "'q' AS term")
    got = sorted(((-1 if r["report_id"] is None else r["report_id"]), r["sent_no"], r["start"], r["end"], r["term"], r["negated"])
                 for r in annotate_mentions(t, lexicon, strategy=strategy).collect())
    assert got == [(-1, 0, 0, 4, "base", False), (1, 0, 4, 13, "Left-Lung", False), (1, 0, 4, 13, "left lung", False), (1, 0, 14, 18, "base", False), (1, 1, 20, 24, "base", False),
                   (2, 0, 0, 6, "masses", False), (2, 0, 8, 12, "mass", False), (3, 0, 3, 10, "opacities", True), (4, 0, 2, 3, "y", False),
                   (4, 0, 5, 10, "x y z", False), (7, 0, 0, 1, "y", False), (7, 0, 0, 1, "y", False), (7, 0, 3, 4, "y", True), (8, 0, 3, 7, "base", False),
                   (8, 0, 10, 11, "y", False)]
    assert annotate_mentions(t.limit(0), lexicon, strategy=strategy).count() == 0
    assert annotate_mentions(t, lexicon.limit(0), strategy=strategy).count() == 0


def test_large_dictionaries_stay_tables(spark, monkeypatch):
    from kappaflow.operators import annotate
    monkeypatch.setattr(annotate, "MAX_TERMS", 3)
    lexicon = spark.createDataFrame([(i, f"term {i}") for i in range(10)], "idx int, term string")
    t = spark.createDataFrame([(1, "Term 7 and terms 8.")], "report_id long, TEXT_REPORT string")
    assert [r["term"] for r in annotate_mentions(t, lexicon).collect()] == ["term 7"]
    with pytest.raises(ValueError, match="more than 3"):
        annotate_mentions(t, lexicon, strategy="automaton")
