"""Queries: offline annotation, diagnosis cues and rule grading on planted reports (M1, M2, M4)."""

from __future__ import annotations

from ..operators import annotate as N
from ..sources import adapters as A
from ..sources.dictionaries import FINDINGS, lexicon_df
from .registry import ORACLES, register


def _q(body, views=("annotated_reports",), extra=None):
    return A.with_views(list(views), body, extra)


@register("annotate_mentions", _q("""
SELECT m.report_id, l.idx, l.term,
       (m.kind <> 'diagnosis' AND m.mention_id % 7 = 0) AS negated,
       CASE WHEN m.kind <> 'diagnosis' AND m.mention_id % 7 <> 0 AND m.uncertainty = 1 THEN 1 ELSE 0 END
         AS uncertainty,
       CASE WHEN m.kind = 'diagnosis' THEN 4 ELSE m.temporal END AS temporal,
       CASE WHEN m.kind = 'device' THEN m.placement ELSE 3 END AS placement
FROM mentions m JOIN lexicon l ON m.term_raw IN (l.term, l.term || 's', l.term || 'es')
WHERE m.report_id IN (SELECT report_id FROM annotated_reports)
  AND (m.kind <> 'diagnosis' OR m.mention_id % 4 = 3)""", ("annotated_reports", "lexicon")))
def q_annotate_mentions(spark, sf):
    a = N.annotate_mentions(A.annotated_reports(spark, sf), A.lexicon(spark, sf))
    return a.select("report_id", "idx", "term", "negated", "uncertainty", "temporal", "placement")


@register("annotate_mentions_ngram", ORACLES["annotate_mentions"])
def q_annotate_mentions_ngram(spark, sf):
    """M1 with the dictionary left a table, joined by first words and words."""
    a = N.annotate_mentions(A.annotated_reports(spark, sf), A.lexicon(spark, sf), strategy="join")
    return a.select("report_id", "idx", "term", "negated", "uncertainty", "temporal", "placement")


@register("diagnosis_cues", _q("""
SELECT report_id, CASE mention_id % 4 WHEN 0 THEN 'Pneumonia' WHEN 1 THEN 'Lung cancer' ELSE 'P1 finding' END
       AS diagnosis
FROM mentions WHERE kind = 'diagnosis' AND mention_id % 4 <> 2
  AND report_id IN (SELECT report_id FROM annotated_reports)"""))
def q_diagnosis_cues(spark, sf):
    return N.diagnosis_cues(A.annotated_reports(spark, sf)).select("report_id", "diagnosis")


# By construction: the planted line of each mention says what it is worth; no pattern is read.
@register("rule_grade", _q("""
SELECT r.report_id, CAST(coalesce(max(CASE
         WHEN m.kind = 'diagnosis' THEN CASE m.mention_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 3 THEN 5 END
         WHEN m.mention_id % 7 = 0 THEN NULL
         WHEN m.kind = 'device' AND m.placement = 2 THEN 5 END), 1) AS INT) AS grade
FROM annotated_reports r JOIN mentions m ON m.report_id = r.report_id GROUP BY r.report_id"""))
def q_rule_grade(spark, sf):
    return N.rule_grade(A.annotated_reports(spark, sf))


@register("annotate_mentions_regex", ORACLES["annotate_mentions"])
def q_annotate_mentions_regex(spark, sf):
    """M1 with the dictionary as one automaton in the tasks."""
    a = N.annotate_mentions(A.annotated_reports(spark, sf), A.lexicon(spark, sf), strategy="automaton")
    return a.select("report_id", "idx", "term", "negated", "uncertainty", "temporal", "placement")


# Sentences whose reading is known by their place in a list (see adapters.CASES).
@register("scoped_mentions", _q("""
SELECT l.report_id, CAST(l.sent_no AS INT) AS sent_no, t.term, t.negated, t.uncertainty, t.temporal, t.placement,
       CAST(l.line_start + strpos(l.sentence, t.surface) - 1 AS INT) AS start
FROM case_lines l JOIN case_terms t ON t.case_no = l.case_no""", ("case_lines", "case_terms")))
def q_scoped_mentions(spark, sf):
    a = N.annotate_mentions(A.case_reports(spark, sf), lexicon_df(spark, FINDINGS))
    return a.select("report_id", "sent_no", "term", "negated", "uncertainty", "temporal", "placement", "start")


@register("scoped_mentions_join", ORACLES["scoped_mentions"])
def q_scoped_mentions_join(spark, sf):
    """The same with the dictionary left a table."""
    a = N.annotate_mentions(A.case_reports(spark, sf), lexicon_df(spark, FINDINGS), strategy="join")
    return a.select("report_id", "sent_no", "term", "negated", "uncertainty", "temporal", "placement", "start")


@register("scoped_rule_grade", _q("SELECT report_id, CAST(max(grade) AS INT) AS grade FROM case_lines GROUP BY report_id", ("case_lines",)))
def q_scoped_rule_grade(spark, sf):
    return N.rule_grade(A.case_reports(spark, sf))


@register("scoped_diagnosis_cues", _q("SELECT report_id, diagnosis FROM case_lines WHERE diagnosis IS NOT NULL", ("case_lines",)))
def q_scoped_diagnosis_cues(spark, sf):
    return N.diagnosis_cues(A.case_reports(spark, sf)).select("report_id", "diagnosis")
