"""Queries: dictionary comparison, regrading, term list, judge choice labels."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions.text import choice_label
from ..operators.annotate import annotate_mentions
from ..operators.lexicon_ops import grade_with, lexicon_diff, regrade_changed, regrade_with_lexicon
from ..session import stage_root
from ..sources import adapters as A
from ..sources.dictionaries import FINDINGS, FINDINGS_ALT, lexicon_df
from ..sources.files import lexicon_scan, write_lexicon_json
from . import methods as M
from .q_grading import codes_sql, grade_sql_body
from .q_models import JUDGE_COLS, _judge_input, _model, _q as _mq, judge_ctes
from .registry import register


@register("lexicon_diff", A.with_views(["lexicon_alt"], """
SELECT coalesce(a.term, b.term) AS term, a.idx AS idx_a, b.idx AS idx_b, a.priority AS priority_a,
       b.priority AS priority_b,
       CASE WHEN a.idx IS NULL THEN 'added' WHEN b.idx IS NULL THEN 'removed'
            WHEN a.priority <> b.priority THEN 'changed' ELSE 'same' END AS status
FROM lexicon a FULL OUTER JOIN lexicon_alt b ON a.term = b.term"""))
def q_lexicon_diff(spark, sf):
    return lexicon_diff(A.lexicon(spark, sf), A.lexicon_alt(spark, sf))


def _second(sql: str) -> str:
    """The grading CTE chain over lexicon_alt, names suffixed _b."""
    for n in ("terms", "ex", "nr", "codes", "enc", "pri"):
        sql = re.sub(rf"\b{n}\b", f"{n}_b", sql)
    return re.sub(r"\blexicon\b", "lexicon_alt", sql)


def _regrade_sql() -> str:
    s = A.with_views(["lexicon_alt", "mentions"], "SELECT 1")
    head = s[: s.rindex("SELECT 1")].rstrip()
    return (head + ",\n" + codes_sql().strip() + ",\n" + _second(codes_sql()).strip()
            + f",\nga AS ({grade_sql_body('pri').strip()}),\ngb AS ({grade_sql_body('pri_b').strip()})\n"
            + """SELECT ga.overall_max_priority AS overall_a, gb.overall_max_priority AS overall_b, count(*) AS n,
       count(CASE WHEN ga.overall_max_priority <> gb.overall_max_priority THEN 1 END) AS n_changed
FROM ga FULL OUTER JOIN gb ON ga.report_id = gb.report_id GROUP BY 1, 2""")


@register("regrade_with_lexicon", _regrade_sql())
def q_regrade_with_lexicon(spark, sf):
    return regrade_with_lexicon(A.mentions(spark, sf), A.lexicon(spark, sf), A.lexicon_alt(spark, sf))


def _delta_sql() -> str:
    s = _regrade_sql()
    head = s[: s.rindex("SELECT ga.overall_max_priority")]
    return head + """SELECT gb.*, ga.report_id IN (SELECT m.report_id FROM mentions m JOIN codes x ON x.kind = m.kind AND x.term_raw = m.term_raw
         JOIN codes_b y ON y.kind = m.kind AND y.term_raw = m.term_raw WHERE x.priority IS DISTINCT FROM y.priority) AS regraded
FROM gb JOIN ga ON ga.report_id = gb.report_id"""


def _near_copy(spark, sf):
    """The dictionary with other priorities for a few terms, and one term less: a revision."""
    lx = A.lexicon(spark, sf)
    return lx.where("idx <> 5").withColumn("priority", F.when(F.col("idx") % 20 == 3, 6 - F.col("priority")).otherwise(F.col("priority")).cast("int"))


def _revised(sql: str) -> str:
    return sql.replace("SELECT idx, term, CAST(6 - priority AS INT) AS priority FROM lexicon WHERE idx % 10 <> 9",
                       "SELECT idx, term, CAST(CASE WHEN idx % 20 = 3 THEN 6 - priority ELSE priority END AS INT) AS priority FROM lexicon WHERE idx <> 5")


@register("regrade_changed", _revised(_delta_sql()))
def q_regrade_changed(spark, sf):
    """M6 where the grades under the first dictionary are there: only touched reports are graded again."""
    m, a = A.mentions(spark, sf), A.lexicon(spark, sf)
    return regrade_changed(grade_with(m, a), m, a, _near_copy(spark, sf))


@register("term_list", A.with_views(["lexicon"], "SELECT count(*) AS n_terms, string_agg(term, ', ' ORDER BY idx) AS terms FROM lexicon"))
def q_term_list(spark, sf):
    lx = A.lexicon(spark, sf)
    return lx.agg(F.count(F.lit(1)).alias("n_terms")).withColumn("terms", M.term_list(lx))


_LABEL_SQL = ("CASE {c} WHEN 0 THEN 'Neither grade is appropriate' WHEN 1 THEN 'Algorithm grade is better' "
              "WHEN 2 THEN 'Manual grade is better' WHEN 3 THEN 'Both grades are the same' END")


@register("choice_label", _mq(f"""
SELECT report_id, judge_choice, {_LABEL_SQL.format(c='judge_choice')} AS choice_label,
       judge_choice_ext, {_LABEL_SQL.format(c='judge_choice_ext')} AS choice_label_ext FROM judge_out""",
    judge_ctes("cl", "priority_algo", "priority_llm", "priority_manual")))
def q_choice_label(spark, sf):
    d = _judge_input(spark, sf)
    j = M.grade_judge(d, _model(spark, sf), stage="judge-labels", digest_col=M.DIGEST).select("report_id", *JUDGE_COLS)
    return j.select("report_id", "judge_choice", choice_label("judge_choice").alias("choice_label"),
                    "judge_choice_ext", choice_label("judge_choice_ext").alias("choice_label_ext"))


def _dictionary_values(d: dict[str, int]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + t.replace("'", "''") + f"', {p})" for t, p in d.items()) + ") AS v(term, priority)"


@register("alternative_dictionary", A.with_views(["case_lines", "case_terms"], """
SELECT l.report_id, CAST(max(f.priority) AS INT) AS priority_first, CAST(max(g.priority) AS INT) AS priority_second
FROM case_lines l JOIN case_terms t ON t.case_no = l.case_no AND NOT t.negated
JOIN first_dict f ON f.term = t.term LEFT JOIN second_dict g ON g.term = t.term GROUP BY l.report_id""",
    [("first_dict", _dictionary_values(FINDINGS)), ("second_dict", _dictionary_values(FINDINGS_ALT))]))
def q_alternative_dictionary(spark, sf):
    """What the reports affirm under the first dictionary and under the alternative one, both read from stored JSON files."""
    read = {}
    for name, d in (("first", FINDINGS), ("second", FINDINGS_ALT)):
        path = f"{stage_root(spark)}/dictionary-{uuid.uuid4().hex[:12]}"
        write_lexicon_json(lexicon_df(spark, d), path)
        read[name] = lexicon_scan(spark, path).select("idx", "term", "priority")
    found = annotate_mentions(A.case_reports(spark, sf), read["first"]).where("NOT negated").select("report_id", "term")
    both = found.join(read["first"].select("term", F.col("priority").alias("p1")), "term").join(
        read["second"].select("term", F.col("priority").alias("p2")), "term", "left")
    return both.groupBy("report_id").agg(F.max("p1").alias("priority_first"), F.max("p2").alias("priority_second"))
