"""Queries: distributions, review lists and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as G
from ..functions.text import class_name, clean_text
from ..operators import profile as P
from ..sources import adapters as A
from .registry import register

GCOLS = ["priority_manual", "priority_algo_grouped", "priority_llm_grouped", "judge_grade_grouped",
         "priority_hybrid_grouped"]


def _grp(x):
    return f"CASE WHEN {x} <= 2 THEN 0 WHEN {x} <= 4 THEN 1 ELSE 2 END"


GROUPED_CTE = [("gg", f"""SELECT report_id, priority_manual, {_grp('priority_algo')} AS priority_algo_grouped,
  {_grp('priority_llm')} AS priority_llm_grouped, {_grp('judge_grade')} AS judge_grade_grouped,
  {_grp('priority_hybrid')} AS priority_hybrid_grouped FROM graded""")]


def _g(body, extra=None):
    return A.with_views(["graded"], body, GROUPED_CTE + (extra or []))


def _grouped(spark, sf):
    return P.grouped_columns(A.graded(spark, sf))


@register("system_frequency", A.with_views(["mentions"], """
SELECT system, count(*) AS frequency FROM mentions
WHERE kind = 'finding' AND system IS NOT NULL GROUP BY system"""))
def q_system_frequency(spark, sf):
    return P.system_frequency(A.mentions(spark, sf))


CELLS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM gg" for c in GCOLS)


@register("grade_histogram", _g(f"""
SELECT c."column", CAST(b.b AS DOUBLE) AS bin_start, count(x.value) AS n
FROM (SELECT DISTINCT "column" FROM ({CELLS_SQL}) z) c CROSS JOIN (VALUES (0), (1), (2)) b(b)
LEFT JOIN ({CELLS_SQL}) x ON x."column" = c."column"
  AND ((x.value >= b.b AND x.value < b.b + 1) OR (b.b = 2 AND x.value = 3))
GROUP BY c."column", b.b"""))
def q_grade_histogram(spark, sf):
    return P.grade_histogram(_grouped(spark, sf), GCOLS)


@register("error_histogram", _g("""
SELECT m.method, e.e AS error, count(x.method) AS n
FROM (SELECT 'Algo' AS method UNION ALL SELECT 'LLM' UNION ALL SELECT 'Judge' UNION ALL SELECT 'Hybrid') m
CROSS JOIN range(-2, 3) e(e)
LEFT JOIN (SELECT 'Algo' AS method, priority_algo_grouped - priority_manual AS err FROM gg
           UNION ALL SELECT 'LLM', priority_llm_grouped - priority_manual FROM gg
           UNION ALL SELECT 'Judge', judge_grade_grouped - priority_manual FROM gg
           UNION ALL SELECT 'Hybrid', priority_hybrid_grouped - priority_manual FROM gg) x
  ON x.method = m.method AND x.err = e.e
GROUP BY m.method, e.e"""))
def q_error_histogram(spark, sf):
    return P.error_histogram(G.methods_long(A.graded(spark, sf)))


@register("box_summary", _g(f"""
WITH q AS (SELECT "column", count(*) AS count, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM ({CELLS_SQL}) z WHERE value IS NOT NULL GROUP BY "column")
SELECT q."column", q.count, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       coalesce(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), q1) AS whisker_low,
       coalesce(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), q3) AS whisker_high,
       CAST(sum(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT)
         AS n_outliers
FROM q JOIN ({CELLS_SQL}) c ON c."column" = q."column"
GROUP BY q."column", q.count, q1, median, q3"""))
def q_box_summary(spark, sf):
    return P.box_summary(_grouped(spark, sf), GCOLS)


UNDER = "priority_manual >= 1 AND priority_hybrid_grouped = 0"


@register("undergraded", _g(f"SELECT * FROM gg WHERE {UNDER}"))
def q_undergraded(spark, sf):
    return P.undergraded(_grouped(spark, sf))


@register("undergraded_llm", _g("SELECT * FROM gg WHERE priority_manual >= 1 AND priority_llm_grouped = 0"))
def q_undergraded_llm(spark, sf):
    return P.undergraded(_grouped(spark, sf), pred_col="priority_llm_grouped")


OVER = "priority_manual = 0 AND priority_hybrid_grouped >= 1"


@register("overgraded", _g(f"SELECT * FROM gg WHERE {OVER}"))
def q_overgraded(spark, sf):
    return P.overgraded(_grouped(spark, sf))


@register("review_sample", _g(f"""
SELECT * FROM gg WHERE {OVER} ORDER BY sha256('42:' || CAST(report_id AS VARCHAR)), report_id LIMIT 20"""))
def q_review_sample(spark, sf):
    return P.review_sample(P.overgraded(_grouped(spark, sf)), 20, 42)


@register("drop_incomplete", A.with_views(["graded"], """
SELECT * FROM graded WHERE priority_manual IS NOT NULL AND priority_algo IS NOT NULL AND priority_llm IS NOT NULL"""))
def q_drop_incomplete(spark, sf):
    return P.drop_incomplete(A.graded(spark, sf), ["priority_manual", "priority_algo", "priority_llm"])


@register("row_range", A.with_views(["graded"], "SELECT * FROM graded WHERE report_id >= 100 AND report_id <= 4999"))
def q_row_range(spark, sf):
    """The feature itself: an inclusive range with both bounds."""
    return P.row_range(A.graded(spark, sf), 100, 4999)


@register("class_names", _g("""
SELECT CASE priority_manual WHEN 0 THEN 'Normal' WHEN 1 THEN 'Actionable' WHEN 2 THEN 'Critical' END AS class_name,
       count(*) AS n FROM gg GROUP BY priority_manual"""))
def q_class_names(spark, sf):
    g = _grouped(spark, sf).groupBy(class_name("priority_manual").alias("class_name"))
    return g.agg(F.count(F.lit(1)).alias("n"))


@register("duplicate_reports", A.with_views(["reports"], f"""
SELECT count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_reports,
       CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_sharing_a_text
FROM (SELECT {A.clean_sql('TEXT_REPORT')} AS t, count(*) AS n FROM reports GROUP BY 1) z"""))
def q_duplicate_reports(spark, sf):
    """Q22: how many reports share their cleaned text with another."""
    return P.duplicate_texts(A.reports(spark, sf).select(clean_text("TEXT_REPORT").alias("TEXT_REPORT")))


@register("rename_if_absent", A.with_views(["graded"], """
SELECT report_id, priority_manual, priority_algo, priority_llm, judge_grade, priority_hybrid FROM graded"""))
def q_rename_if_absent(spark, sf):
    g = A.graded(spark, sf)
    staged = g.select("report_id", F.col("priority_manual").alias("GROUND_TRUTH"),
                      F.col("priority_algo").alias("overall_max_priority"),
                      F.col("priority_llm").alias("llm_grade"), "judge_grade",
                      F.col("priority_hybrid").alias("hybrid_grade"))
    return P.rename_if_absent(staged, P.PIPELINE_RENAMES)
