"""Queries: the grading methods over recorded model responses.

The provider is ``ReplayModel`` over ``adapters.replay_responses``: the
answer to each distinct request is a join, so the oracle can state the
expected result.  Equal prompts are sent once (M3): every report gets the
answer recorded for the smallest report id with the same prompt, which the
oracles reproduce with a window over the prompt inputs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text
from ..sources import adapters as A
from . import methods as M
from ..session import stage_root
from .model import (PandasModel, ReplayModel, RuleModel, append_cache, cached_model_call, compact_cache, read_cache, stage_table,
                    timed_stage)
from .q_grading import codes_sql
from .q_text import CL_CTE, clean_sql, fill_sql
from .registry import register


def _model(spark, sf):
    return ReplayModel(A.replay_responses(spark, sf), by=("method", "report_id"))


def _input(spark, sf):
    """Cleaned reports with the recorded grades of the same ids."""
    return A.reports_with_truth(spark, sf).withColumn("TEXT_REPORT", clean_text("TEXT_REPORT"))


def _judge_input(spark, sf):
    """``_input`` for the judge; the digests are taken before the join with the grades, so its texts stay where they are read."""
    r = A.reports(spark, sf).withColumn("TEXT_REPORT", clean_text("TEXT_REPORT"))
    r = r.withColumn(M.DIGEST, M.text_digest(F.col("TEXT_REPORT")))
    return r.join(A.graded(spark, sf).drop("judge_grade"), "report_id")


def _q(body, extra=None):
    return A.with_views(["reports_with_truth"], body, [CL_CTE] + (extra or []))


def _s(x):
    return f"coalesce(CAST({x} AS VARCHAR), '')"


LLM_CTES = [
    ("lr", "SELECT report_id, min(report_id) OVER (PARTITION BY txt) AS rep FROM cl"),
    ("lx", """SELECT lr.report_id, r.priority_llm AS g, lr.rep % 10 AS v FROM lr JOIN cl r ON r.report_id = lr.rep"""),
    ("llm_out", """SELECT report_id, CAST(CASE WHEN v IN (5, 7, 9) THEN 0 ELSE g END AS INT) AS llm_grade,
                     CASE WHEN v IN (5, 9) THEN 'no_json' WHEN v = 7 THEN 'malformed' ELSE 'ok' END AS llm_status
                   FROM lx"""),
]


@register("grade_llm", _q("SELECT * FROM llm_out", LLM_CTES))
def q_grade_llm(spark, sf):
    return M.grade_llm(_input(spark, sf), _model(spark, sf)).select("report_id", "llm_grade", "llm_status")


HYB_CTES = [
    ("hr", f"SELECT report_id, min(report_id) OVER (PARTITION BY txt, {_s('priority_algo')}) AS rep FROM cl"),
    ("hx", """SELECT hr.report_id, r.priority_hybrid AS h, r.priority_algo AS a, hr.rep % 10 AS v
              FROM hr JOIN cl r ON r.report_id = hr.rep"""),
]


@register("grade_hybrid", _q("""
SELECT report_id, CAST(CASE WHEN v = 5 THEN 0 ELSE h END AS INT) AS hybrid_grade,
       CASE WHEN v = 5 THEN '' WHEN h = a THEN 'agree' ELSE 'disagree' END AS hybrid_explanation,
       CASE WHEN v = 5 THEN 'no_json' ELSE 'ok' END AS hybrid_status FROM hx""", HYB_CTES))
def q_grade_hybrid(spark, sf):
    lx = A.lexicon(spark, sf)
    return M.grade_hybrid(_input(spark, sf), _model(spark, sf), lx, lx, semialgo_col="priority_algo").select(
        "report_id", "hybrid_grade", "hybrid_explanation", "hybrid_status")


def judge_ctes(src: str, algo: str, llm: str, manual: str):
    """Expected judge columns for rows of ``src`` (report_id, txt, <algo>, <llm>, <manual>)."""
    return [
        ("j0", f"""SELECT s.report_id, s.txt, s.{algo} AS a, s.{llm} AS l, s.{manual} AS m,
                     NOT coalesce(s.{algo} = s.{llm}, false) AS need1 FROM {src} s"""),
        ("j1", f"""SELECT *, CASE WHEN need1 THEN min(report_id) OVER (PARTITION BY need1, txt, {_s('a')}, {_s('l')})
                   END AS rep1 FROM j0"""),
        ("j1x", """SELECT j1.*, r.judge_grade AS jg, r.priority_algo AS fa, r.priority_llm AS fl
                   FROM j1 LEFT JOIN cl r ON r.report_id = j1.rep1"""),
        ("j2", """SELECT *, CASE WHEN need1 THEN jg ELSE a END AS g1,
                     CASE WHEN need1 THEN (CASE WHEN jg = fa THEN 1 WHEN jg = fl THEN 2 ELSE 0 END) ELSE 3 END AS c1,
                     CASE WHEN need1 THEN 'inner' END AS e1,
                     (NOT need1) OR jg <> 0 AS ok1 FROM j1x"""),
        ("j3", """SELECT *, ok1 AND NOT coalesce(m = g1, false) AS need2 FROM j2"""),
        ("j4", f"""SELECT *, CASE WHEN need2 THEN min(report_id) OVER (PARTITION BY need2, txt, {_s('g1')}, {_s('m')})
                   END AS rep2 FROM j3"""),
        ("j5", """SELECT j4.*, greatest(1, r.priority_hybrid) AS eg, r.priority_manual AS fm, j4.rep2 % 10 AS v2
                  FROM j4 LEFT JOIN cl r ON r.report_id = j4.rep2"""),
        ("j6", """SELECT *, ok1 AND ((NOT need2) OR v2 <> 7) AS ok FROM j5"""),
        ("judge_out", """SELECT report_id,
             CAST(CASE WHEN ok THEN g1 ELSE 0 END AS INT) AS judge_grade,
             CAST(CASE WHEN ok THEN c1 ELSE 0 END AS INT) AS judge_choice,
             CASE WHEN ok THEN e1 ELSE '' END AS judge_reasoning,
             CAST(CASE WHEN NOT ok THEN 0 WHEN need2 THEN eg ELSE g1 END AS INT) AS judge_grade_ext,
             CAST(CASE WHEN NOT ok THEN 0 WHEN need2 THEN (CASE WHEN eg = fm THEN 2 ELSE 1 END) ELSE 3 END AS INT)
               AS judge_choice_ext,
             CASE WHEN NOT ok THEN '' WHEN need2 THEN 'outer' END AS judge_reasoning_ext FROM j6"""),
    ]


JUDGE_COLS = ["judge_grade", "judge_choice", "judge_reasoning", "judge_grade_ext", "judge_choice_ext",
              "judge_reasoning_ext"]


@register("grade_judge", _q("SELECT * FROM judge_out", judge_ctes("cl", "priority_algo", "priority_llm",
                                                                  "priority_manual")))
def q_grade_judge(spark, sf):
    d = _judge_input(spark, sf)
    return M.grade_judge(d, _model(spark, sf), stage="judge", digest_col=M.DIGEST).select("report_id", *JUDGE_COLS)


# Method 1 through the model: the extraction recorded for the representative
# report is its mention list, so the expected grade is the long-form grade.
SEMI_CTES = [
    ("sr", "SELECT report_id, min(report_id) OVER (PARTITION BY txt) AS rep FROM cl"),
]


def _semi_body():
    from .q_grading import grade_sql_body
    return f"""
WITH {codes_sql().strip()},
gr AS ({grade_sql_body().strip()})
SELECT sr.report_id, gr.max_finding_priority, gr.max_line_priority, gr.max_diagnosis_priority,
       gr.overall_max_priority, CASE WHEN gr.report_id IS NULL THEN 'no_response' ELSE 'ok' END AS semialgo_status
FROM sr LEFT JOIN gr ON gr.report_id = sr.rep"""


SEMI_COLS = ["max_finding_priority", "max_line_priority", "max_diagnosis_priority", "overall_max_priority",
             "semialgo_status"]


@register("grade_semialgo_model", A.with_views(["lexicon", "mentions", "reports_with_truth"], _semi_body(),
                                               [CL_CTE] + SEMI_CTES))
def q_grade_semialgo_model(spark, sf):
    lx = A.lexicon(spark, sf)
    return M.grade_semialgo(_input(spark, sf), _model(spark, sf), lx, lx, lx).select("report_id", *SEMI_COLS)


@register("cached_model_call", _q("""
SELECT lr.report_id, lr.rep % 2 = 0 AS cached, CASE WHEN lr.rep % 2 = 0 THEN 'cached: ' ELSE '' END || r.payload AS payload
FROM lr JOIN (SELECT report_id,
  CASE WHEN report_id % 10 = 3 THEN 'Sure: {"grade": ' || CAST(priority_llm AS VARCHAR) || '} done'
       WHEN report_id % 10 = 5 THEN '{"grade": ' || CAST(priority_llm AS VARCHAR)
       WHEN report_id % 10 = 7 THEN '{"grade": "high"}'
       WHEN report_id % 10 = 9 THEN 'I cannot grade this report.'
       ELSE '{"grade": ' || CAST(priority_llm AS VARCHAR) || '}' END AS payload FROM cl) r ON r.report_id = lr.rep""",
    LLM_CTES[:1]))
def q_cached_model_call(spark, sf):
    """Half of the keys are in the cache, one of them twice over; the model answers the others."""
    d = _input(spark, sf)
    req = M.with_requests(d, "llm", {"rpt": F.col("TEXT_REPORT")}, "model")
    first = req.groupBy("request_key").agg(F.min("report_id").alias("report_id")).where(F.col("report_id") % 2 == 0)
    known = A.replay_responses(spark, sf).where(F.col("method") == "llm").join(first, "report_id").select(
        "request_key", F.concat(F.lit("cached: "), "payload").alias("payload"))
    return cached_model_call(req, _model(spark, sf), cache=known.union(known)).select("report_id", "cached", "payload")


def _called(client, messages, method):
    """A model for the fixture: it reads the whole prompt and fails on some."""
    n = len(messages[-1]["content"])
    if n % 11 == 0:
        raise RuntimeError("refused")
    return '{"grade": %d}' % (1 + n % 5)


@register("model_call", A.with_views(["reports_with_truth"], f"""
SELECT report_id, CASE WHEN n % 11 <> 0 THEN '{{"grade": ' || CAST(1 + n % 5 AS VARCHAR) || '}}' END AS payload,
       CASE WHEN n % 11 = 0 THEN 'RuntimeError: refused' END AS error
FROM (SELECT report_id, length({fill_sql('llm', {'rpt': 'txt'})}) AS n FROM cl) z""", [CL_CTE]))
def q_model_call(spark, sf):
    """A callable run in tasks, one client each, errors kept by row."""
    req = M.with_requests(_input(spark, sf), "llm", {"rpt": F.col("TEXT_REPORT")}, "model")
    return cached_model_call(req, PandasModel(_called)).select("report_id", "payload", "error")


def _scored(row):
    if row["report_id"] % 13 == 0:
        raise ValueError("not this one")
    return {"n_chars": len(row["TEXT_REPORT"]), "start": row["TEXT_REPORT"][:8]}


@register("score_rows", A.with_views(["reports"], """
SELECT report_id, CASE WHEN report_id % 13 <> 0 THEN length(TEXT_REPORT) END AS n_chars,
       CASE WHEN report_id % 13 <> 0 THEN substr(TEXT_REPORT, 1, 8) END AS start FROM reports"""))
def q_score_rows(spark, sf):
    """A function of one row whose dictionary becomes columns."""
    schema = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("start", T.StringType())])
    return M.score_rows(A.reports(spark, sf), _scored, schema).select("report_id", "n_chars", "start")


@register("stage_checkpoint", A.with_views(["graded"], "SELECT * FROM graded"))
def q_stage_checkpoint(spark, sf):
    # Writes the stage table (an action) and returns the table read back.
    return stage_table(A.graded(spark, sf), "graded")


@register("stage_stats", _q("""
SELECT 'llm' AS stage, llm_status AS status, count(*) AS n FROM llm_out GROUP BY llm_status""", LLM_CTES))
def q_stage_stats(spark, sf):
    g = M.grade_llm(_input(spark, sf), _model(spark, sf))
    return g.groupBy(F.lit("llm").alias("stage"), F.col("llm_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


@register("timed_stage", _q("""
SELECT 'llm' AS stage, (SELECT count(*) FROM cl) AS rows, (SELECT count(*) FROM llm_out WHERE llm_status <> 'ok') AS failures,
       true AS has_seconds, true AS has_seconds_per_row""", LLM_CTES))
def q_timed_stage(spark, sf):
    """Rows and failures of a stage as observed while it is written; the seconds differ from run to run."""
    g = M.grade_llm(_input(spark, sf), _model(spark, sf)).select("report_id", "llm_grade", "llm_status")
    _, stats = timed_stage(g, "timed-llm", "llm_status")
    row = (stats["stage"].split("-")[-1], stats["rows"], stats["failures"], stats["seconds"] > 0, (stats["seconds_per_row"] or 0) > 0)
    return spark.createDataFrame([row], "stage string, rows long, failures long, has_seconds boolean, has_seconds_per_row boolean")


@register("rule_model", A.with_views(["case_lines"], """
SELECT report_id, CAST(max(grade) AS INT) AS llm_grade, 'ok' AS llm_status FROM case_lines GROUP BY report_id"""))
def q_rule_model(spark, sf):
    """The offline provider, whose answers go through the same request keys and decoder as any model's."""
    return M.grade_llm(A.case_reports(spark, sf), RuleModel()).select("report_id", "llm_grade", "llm_status")


def _cache_sql():
    return A.with_views(["reports_with_truth"], "SELECT count(DISTINCT txt) AS n_keys, count(DISTINCT txt) AS n_rows, true AS same_answers FROM cl", [CL_CTE])


@register("compacted_cache", _cache_sql())
def q_compacted_cache(spark, sf):
    """M3: answers appended by two runs, the second with some again, merged to one row a key."""
    req = M.with_requests(_input(spark, sf), "llm", {"rpt": F.col("TEXT_REPORT")}, "model")
    path = f"{stage_root(spark)}/cache-{uuid.uuid4().hex[:12]}"
    answers = req.select("request_key", F.concat(F.lit("a"), F.substring("request_key", 1, 8)).alias("payload")).distinct()
    append_cache(answers, path)
    append_cache(answers.where(F.substring("request_key", 1, 1) < "8"), path)
    compact_cache(spark, path)
    now = read_cache(spark, path)
    same = F.every(F.col("payload") == F.concat(F.lit("a"), F.substring("request_key", 1, 8)))
    return now.agg(F.count_distinct("request_key").alias("n_keys"), F.count(F.lit(1)).alias("n_rows"), same.alias("same_answers"))


def _all_sql():
    from .q_grading import grade_sql_body
    ctes = [CL_CTE, ("gr", grade_sql_body().strip()),
            ("sr", "SELECT report_id, txt, priority_manual, min(report_id) OVER (PARTITION BY txt) AS rep FROM cl"),
            ("pa", """SELECT sr.report_id, sr.txt, sr.priority_manual AS pm, gr.overall_max_priority AS pa
                      FROM sr LEFT JOIN gr ON gr.report_id = sr.rep"""),
            ("ph", f"SELECT pa.*, min(report_id) OVER (PARTITION BY txt, {_s('pa')}) AS hrep FROM pa"),
            ("ph2", """SELECT ph.*, CASE WHEN ph.hrep % 10 = 5 THEN 0 ELSE r.priority_hybrid END AS hyb,
                              min(ph.report_id) OVER (PARTITION BY ph.txt) AS lrep
                       FROM ph JOIN cl r ON r.report_id = ph.hrep"""),
            ("plx", """SELECT ph2.*, CASE WHEN ph2.lrep % 10 IN (5, 7, 9) THEN 0 ELSE r.priority_llm END AS pll
                       FROM ph2 JOIN cl r ON r.report_id = ph2.lrep""")]
    ctes += judge_ctes("plx", "pa", "pll", "pm")
    body = """SELECT p.report_id, p.pm AS priority_manual, p.pa AS priority_algo, p.hyb AS priority_hybrid,
       p.pll AS priority_llm, j.judge_grade, j.judge_choice, j.judge_reasoning, j.judge_grade_ext,
       j.judge_choice_ext, j.judge_reasoning_ext
FROM plx p JOIN judge_out j ON j.report_id = p.report_id"""
    s = A.with_views(["lexicon", "mentions", "reports_with_truth"], "SELECT 1", ctes[:1])
    head = s[: s.rindex("SELECT 1")].rstrip()
    rest = ",\n".join(f"{n} AS ({q.strip()})" for n, q in ctes[1:])
    return head + ",\n" + codes_sql().strip() + ",\n" + rest + "\n" + body


@register("grade_all_methods", _all_sql())
def q_grade_all_methods(spark, sf):
    lx = A.lexicon(spark, sf)
    d = A.reports_with_truth(spark, sf).select("report_id", "TEXT_REPORT",
                                               F.col("priority_manual").alias("GROUND_TRUTH"))
    out = M.grade_all_methods(d, _model(spark, sf), lx, lx, lx)
    return out.select("report_id", "priority_manual", "priority_algo", "priority_hybrid", "priority_llm",
                      *JUDGE_COLS)
