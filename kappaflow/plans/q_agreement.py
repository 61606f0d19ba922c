"""Queries: agreement metrics on ``graded`` and ``scored``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as G
from ..sources import adapters as A
from . import registry

DIGITS = {"mcnemar_exact": 10}


def register(name: str, sql: str):
    """Register a query that rounds its fractions for display; the operators do not round."""
    def deco(fn):
        def shown(spark, sf):
            df = fn(spark, sf)
            return df.select(*[F.round(c, DIGITS.get(name, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        registry.register(name, sql)(shown)
        return fn
    return deco

# Oracle: the same stacking and grouping written directly on rows.
LONG_SQL = [
    ("long", """
SELECT report_id, priority_manual AS truth, 'Algo' AS method, priority_algo AS grade FROM graded
UNION ALL SELECT report_id, priority_manual, 'LLM', priority_llm FROM graded
UNION ALL SELECT report_id, priority_manual, 'Judge', judge_grade FROM graded
UNION ALL SELECT report_id, priority_manual, 'Hybrid', priority_hybrid FROM graded"""),
    ("lg", "SELECT *, CASE WHEN grade <= 2 THEN 0 WHEN grade <= 4 THEN 1 ELSE 2 END AS pred FROM long"),
    ("bin", """SELECT method, CASE WHEN truth >= 1 THEN 1 ELSE 0 END AS t,
               CASE WHEN pred >= 1 THEN 1 ELSE 0 END AS p FROM lg"""),
    ("bc", """SELECT method, sum(CASE WHEN t = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN t = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN t = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn,
              sum(CASE WHEN t = 0 AND p = 0 THEN 1 ELSE 0 END) AS tn FROM bin GROUP BY method"""),
]


def _q(body: str, extra=None) -> str:
    return A.with_views(["graded"], body, LONG_SQL + (extra or []))


def _conf(spark, sf):
    return G.confusion(G.methods_long(A.graded(spark, sf)))


def _div(a, b, empty="0.0"):
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {empty} END"


NAN = "CAST('NaN' AS DOUBLE)"


@register("exact_agreement", _q(f"""
SELECT method, round({_div('100.0 * sum(CASE WHEN truth = pred THEN 1 ELSE 0 END)', 'count(*)')}, 6)
       AS exact_agreement_pct, count(*) AS n FROM lg GROUP BY method"""))
def q_exact_agreement(spark, sf):
    return G.exact_agreement(_conf(spark, sf))


@register("confusion_3x3", _q("""
SELECT m.method, t.v AS truth, p.v AS pred, CAST(count(lg.report_id) AS BIGINT) AS n
FROM (SELECT DISTINCT method FROM lg) m CROSS JOIN (VALUES (0), (1), (2)) t(v) CROSS JOIN (VALUES (0), (1), (2)) p(v)
LEFT JOIN lg ON lg.method = m.method AND lg.truth = t.v AND lg.pred = p.v
GROUP BY m.method, t.v, p.v"""))
def q_confusion_3x3(spark, sf):
    return G.confusion_fixed(_conf(spark, sf), [0, 1, 2])


@register("confusion_2x2", _q("""
SELECT m.method, t.v AS truth, p.v AS pred, CAST(count(b.method) AS BIGINT) AS n
FROM (SELECT DISTINCT method FROM lg) m CROSS JOIN (VALUES (0), (1)) t(v) CROSS JOIN (VALUES (0), (1)) p(v)
LEFT JOIN (SELECT method, CASE WHEN truth = 2 THEN 1 ELSE truth END AS tt,
                  CASE WHEN pred = 2 THEN 1 ELSE pred END AS pp FROM lg) b
       ON b.method = m.method AND b.tt = t.v AND b.pp = p.v
GROUP BY m.method, t.v, p.v"""))
def q_confusion_2x2(spark, sf):
    return G.confusion_binary(G.methods_long(A.graded(spark, sf)))


# Kappa written the textbook way: po and pe from label frequencies.
KAPPA_CTES = [
    ("labs", """SELECT method, truth AS label FROM lg WHERE truth IS NOT NULL
                UNION SELECT method, pred FROM lg WHERE truth IS NOT NULL"""),
    ("posn", """SELECT method, label, CAST(dense_rank() OVER (PARTITION BY method ORDER BY label) - 1 AS DOUBLE) AS pos
                FROM labs"""),
    ("tot", "SELECT method, CAST(count(*) AS DOUBLE) AS N FROM lg WHERE truth IS NOT NULL GROUP BY method"),
    ("fr", """SELECT p.method, p.label, p.pos,
                (SELECT count(*) FROM lg WHERE lg.method = p.method AND lg.truth = p.label) AS rt,
                (SELECT count(*) FROM lg WHERE lg.method = p.method AND lg.pred = p.label AND lg.truth IS NOT NULL) AS cp
              FROM posn p"""),
    ("ex", """SELECT f1.method, sum(f1.rt * f2.cp / t.N) AS e_all,
                     sum(CASE WHEN f1.label <> f2.label THEN f1.rt * f2.cp / t.N ELSE 0 END) AS e_off,
                     sum((f1.pos - f2.pos) * (f1.pos - f2.pos) * f1.rt * f2.cp / t.N) AS e_w
              FROM fr f1 JOIN fr f2 ON f1.method = f2.method JOIN tot t ON t.method = f1.method
              GROUP BY f1.method"""),
    ("ob", """SELECT lg.method, sum(CASE WHEN truth <> pred THEN 1 ELSE 0 END) AS o_off,
                     sum((a.pos - b.pos) * (a.pos - b.pos)) AS o_w
              FROM lg JOIN posn a ON a.method = lg.method AND a.label = lg.truth
                      JOIN posn b ON b.method = lg.method AND b.label = lg.pred
              GROUP BY lg.method"""),
]


@register("cohen_kappa", _q(f"""
SELECT ex.method, round(CASE WHEN e_off <> 0 THEN 1 - o_off / e_off ELSE {NAN} END, 6) AS cohen_kappa
FROM ex JOIN ob ON ob.method = ex.method""", KAPPA_CTES))
def q_cohen_kappa(spark, sf):
    return G.cohen_kappa(_conf(spark, sf)).select("method", "cohen_kappa")


@register("cohen_kappa_quadratic", _q(f"""
SELECT ex.method, round(CASE WHEN e_w <> 0 THEN 1 - o_w / e_w ELSE {NAN} END, 6) AS cohen_kappa_quadratic
FROM ex JOIN ob ON ob.method = ex.method""", KAPPA_CTES))
def q_cohen_kappa_quadratic(spark, sf):
    return G.cohen_kappa(_conf(spark, sf)).select("method", "cohen_kappa_quadratic")


BIN_METRICS_SQL = f"""
SELECT method,
  round({_div('tp', 'tp + fp')}, 6) AS precision,
  round({_div('tp', 'tp + fn')}, 6) AS sensitivity,
  round({_div('tn', 'tn + fp')}, 6) AS specificity,
  round({_div('tn', 'tn + fn')}, 6) AS npv,
  round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
  round(CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN {NAN}
             ELSE ({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / 2 END, 6) AS roc_auc
FROM bc"""


def _bin(spark, sf):
    return G.binary_metrics(G.binary_counts(_conf(spark, sf)))


@register("binary_metrics", _q(BIN_METRICS_SQL))
def q_binary_metrics(spark, sf):
    return _bin(spark, sf)


def _one_metric(name):
    @register(name, _q(f"SELECT method, {name} FROM ({BIN_METRICS_SQL}) z"))
    def q(spark, sf):
        return _bin(spark, sf).select("method", name)
    return q


for _m in ("precision", "sensitivity", "specificity", "npv", "f1"):
    _one_metric(_m)


@register("score_quality", _q(f"""
WITH bm AS ({BIN_METRICS_SQL}),
ea AS (SELECT method, round({_div('sum(CASE WHEN truth = pred THEN 1 ELSE 0 END)', 'count(*)')}, 6) AS v
       FROM lg GROUP BY method),
k AS (SELECT ex.method, round(CASE WHEN e_off <> 0 THEN 1 - o_off / e_off ELSE {NAN} END, 6) AS k1,
             round(CASE WHEN e_w <> 0 THEN 1 - o_w / e_w ELSE {NAN} END, 6) AS k2
      FROM ex JOIN ob ON ob.method = ex.method)
SELECT method, 'exact_agreement' AS metric, v AS value FROM ea
UNION ALL SELECT method, 'cohen_kappa', k1 FROM k
UNION ALL SELECT method, 'cohen_kappa_quadratic', k2 FROM k
UNION ALL SELECT method, 'precision', precision FROM bm
UNION ALL SELECT method, 'sensitivity', sensitivity FROM bm
UNION ALL SELECT method, 'specificity', specificity FROM bm
UNION ALL SELECT method, 'npv', npv FROM bm
UNION ALL SELECT method, 'f1', f1 FROM bm
UNION ALL SELECT method, 'roc_auc', roc_auc FROM bm""", KAPPA_CTES))
def q_score_quality(spark, sf):
    return G.score_quality(_conf(spark, sf))


PER_CLASS = ("sensitivity", "specificity", "ppv", "npv", "f1", "roc_auc")
PER_CLASS_CTES = [
    ("pc", """SELECT method, c.v AS class,
        sum(CASE WHEN coalesce(truth = c.v, false) AND pred = c.v THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN NOT coalesce(truth = c.v, false) AND pred = c.v THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN coalesce(truth = c.v, false) AND pred <> c.v THEN 1 ELSE 0 END) AS fn,
        sum(CASE WHEN NOT coalesce(truth = c.v, false) AND pred <> c.v THEN 1 ELSE 0 END) AS tn
        FROM lg CROSS JOIN (VALUES (0), (1), (2)) c(v) GROUP BY method, c.v"""),
    ("pcm", f"""SELECT method, class,
        {_div('tp', 'tp + fn')} AS sensitivity, {_div('tn', 'tn + fp')} AS specificity,
        {_div('tp', 'tp + fp')} AS ppv, {_div('tn', 'tn + fn')} AS npv,
        {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
        CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN {NAN}
                   ELSE ({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / 2 END AS roc_auc FROM pc"""),
]


@register("per_class_metrics", _q("SELECT method, class, " + ", ".join(f"round({c}, 6) AS {c}" for c in PER_CLASS) + " FROM pcm", PER_CLASS_CTES))
def q_per_class_metrics(spark, sf):
    return G.per_class_metrics(_conf(spark, sf))


@register("macro_average", _q("""
SELECT method, metric, round(avg(value), 6) AS value FROM (
  SELECT method, 'sensitivity' AS metric, sensitivity AS value FROM pcm
  UNION ALL SELECT method, 'specificity', specificity FROM pcm
  UNION ALL SELECT method, 'ppv', ppv FROM pcm
  UNION ALL SELECT method, 'npv', npv FROM pcm
  UNION ALL SELECT method, 'f1', f1 FROM pcm
  UNION ALL SELECT method, 'roc_auc', roc_auc FROM pcm) z GROUP BY method, metric""", PER_CLASS_CTES))
def q_macro_average(spark, sf):
    return G.macro_average(G.per_class_metrics(_conf(spark, sf)))


@register("roc_auc", A.with_views(["scored"], f"""
WITH r AS (SELECT truth, score,
             (rank() OVER (ORDER BY CAST(score AS DOUBLE)) * 2 + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar
           FROM scored),
s AS (SELECT sum(CASE WHEN truth = 1 THEN ar ELSE 0 END) AS rs, sum(CASE WHEN truth = 1 THEN 1 ELSE 0 END) AS P,
             sum(CASE WHEN truth = 1 THEN 0 ELSE 1 END) AS N FROM r)
SELECT CAST(P AS BIGINT) AS P, CAST(N AS BIGINT) AS N,
       round(CASE WHEN P * N > 0 THEN (rs - P * (P + 1) / 2.0) / (P * N) ELSE {NAN} END, 6) AS roc_auc
FROM s"""))
def q_roc_auc(spark, sf):
    return G.roc_auc_scores(A.scored(spark, sf), "truth", "score").drop("n_unranked")


FLAG_CTES = [
    ("fl", """SELECT report_id,
        CASE WHEN (CASE WHEN (CASE WHEN priority_hybrid <= 2 THEN 0 WHEN priority_hybrid <= 4 THEN 1 ELSE 2 END) >= 1
                   THEN 1 ELSE 0 END) = (CASE WHEN priority_manual >= 1 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS a,
        CASE WHEN (CASE WHEN (CASE WHEN judge_grade <= 2 THEN 0 WHEN judge_grade <= 4 THEN 1 ELSE 2 END) >= 1
                   THEN 1 ELSE 0 END) = (CASE WHEN priority_manual >= 1 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS b
        FROM graded"""),
]


def _flags(spark, sf):
    return G.correctness_flags(A.graded(spark, sf))


@register("correctness_crosstab", _q("""
SELECT x.v AS a_correct, y.v AS b_correct, CAST(count(fl.report_id) AS BIGINT) AS n
FROM (VALUES (0), (1)) x(v) CROSS JOIN (VALUES (0), (1)) y(v)
LEFT JOIN fl ON fl.a = x.v AND fl.b = y.v GROUP BY x.v, y.v""", FLAG_CTES))
def q_correctness_crosstab(spark, sf):
    return G.correctness_crosstab(_flags(spark, sf))


@register("mcnemar_exact", _q("""
WITH d AS (SELECT sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS b,
                  sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS c FROM fl),
t AS (SELECT b, c, least(b, c) AS m, b + c AS n FROM d),
tail AS (SELECT t.b, t.c, t.m, sum(exp(lgamma(t.n + 1) - lgamma(k.k + 1) - lgamma(t.n - k.k + 1) - t.n * ln(2))) AS s
         FROM t, generate_series(0, CAST(t.m AS BIGINT)) k(k) GROUP BY t.b, t.c, t.m)
SELECT CAST(b AS BIGINT) AS n_a_wrong_b_right, CAST(c AS BIGINT) AS n_a_right_b_wrong,
       CAST(m AS DOUBLE) AS statistic, round(least(1.0, 2 * s), 10) AS p_value, least(1.0, 2 * s) < 0.05 AS significant
FROM tail""", FLAG_CTES))
def q_mcnemar_exact(spark, sf):
    return G.mcnemar_exact(G.correctness_crosstab(_flags(spark, sf)))


@register("accuracy_difference", _q("""
SELECT round(avg(CAST(a AS DOUBLE)), 6) AS accuracy_a, round(avg(CAST(b AS DOUBLE)), 6) AS accuracy_b,
       round(avg(CAST(a AS DOUBLE)) - avg(CAST(b AS DOUBLE)), 6) AS accuracy_diff FROM fl""", FLAG_CTES))
def q_accuracy_difference(spark, sf):
    return G.accuracy_difference(_flags(spark, sf))


@register("undergrading_rate", _q("""
SELECT method, count(CASE WHEN truth >= 1 AND pred = 0 THEN 1 END) AS undergraded,
       count(CASE WHEN truth >= 1 THEN 1 END) AS abnormal,
       round(CASE WHEN count(CASE WHEN truth >= 1 THEN 1 END) > 0
             THEN count(CASE WHEN truth >= 1 AND pred = 0 THEN 1 END) * 100.0 / count(CASE WHEN truth >= 1 THEN 1 END)
             END, 6) AS undergraded_pct
FROM lg GROUP BY method"""))
def q_undergrading_rate(spark, sf):
    return G.undergrading_rate(G.methods_long(A.graded(spark, sf)))
