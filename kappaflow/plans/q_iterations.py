"""Queries: repeated-run consistency on ``graded_iter``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import erfc_sql
from ..operators import significance as S
from ..sources import adapters as A
from .registry import register

METHODS = ["priority_manual", "priority_algo", "priority_llm", "priority_hybrid"]
K = 10  # runs of the fixture; the operators take the runs from the data


def _it(spark, sf):
    return A.graded_iter(spark, sf)


def _q(body, extra=None):
    return A.with_views(["graded_iter"], body, extra)


_cols = ", ".join(f"max(CASE WHEN it = {i} THEN {m} END) AS {m}_{i}" for m in METHODS for i in range(1, K + 1))


@register("join_iterations", _q(f"SELECT report_id, {_cols} FROM graded_iter GROUP BY report_id"))
def q_join_iterations(spark, sf):
    return S.join_iterations(_it(spark, sf), METHODS)


# Oracle: brute-force self-join of the long table on report_id.
PAIR_CTES = [
    ("gl", " UNION ALL ".join(f"SELECT report_id, it, '{m}' AS method, {m} AS grade FROM graded_iter" for m in METHODS)),
    ("pr", """SELECT a.method, a.it AS it_a, b.it AS it_b, a.grade AS x, b.grade AS y,
                     CAST(a.grade - b.grade AS DOUBLE) AS d
              FROM gl a JOIN gl b ON a.report_id = b.report_id AND a.method = b.method AND a.it < b.it
              WHERE a.grade IS NOT NULL AND b.grade IS NOT NULL"""),
]


@register("iteration_pairs", _q("""
SELECT method, it_a, it_b, count(*) AS n_common, count(CASE WHEN x = y THEN 1 END) AS n_equal,
       count(CASE WHEN x <> y THEN 1 END) AS n_diff, round(avg(d), 6) AS mean_diff
FROM pr GROUP BY method, it_a, it_b""", PAIR_CTES))
def q_iteration_pairs(spark, sf):
    return shown(S.iteration_pairs(_it(spark, sf), METHODS), "mean_diff")


WILCOX_CTES = PAIR_CTES + [
    ("nzr", """SELECT method, it_a, it_b, d,
                 (rank() OVER (PARTITION BY method, it_a, it_b ORDER BY abs(d)) * 2
                  + count(*) OVER (PARTITION BY method, it_a, it_b, abs(d)) - 1) / 2.0 AS r,
                 count(*) OVER (PARTITION BY method, it_a, it_b, abs(d)) AS t
               FROM pr WHERE d <> 0"""),
    ("rs", """SELECT method, it_a, it_b, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS rp,
                 sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS rm, count(*) AS nn,
                 sum((CAST(t AS DOUBLE) * t * t - t) / t) AS ties
               FROM nzr GROUP BY method, it_a, it_b"""),
    ("cm", "SELECT method, it_a, it_b, count(*) AS n_common FROM pr GROUP BY method, it_a, it_b"),
    ("st", """SELECT c.method, c.it_a, c.it_b, c.n_common, CAST(coalesce(nn, 0) AS DOUBLE) AS n,
                 least(coalesce(rp, 0), coalesce(rm, 0)) AS w, coalesce(ties, 0) AS ties
               FROM cm c LEFT JOIN rs USING (method, it_a, it_b)"""),
    ("zt", """SELECT *, CASE WHEN n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0 > 0
                 THEN (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) END AS z
               FROM st"""),
    ("wx", f"""SELECT method, it_a, it_b,
                 method || '_' || CAST(it_a AS VARCHAR) || ' vs ' || method || '_' || CAST(it_b AS VARCHAR) AS comparison,
                 n_common, CAST(n AS BIGINT) AS n_nonzero,
                 CASE WHEN n_common > 5 THEN w END AS statistic,
                 CASE WHEN n_common > 5 THEN z END AS z,
                 CASE WHEN n_common > 5 THEN {erfc_sql('abs(z) / sqrt(2.0)')} END AS p_value,
                 CASE WHEN n_common > 5 THEN 'tested' ELSE 'insufficient' END AS status FROM zt"""),
    ("bf", """SELECT method, comparison, it_a, it_b, p_value AS raw_p_value,
                 count(*) OVER (PARTITION BY method) AS m FROM wx WHERE status = 'tested'"""),
    ("bfc", """SELECT *, least(1.0, raw_p_value * m) AS corrected_p_value,
                 coalesce(raw_p_value <= 0.05 / m, false) AS significant FROM bf"""),
]


def _w(spark, sf):
    return S.wilcoxon_pairs(_it(spark, sf), METHODS)


def shown(df, *cols):
    """Values rounded for display; the operators do not round."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("wilcoxon_pairs", _q("SELECT * REPLACE (round(statistic, 6) AS statistic, round(z, 6) AS z, round(p_value, 6) AS p_value) FROM wx", WILCOX_CTES))
def q_wilcoxon_pairs(spark, sf):
    return shown(_w(spark, sf), "statistic", "z", "p_value")


@register("bonferroni", _q("SELECT * REPLACE (round(raw_p_value, 6) AS raw_p_value, round(corrected_p_value, 6) AS corrected_p_value) FROM bfc", WILCOX_CTES))
def q_bonferroni(spark, sf):
    return shown(S.bonferroni(_w(spark, sf)), "raw_p_value", "corrected_p_value")


@register("significant_summary", _q("""
SELECT method, sum(CAST(significant AS INT)) AS n_significant, count(*) AS n_tests,
       CAST(sum(CAST(significant AS INT)) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS summary
FROM bfc GROUP BY method""", WILCOX_CTES))
def q_significant_summary(spark, sf):
    return S.significant_summary(S.bonferroni(_w(spark, sf)))


@register("grade_counts_by_iteration", _q("""
SELECT m.method, i.it, g.grp AS grade_group, count(x.report_id) AS n
FROM (SELECT DISTINCT method FROM gl) m CROSS JOIN (SELECT DISTINCT it FROM gl) i CROSS JOIN (VALUES (0), (1), (2)) g(grp)
LEFT JOIN (SELECT report_id, it, method, CASE WHEN grade IN (1, 2) THEN 0 WHEN grade IN (3, 4) THEN 1
                  WHEN grade = 5 THEN 2 ELSE grade END AS grp FROM gl) x
  ON x.method = m.method AND x.it = i.it AND x.grp = g.grp
GROUP BY m.method, i.it, g.grp""", PAIR_CTES[:1]))
def q_grade_counts_by_iteration(spark, sf):
    return S.grade_counts_by_iteration(_it(spark, sf), METHODS)
