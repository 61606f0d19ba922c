"""Queries: encoding (J1-J3) and semi-algorithmic grading (A1-A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.encode import encode_exact, encode_mentions
from ..operators.grading import encode_extraction, grade_extraction, grade_reports, mention_priority
from ..sources import adapters as A
from .registry import register

ENC_COLS = ["mention_id", "report_id", "kind", "term_raw", "idx", "priority", "match", "distance"]

# --- oracle building blocks (SQL text, DuckDB) -----------------------------
_CODES_SQL = """
terms AS (SELECT DISTINCT kind, term_raw FROM mentions WHERE term_raw IS NOT NULL),
ex AS (SELECT t.kind, t.term_raw, l.idx, l.priority FROM terms t LEFT JOIN lexicon l ON l.term = t.term_raw),
nr AS (SELECT kind, term_raw, idx, priority, dist FROM (
         SELECT t.kind, t.term_raw, l.idx, l.priority, CAST(levenshtein(t.term_raw, l.term) AS INT) AS dist,
                row_number() OVER (PARTITION BY t.kind, t.term_raw
                                   ORDER BY levenshtein(t.term_raw, l.term), l.idx) AS rn
         FROM ex t CROSS JOIN lexicon l WHERE t.idx IS NULL AND t.kind IN ({fuzzy})) z WHERE rn = 1),
codes AS (SELECT e.kind, e.term_raw, coalesce(e.idx, n.idx) AS idx, coalesce(e.priority, n.priority) AS priority,
                 CASE WHEN e.idx IS NOT NULL THEN 'exact' WHEN n.idx IS NOT NULL THEN 'nearest' END AS match,
                 CASE WHEN e.idx IS NOT NULL THEN 0 ELSE n.dist END AS distance
          FROM ex e LEFT JOIN nr n ON n.kind = e.kind AND n.term_raw = e.term_raw),
enc AS (SELECT m.*, c.idx, c.priority, c.match, c.distance
        FROM mentions m LEFT JOIN codes c ON c.kind = m.kind AND c.term_raw = m.term_raw),
pri AS (SELECT *, CAST(CASE WHEN priority IS NULL THEN NULL
          WHEN kind = 'finding' THEN greatest(1, least(5, priority - CASE WHEN uncertainty = 1 THEN 1 ELSE 0 END))
          WHEN kind = 'device' THEN CASE WHEN placement = 2 THEN 5 ELSE priority END
          WHEN kind = 'diagnosis' THEN greatest(1, least(5, priority - CASE WHEN temporal IN (1, 3) THEN 1 ELSE 0 END))
          END AS INT) AS effective_priority FROM enc)"""


def codes_sql(fuzzy: str = "'finding'") -> str:
    return _CODES_SQL.replace("{fuzzy}", fuzzy)


def grade_sql_body(source: str = "pri") -> str:
    return f"""
SELECT report_id,
  count(CASE WHEN kind = 'finding' AND effective_priority IS NOT NULL THEN 1 END) AS n_findings,
  count(CASE WHEN kind = 'device' AND effective_priority IS NOT NULL THEN 1 END) AS n_lines,
  count(CASE WHEN kind = 'diagnosis' AND effective_priority IS NOT NULL THEN 1 END) AS n_diagnoses,
  CAST(coalesce(max(CASE WHEN kind = 'finding' THEN effective_priority END), 1) AS INT) AS max_finding_priority,
  CAST(coalesce(max(CASE WHEN kind = 'device' THEN effective_priority END), 1) AS INT) AS max_line_priority,
  CAST(coalesce(max(CASE WHEN kind = 'diagnosis' THEN effective_priority END), 1) AS INT) AS max_diagnosis_priority,
  CAST(CASE WHEN count(CASE WHEN kind IN ('finding', 'device') AND effective_priority IS NOT NULL THEN 1 END) > 0
       THEN max(effective_priority) ELSE 1 END AS INT) AS overall_max_priority
FROM {source} GROUP BY report_id"""


def _sql(body: str, fuzzy: str = "'finding'") -> str:
    s = A.with_views(["lexicon", "mentions"], "SELECT 1")
    head = s[: s.rindex("SELECT 1")].rstrip()
    return head + ",\n" + codes_sql(fuzzy).strip() + "\n" + body.strip()


# --- queries ---------------------------------------------------------------


@register("encode_exact", _sql(f"SELECT {', '.join(ENC_COLS)} FROM enc", fuzzy="'none'"))
def q_encode_exact(spark, sf):
    m = A.mentions(spark, sf)
    return encode_exact(m, A.lexicon(spark, sf)).select(*ENC_COLS)


@register("encode_nearest", _sql(f"SELECT {', '.join(ENC_COLS)} FROM enc"))
def q_encode_nearest(spark, sf):
    return encode_mentions(A.mentions(spark, sf), A.lexicon(spark, sf)).select(*ENC_COLS)


@register("lookup_priority", _sql(
    "SELECT mention_id, report_id, kind, idx, priority, effective_priority FROM pri"))
def q_lookup_priority(spark, sf):
    enc = encode_mentions(A.mentions(spark, sf), A.lexicon(spark, sf))
    return mention_priority(enc).select("mention_id", "report_id", "kind", "idx", "priority",
                                        "effective_priority")


def grade_semialgo_df(spark, sf):
    """Every report is graded, those without a mention too (A1)."""
    enc = encode_mentions(A.mentions(spark, sf), A.lexicon(spark, sf))
    return grade_reports(mention_priority(enc), reports=A.reports(spark, sf))


WITH_REPORTS = """(SELECT report_id, kind, effective_priority FROM pri
 UNION ALL SELECT doc_id, NULL, NULL FROM documents)"""


@register("grade_semialgo", _sql(grade_sql_body(WITH_REPORTS)))
def q_grade_semialgo(spark, sf):
    return grade_semialgo_df(spark, sf)


def _list_sql(kind: str, name: str) -> str:
    return (f"coalesce(string_agg(CASE WHEN kind = '{kind}' THEN CAST(effective_priority AS VARCHAR) END, ','"
            f" ORDER BY mention_id), '1') AS {name}")


NESTED_COLS = ["report_id", "findings_priorities", "lines_priorities", "diagnoses_priorities",
               "max_finding_priority", "max_line_priority", "max_diagnosis_priority",
               "overall_max_priority"]

_NESTED_SQL = _sql(f"""
SELECT report_id, {_list_sql('finding', 'findings_priorities')}, {_list_sql('device', 'lines_priorities')},
  {_list_sql('diagnosis', 'diagnoses_priorities')},
  CAST(coalesce(max(CASE WHEN kind = 'finding' THEN effective_priority END), 1) AS INT) AS max_finding_priority,
  CAST(coalesce(max(CASE WHEN kind = 'device' THEN effective_priority END), 1) AS INT) AS max_line_priority,
  CAST(coalesce(max(CASE WHEN kind = 'diagnosis' THEN effective_priority END), 1) AS INT) AS max_diagnosis_priority,
  CAST(CASE WHEN count(CASE WHEN kind IN ('finding', 'device') AND effective_priority IS NOT NULL THEN 1 END) > 0
       THEN max(effective_priority) ELSE 1 END AS INT) AS overall_max_priority
FROM pri GROUP BY report_id""")


def as_text(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def grade_nested_df(spark, sf):
    lx = A.lexicon(spark, sf)
    enc = encode_extraction(A.extractions(spark, sf), lx, lx, lx)
    return grade_extraction(enc)


@register("grade_semialgo_nested", _NESTED_SQL)
def q_grade_semialgo_nested(spark, sf):
    g = grade_nested_df(spark, sf)
    return g.select("report_id", *[as_text(F.col(c)).alias(c) for c in NESTED_COLS[1:4]], *NESTED_COLS[4:])


@register("encode_nearest_banded", _sql(f"SELECT {', '.join(ENC_COLS)} FROM enc"))
def q_encode_nearest_banded(spark, sf):
    """J2 by the segment index and its radii, as for a large dictionary."""
    return encode_mentions(A.mentions(spark, sf), A.lexicon(spark, sf), block=8, no_index=0).select(*ENC_COLS)
