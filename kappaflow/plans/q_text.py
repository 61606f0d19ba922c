"""Queries: cleaning, prompts, token sizes, labels, list cells, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decode import decode_response, parse_list_cell
from ..functions.text import clean_text, debug_label, word_count
from ..operators.encode import encode_mentions
from ..schemas import FINDING, GRADE, TEMPORAL, UNCERTAINTY
from ..sources import adapters as A
from .methods import build_messages, term_list
from .prompts import TEMPLATES
from .registry import register

# ---- SQL helpers shared with q_models --------------------------------------


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


clean_sql = A.clean_sql


LEX_LIST = "(SELECT string_agg(term, ', ' ORDER BY idx) FROM lexicon)"


def fill_sql(method: str, holes: dict[str, str]) -> str:
    out = sql_str(TEMPLATES[method])
    order = [k for k in holes if k != "rpt"] + (["rpt"] if "rpt" in holes else [])
    for k in order:
        out = f"replace({out}, '${{{k}}}', coalesce(CAST({holes[k]} AS VARCHAR), ''))"
    return out


CL_CTE = ("cl", f"""SELECT report_id, {clean_sql('TEXT_REPORT')} AS txt, priority_manual, priority_algo,
                    priority_llm, judge_grade, priority_hybrid FROM reports_with_truth""")

SQL_HOLES = {
    "extract": {"findings_str": LEX_LIST, "devices_str": LEX_LIST,
                "diagnoses_str": LEX_LIST, "rpt": "txt"},
    "llm": {"rpt": "txt"},
    "hybrid": {"findings_str": LEX_LIST, "diagnoses_str": LEX_LIST,
               "grade_semialgo": "priority_algo", "rpt": "txt"},
}

PROMPTS_SQL = " UNION ALL ".join(
    f"SELECT report_id, '{m}' AS method, {fill_sql(m, h)} AS user_prompt FROM cl" for m, h in SQL_HOLES.items())


def _prompts(spark, sf):
    """User prompts of three methods for every report (Spark side of PROMPTS_SQL)."""
    lx = A.lexicon(spark, sf)
    d = A.reports_with_truth(spark, sf).withColumn("txt", clean_text("TEXT_REPORT"))
    d = d.withColumn("_l", term_list(lx))
    holes = {
        "extract": {"findings_str": F.col("_l"), "devices_str": F.col("_l"),
                    "diagnoses_str": F.col("_l"), "rpt": F.col("txt")},
        "llm": {"rpt": F.col("txt")},
        "hybrid": {"findings_str": F.col("_l"), "diagnoses_str": F.col("_l"),
                   "grade_semialgo": F.col("priority_algo"), "rpt": F.col("txt")},
    }
    parts = [d.select("report_id", F.lit(m).alias("method"), build_messages(m, h).alias("messages"))
             for m, h in holes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("clean_text", A.with_views(["reports"], f"SELECT report_id, {clean_sql('TEXT_REPORT')} AS TEXT_REPORT FROM reports"))
def q_clean_text(spark, sf):
    return A.reports(spark, sf).select("report_id", clean_text("TEXT_REPORT").alias("TEXT_REPORT"))


def _pq(body):
    return A.with_views(["lexicon", "reports_with_truth"], body, [CL_CTE, ("pp", PROMPTS_SQL)])


@register("build_prompt", _pq("""
SELECT report_id, method, 2 AS n_messages, CAST(length(user_prompt) AS INT) AS user_chars,
       sha256(user_prompt) AS prompt_sha FROM pp"""))
def q_build_prompt(spark, sf):
    p = _prompts(spark, sf)
    user = F.col("messages")[1]["content"]
    return p.select("report_id", "method", F.size("messages").alias("n_messages"),
                    F.length(user).alias("user_chars"), F.sha2(user, 256).alias("prompt_sha"))


_WC_SQL = ("CASE WHEN length(regexp_replace(user_prompt, '^\\s+|\\s+$', '', 'g')) = 0 THEN 0 ELSE "
           "len(string_split_regex(regexp_replace(user_prompt, '^\\s+|\\s+$', '', 'g'), '\\s+')) END")


@register("token_stats", _pq(f"""
SELECT method, count(*) AS n_prompts, CAST(sum({_WC_SQL}) AS BIGINT) AS total_words,
       max({_WC_SQL}) AS max_words, round(avg({_WC_SQL}), 6) AS avg_words,
       round(quantile_cont({_WC_SQL}, 0.5), 6) AS median_words, round(quantile_cont({_WC_SQL}, 0.95), 6) AS p95_words,
       CAST(sum(length(user_prompt)) AS BIGINT) AS total_chars FROM pp GROUP BY method"""))
def q_token_stats(spark, sf):
    p = _prompts(spark, sf)
    user = F.col("messages")[1]["content"]
    w = word_count(user)
    return p.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_prompts"), F.sum(w).cast("long").alias("total_words"),
        F.max(w).alias("max_words"), F.round(F.avg(w), 6).alias("avg_words"),
        F.round(F.percentile(w, F.lit(0.5)), 6).alias("median_words"), F.round(F.percentile(w, F.lit(0.95)), 6).alias("p95_words"),
        F.sum(F.length(user)).cast("long").alias("total_chars"))


@register("debug_labels", A.with_views(["lexicon", "mentions"], """
SELECT m.mention_id, m.kind, CASE WHEN l.idx IS NOT NULL THEN '(' || CAST(l.idx AS VARCHAR) || ') ' || l.term
                                  ELSE '!' || m.term_raw || '!' END AS label
FROM mentions m LEFT JOIN lexicon l ON l.term = m.term_raw"""))
def q_debug_labels(spark, sf):
    enc = encode_mentions(A.mentions(spark, sf), A.lexicon(spark, sf), fuzzy_kinds=())
    return enc.select("mention_id", "kind", debug_label("idx", "term", "term_raw").alias("label"))


def _cells(spark, sf):
    """One stored list cell per mention, Python-literal style; every 7th is 'None', every 11th junk."""
    m = A.mentions(spark, sf)
    t = F.element_at(F.array(*[F.lit(w) for w in TEMPORAL]), F.col("temporal") + 1)
    u = F.element_at(F.array(*[F.lit(w) for w in UNCERTAINTY]), F.col("uncertainty") + 1)
    cell = F.concat(F.lit("[{'finding': '"), F.col("term_raw"), F.lit("', 'location': None, 'system': '"),
                    F.col("system"), F.lit("', 'temporal': '"), t, F.lit("', 'uncertainty': '"), u, F.lit("'}]"))
    cell = (F.when(F.col("mention_id") % 7 == 0, F.lit("None"))
            .when(F.col("mention_id") % 11 == 0, F.lit("[{'finding': broken")).otherwise(cell))
    return m.select("mention_id", cell.alias("cell"))


_T_SQL = "list_extract(['" + "','".join(TEMPORAL) + "'], temporal + 1)"
_U_SQL = "list_extract(['" + "','".join(UNCERTAINTY) + "'], uncertainty + 1)"


@register("parse_list_dict", A.with_views(["mentions"], f"""
SELECT mention_id, term_raw AS finding, CAST(NULL AS VARCHAR) AS location, system,
       {_T_SQL} AS temporal, {_U_SQL} AS uncertainty
FROM mentions WHERE mention_id % 7 <> 0 AND mention_id % 11 <> 0"""))
def q_parse_list_dict(spark, sf):
    c = _cells(spark, sf).select("mention_id", F.explode(parse_list_cell("cell", FINDING)).alias("f"))
    return c.select("mention_id", "f.finding", "f.location", "f.system", "f.temporal", "f.uncertainty")


@register("decode_response", A.with_views(["reports_with_truth"], """
SELECT report_id, CASE WHEN report_id % 10 IN (5, 7, 9) THEN NULL ELSE priority_llm END AS grade,
       CASE WHEN report_id % 10 IN (5, 9) THEN 'no_json' WHEN report_id % 10 = 7 THEN 'malformed' ELSE 'ok' END
         AS status
FROM reports_with_truth"""))
def q_decode_response(spark, sf):
    r = A.replay_responses(spark, sf).where(F.col("method") == "llm")
    d = r.select("report_id", decode_response("payload", GRADE).alias("d"))
    return d.select("report_id", "d.grade", "d.status")


@register("conversation_messages", A.with_views(["messages"], """
SELECT report_id, count(*) AS n_messages,
       sha256(string_agg(role || chr(31) || content, chr(30) ORDER BY turn)) AS messages_sha
FROM messages GROUP BY report_id"""))
def q_conversation_messages(spark, sf):
    """G1 from a turns table: the messages of a conversation in turn order, as a provider takes them."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    m = A.messages(spark, sf).groupBy("report_id").agg(F.transform(
        turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
    body = F.array_join(F.transform("messages", lambda x: F.concat_ws("\u001f", x["role"], x["content"])), "\u001e")
    return m.select("report_id", F.size("messages").cast("long").alias("n_messages"), F.sha2(body, 256).alias("messages_sha"))
