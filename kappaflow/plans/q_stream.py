"""Queries: sources round-trips and the streaming grader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import parse_list_cell
from ..schemas import FINDING, REPORTS
from ..session import stage_root
from ..sources import adapters as A
from ..sources import files as FS
from ..streaming.grade_stream import grade_stream
from .q_grading import NESTED_COLS, _NESTED_SQL, as_text
from .registry import register


def _dir(spark, name):
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@register("lexicon_scan", A.with_views(["lexicon"], "SELECT idx, term, priority FROM lexicon"))
def q_lexicon_scan(spark, sf):
    path = _dir(spark, "lexicon-json")
    FS.write_lexicon_json(A.lexicon(spark, sf), path)
    return FS.lexicon_scan(spark, path).select("idx", "term", "priority")


@register("scan_reports", A.with_views(["reports"], """
SELECT report_id, TEXT_REPORT, CASE WHEN report_id % 5 <> 0 THEN CAST(report_id % 3 AS INT) END AS GROUND_TRUTH FROM reports"""))
def q_scan_reports(spark, sf):
    path = _dir(spark, "reports-csv")
    truth = F.when(F.col("report_id") % 5 != 0, (F.col("report_id") % 3).cast("int"))
    FS.write_csv(A.reports(spark, sf).withColumn("GROUND_TRUTH", truth), path)
    return FS.scan_reports(spark, path, REPORTS)


@register("scan_iterations", A.with_views(["graded_iter"], "SELECT report_id, priority_llm, priority_hybrid, it FROM graded_iter"))
def q_scan_iterations(spark, sf):
    folder = _dir(spark, "iterations")
    methods = ["priority_llm", "priority_hybrid"]
    FS.write_iterations(A.graded_iter(spark, sf), folder, methods)
    return FS.scan_iterations(spark, f"{folder}/iteration_*/*.csv", ["report_id", *methods],
                              header_regex=r"^report_id,priority_llm_\d+,priority_hybrid_\d+$")


@register("grade_stream", _NESTED_SQL)
def q_grade_stream(spark, sf):
    src, out, ckpt = _dir(spark, "stream-src"), _dir(spark, "stream-out"), _dir(spark, "stream-ckpt")
    # arrivals: the extraction records written as several files
    A.extractions(spark, sf).write.parquet(src)
    lx = A.lexicon(spark, sf)
    q = grade_stream(spark, src, A.extractions(spark, sf).schema, lx, lx, lx, out, ckpt, files_per_trigger=2,
                     select=["report_id", *[as_text(F.col(c)).alias(c) for c in NESTED_COLS[1:4]], *NESTED_COLS[4:]])
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


GRADED_CSV = T.StructType([T.StructField("report_id", T.LongType()), T.StructField("report_findings", T.StringType())])


@register("graded_table_scan", A.with_views(["mentions"], """
SELECT report_id, CAST(count(*) AS INT) AS n_findings,
       string_agg(list_extract(['new', 'better', 'worse', 'stable', 'not mentioned'], temporal + 1), ',' ORDER BY mention_id) AS temporal
FROM mentions WHERE kind = 'finding' GROUP BY report_id"""))
def q_graded_table_scan(spark, sf):
    """S2 -> N6: a graded table written as CSV, its nested column as a list cell, read and parsed again."""
    path = _dir(spark, "graded-csv")
    FS.write_csv(A.extractions(spark, sf).select("report_id", F.col("payload.findings_all").alias("report_findings")), path)
    cells = FS.scan_reports(spark, path, GRADED_CSV).withColumn("f", parse_list_cell("report_findings", FINDING))
    return cells.where(F.size("f") > 0).select(
        "report_id", F.size("f").alias("n_findings"), F.array_join(F.transform("f", lambda x: x["temporal"]), ",").alias("temporal"))


@register("scan_iterations_text", A.with_views(["reports"], """
SELECT TEXT_REPORT AS REPORT, CAST((report_id + it) % 5 + 1 AS INT) AS priority_algo, CAST((report_id * it) % 5 + 1 AS INT) AS priority_llm,
       CAST((report_id + 2 * it) % 3 AS INT) AS priority_hybrid, CAST(report_id % 4 AS INT) AS priority_manual, it
FROM reports CROSS JOIN (VALUES (1), (2)) AS i(it)"""))
def q_scan_iterations_text(spark, sf):
    """S3 keyed by the report's text, with all four methods: quoted line breaks, files read by byte ranges."""
    folder = _dir(spark, "iterations-text")
    r, cols = A.reports(spark, sf), ["REPORT", "priority_algo", "priority_llm", "priority_hybrid", "priority_manual"]
    k = F.col("report_id")
    for it in (1, 2):
        run = r.select(F.col("TEXT_REPORT").alias("REPORT"), ((k + it) % 5 + 1).cast("int").alias(f"priority_algo_{it}"),
                       ((k * it) % 5 + 1).cast("int").alias(f"priority_llm_{it}"), ((k + 2 * it) % 3).cast("int").alias(f"priority_hybrid_{it}"),
                       (k % 4).cast("int").alias(f"priority_manual_{it}"))
        FS.write_csv(run, f"{folder}/iteration_{it}")
    return FS.scan_iterations(spark, f"{folder}/iteration_*/*.csv", cols, header_regex=r"^REPORT,priority_algo_\d+,", text_columns=("REPORT",))
