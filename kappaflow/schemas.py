"""Declared schemas and code lists.

FIXED VALUES (must equal the reference's for equal results).  The position
of a word in its list is its code.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: code lists (position = code) ---------------------------
TEMPORAL = ["new", "better", "worse", "stable", "not mentioned"]
UNCERTAINTY = ["certain", "uncertain", "not mentioned"]
PLACEMENT = ["satisfactory", "suboptimal", "malpositioned", "not mentioned"]
# judge choice codes 0..3 and their labels
CHOICE_LABELS = [
    "Neither grade is appropriate",
    "Algorithm grade is better",
    "Manual grade is better",
    "Both grades are the same",
]
# grouped classes 0..2
CLASS_NAMES = ["Normal", "Actionable", "Critical"]
# --- end fixed values ------------------------------------------------------

KINDS = ("finding", "device", "diagnosis")

# Method name -> column of the graded table (the four grading methods).
METHOD_COLUMNS = {
    "Algo": "priority_algo",
    "LLM": "priority_llm",
    "Judge": "judge_grade",
    "Hybrid": "priority_hybrid",
}

REPORTS = T.StructType([
    T.StructField("report_id", T.LongType(), False),
    T.StructField("TEXT_REPORT", T.StringType(), True),
    T.StructField("GROUND_TRUTH", T.IntegerType(), True),
])

LEXICON = T.StructType([
    T.StructField("kind", T.StringType(), True),
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("term", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), False),
])

FINDING = T.StructType([
    T.StructField("finding", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("temporal", T.StringType()),
    T.StructField("uncertainty", T.StringType()),
])
DEVICE = T.StructType([
    T.StructField("medical_device", T.StringType()),
    T.StructField("placement", T.StringType()),
])
DIAGNOSIS = T.StructType([
    T.StructField("diagnosis", T.StringType()),
    T.StructField("temporal", T.StringType()),
])
EXTRACTION = T.StructType([
    T.StructField("findings_all", T.ArrayType(FINDING)),
    T.StructField("devices_all", T.ArrayType(DEVICE)),
    T.StructField("diagnoses_all", T.ArrayType(DIAGNOSIS)),
])

# Model response schemas (one per method).
GRADE = T.StructType([T.StructField("grade", T.IntegerType())])
GRADE_EXPLAINED = T.StructType([
    T.StructField("grade", T.IntegerType()),
    T.StructField("explanation", T.StringType()),
])
JUDGE = T.StructType([
    T.StructField("grade", T.IntegerType()),
    T.StructField("choice", T.IntegerType()),
    T.StructField("explanation", T.StringType()),
])

GRADED = T.StructType([
    T.StructField("report_id", T.LongType(), False),
    T.StructField("priority_manual", T.IntegerType()),
    T.StructField("priority_algo", T.IntegerType()),
    T.StructField("priority_llm", T.IntegerType()),
    T.StructField("judge_grade", T.IntegerType()),
    T.StructField("priority_hybrid", T.IntegerType()),
])

RESPONSES = T.StructType([
    T.StructField("request_key", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("payload", T.StringType(), True),
])
