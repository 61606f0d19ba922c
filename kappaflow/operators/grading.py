"""Semi-algorithmic grading: priorities per category and per report (A1-A3).

Rules (the code of the reference wins over its prose):
  finding    base priority, -1 if uncertainty code = 1, clamp 1..5; temporal
             has no effect unless ``temporal_rule`` is on (Q2)
  device     placement code 2 -> exactly 5, otherwise base (Q3)
  diagnosis  -1 if temporal code is 1 or 3, clamp 1..5 (Q4)
  empty category -> [1], max 1 (Q7)
  overall    1 when no graded finding and no graded device, even with a
             grade-5 diagnosis (Q1); else max over all three categories.
             ``diagnosis_only='max'`` lets diagnoses count on their own.
Only matched terms (code not NULL) are graded (Q5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import clamp
from ..schemas import PLACEMENT, TEMPORAL, UNCERTAINTY
from ..session import ensure_checkpoint_dir
from .encode import code_of, term_codes


def _finding_priority(p: Column, unc: Column, temporal: Column, temporal_rule: bool) -> Column:
    x = p - F.when(unc == 1, 1).otherwise(0)
    if temporal_rule:
        x = (x + F.when(temporal.isin(0, 2), 1).otherwise(0)
             - F.when(temporal.isin(1, 3), 1).otherwise(0))
    return clamp(x)


def _device_priority(p: Column, placement: Column) -> Column:
    return F.when(placement == 2, F.lit(5)).otherwise(p)


def _diagnosis_priority(p: Column, temporal: Column) -> Column:
    return clamp(p - F.when(temporal.isin(1, 3), 1).otherwise(0))


def mention_priority(encoded: DataFrame, *, kind_col: str = "kind", temporal_rule: bool = False,
                     priority_col: str = "priority") -> DataFrame:
    """Long form: effective priority of every matched mention (NULL if unmatched)."""
    k, p = F.col(kind_col), F.col(priority_col)
    eff = (F.when(p.isNull(), F.lit(None).cast("int"))
           .when(k == "finding", _finding_priority(p, F.col("uncertainty"), F.col("temporal"), temporal_rule))
           .when(k == "device", _device_priority(p, F.col("placement")))
           .when(k == "diagnosis", _diagnosis_priority(p, F.col("temporal"))))
    return encoded.withColumn("effective_priority", eff.cast("int"))


def grade_reports(prioritised: DataFrame, reports: DataFrame | None = None, *,
                  kind_col: str = "kind", diagnosis_only: str = "reference") -> DataFrame:
    """Per-report maxima and overall grade from per-mention priorities.

    One hash aggregate on report_id (partial aggregation before the
    shuffle, so a report holding many mentions costs one row per task).
    With ``reports``, ids without any mention are unioned in before the
    aggregate -- one shuffle, no extra join -- and get the empty grades.
    """
    k, e = F.col(kind_col), F.col("effective_priority")
    rows = prioritised.select("report_id", k.alias("_k"), e.alias("_p"))
    if reports is not None:
        rows = rows.unionByName(reports.select(
            "report_id", F.lit(None).cast("string").alias("_k"), F.lit(None).cast("int").alias("_p")))
    kk, pp = F.col("_k"), F.col("_p")
    g = rows.groupBy("report_id").agg(
        F.count(F.when((kk == "finding") & pp.isNotNull(), 1)).alias("n_findings"),
        F.count(F.when((kk == "device") & pp.isNotNull(), 1)).alias("n_lines"),
        F.count(F.when((kk == "diagnosis") & pp.isNotNull(), 1)).alias("n_diagnoses"),
        F.max(F.when(kk == "finding", pp)).alias("_mf"),
        F.max(F.when(kk == "device", pp)).alias("_ml"),
        F.max(F.when(kk == "diagnosis", pp)).alias("_md"),
    )
    any_fl = (F.col("n_findings") + F.col("n_lines")) > 0
    if diagnosis_only == "max":
        any_fl = any_fl | (F.col("n_diagnoses") > 0)
    overall = F.when(any_fl, F.greatest("_mf", "_ml", "_md")).otherwise(F.lit(1))
    return g.select(
        "report_id", "n_findings", "n_lines", "n_diagnoses",
        F.coalesce("_mf", F.lit(1)).cast("int").alias("max_finding_priority"),
        F.coalesce("_ml", F.lit(1)).cast("int").alias("max_line_priority"),
        F.coalesce("_md", F.lit(1)).cast("int").alias("max_diagnosis_priority"),
        overall.cast("int").alias("overall_max_priority"),
    )


# ------------------------------------------------------------------ nested


SEP = "\u0001"
#: A response that many reports share is dealt to so many tasks.
SALTS = 64


def _row_codes(df: DataFrame, lexicons: dict[str, DataFrame], payload_col: str, key: str, max_distance, codes: DataFrame | None
               ) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_row``, and (_row, _codes): a map from kind and term to (idx, priority) for the terms of each row.

    ``_row`` hashes the terms themselves (and some salt, so that a response that many
    reports share is not one hot key): rows with equal terms share a map, whatever their key; should two hashes clash, the map
    holds the terms of both, which changes nothing.  Rows without terms have a hash that meets nothing.
    """
    p = F.col(payload_col)
    lists = {"finding": ("findings_all", "finding"), "device": ("devices_all", "medical_device"), "diagnosis": ("diagnoses_all", "diagnosis")}
    named = F.array_distinct(F.concat(*[_terms(p[field], kind, name) for kind, (field, name) in lists.items()]))
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    df = df.withColumn("_row", F.when(F.size(named) > 0, F.xxhash64(named, salt)).otherwise(F.xxhash64(F.col(key), F.lit(1))))
    rows = df.select("_row", F.explode(named).alias("t")).select("_row", "t.kind", "t.term_raw").where(F.col("term_raw").isNotNull()).distinct()
    if codes is None:
        ensure_checkpoint_dir(df.sparkSession)
        rows = rows.checkpoint()  # narrow, and read twice: for the different terms and for the codes of each row
        codes = term_codes(rows, of_kinds(lexicons), max_distance=max_distance)
    codes = codes.where(F.col("idx").isNotNull())
    pair = F.struct(F.concat_ws(SEP, "kind", "term_raw"), F.struct(F.col("idx").cast("int").alias("idx"), F.col("priority").cast("int").alias("priority")))
    return df, rows.join(codes, ["kind", "term_raw"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(pair)).alias("_codes"))


def of_kinds(lexicons: dict[str, DataFrame]) -> DataFrame:
    """One dictionary table (kind, idx, term, priority) of several."""
    out = None
    for kind, lx in lexicons.items():
        part = lx.select(F.lit(kind).alias("kind"), "idx", "term", "priority")
        out = part if out is None else out.unionByName(part)
    return out


def extraction_terms(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """(kind, term_raw) of every term of the extraction records, with repeats."""
    p = F.col(payload_col)
    named = F.concat(_terms(p["findings_all"], "finding", "finding"), _terms(p["devices_all"], "device", "medical_device"),
                     _terms(p["diagnoses_all"], "diagnosis", "diagnosis"))
    return df.select(F.explode(named).alias("t")).select("t.kind", "t.term_raw").where(F.col("term_raw").isNotNull())


def _terms(items: Column, kind: str, name: str) -> Column:
    empty = F.array().cast("array<struct<kind:string,term_raw:string>>")
    return F.coalesce(F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x[name].alias("term_raw"))), empty)


def encode_extraction(df: DataFrame, findings_lex: DataFrame, devices_lex: DataFrame,
                      diagnoses_lex: DataFrame, *, payload_col: str = "payload", key: str = "report_id",
                      max_distance: int | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Nested form of J1/J2: code every element of the three extraction lists.

    Each coded field becomes STRUCT<code INT, raw STRING>; code NULL = not
    matched.  Findings fall back to the nearest term (Q5).  ``key`` only spreads
    equal records; it may be NULL or repeated.  ``codes`` is a code map that is already there.
    """
    lexicons = {"finding": findings_lex, "device": devices_lex, "diagnosis": diagnoses_lex}
    df, by_row = _row_codes(df, lexicons, payload_col, key, max_distance, codes)
    df = df.join(by_row, "_row", "left").drop("_row")

    def cr(code: Column, raw: Column) -> Column:
        return F.struct(code.cast("int").alias("code"), raw.alias("raw"))

    def hit_of(kind, raw):
        return F.try_element_at(F.col("_codes"), F.concat_ws(SEP, F.lit(kind), raw))

    def enc_finding(f):
        hit = hit_of("finding", f["finding"])
        return F.struct(cr(hit["idx"], f["finding"]).alias("finding"), f["location"].alias("location"),
                        f["system"].alias("system"),
                        cr(code_of(f["temporal"], TEMPORAL), f["temporal"]).alias("temporal"),
                        cr(code_of(f["uncertainty"], UNCERTAINTY), f["uncertainty"]).alias("uncertainty"),
                        hit["priority"].alias("priority"))

    def enc_device(d):
        hit = hit_of("device", d["medical_device"])
        return F.struct(cr(hit["idx"], d["medical_device"]).alias("medical_device"),
                        cr(code_of(d["placement"], PLACEMENT), d["placement"]).alias("placement"),
                        hit["priority"].alias("priority"))

    def enc_diag(x):
        hit = hit_of("diagnosis", x["diagnosis"])
        return F.struct(cr(hit["idx"], x["diagnosis"]).alias("diagnosis"),
                        cr(code_of(x["temporal"], TEMPORAL), x["temporal"]).alias("temporal"),
                        hit["priority"].alias("priority"))

    p = F.col(payload_col)
    return df.withColumn("encoded", F.struct(
        F.transform(F.coalesce(p["findings_all"], F.array()), enc_finding).alias("findings_all"),
        F.transform(F.coalesce(p["devices_all"], F.array()), enc_device).alias("devices_all"),
        F.transform(F.coalesce(p["diagnoses_all"], F.array()), enc_diag).alias("diagnoses_all"),
    )).drop("_codes")


def grade_extraction(encoded: DataFrame, *, encoded_col: str = "encoded", temporal_rule: bool = False,
                     diagnosis_only: str = "reference") -> DataFrame:
    """Nested form of A1-A3: priority lists, maxima, overall, row-local."""
    e = F.col(encoded_col)

    def keep(a):
        return F.filter(a, lambda x: x.isNotNull())

    fp = keep(F.transform(e["findings_all"], lambda f: F.when(
        f["finding"]["code"].isNotNull(),
        _finding_priority(f["priority"], f["uncertainty"]["code"], f["temporal"]["code"], temporal_rule))))
    lp = keep(F.transform(e["devices_all"], lambda d: F.when(
        d["medical_device"]["code"].isNotNull(), _device_priority(d["priority"], d["placement"]["code"]))))
    dp = keep(F.transform(e["diagnoses_all"], lambda x: F.when(
        x["diagnosis"]["code"].isNotNull(), _diagnosis_priority(x["priority"], x["temporal"]["code"]))))
    out = encoded.withColumns({"_fp": fp, "_lp": lp, "_dp": dp})
    f, l, d = F.col("_fp"), F.col("_lp"), F.col("_dp")
    any_fl = (F.size(f) + F.size(l)) > 0
    if diagnosis_only == "max":
        any_fl = any_fl | (F.size(d) > 0)

    def or_one(a):
        return F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(1)))

    return out.withColumns({
        "findings_priorities": or_one(f),
        "lines_priorities": or_one(l),
        "diagnoses_priorities": or_one(d),
        "max_finding_priority": F.coalesce(F.array_max(f), F.lit(1)),
        "max_line_priority": F.coalesce(F.array_max(l), F.lit(1)),
        "max_diagnosis_priority": F.coalesce(F.array_max(d), F.lit(1)),
        "overall_max_priority": F.when(any_fl, F.array_max(F.concat(f, l, d))).otherwise(F.lit(1)),
    }).drop("_fp", "_lp", "_dp")
