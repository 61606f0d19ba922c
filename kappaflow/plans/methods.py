"""The four grading methods as DataFrame plans.

    reports -> clean -> prompt -> cached model call -> decode -> defaults
Method 1 (semi-algorithmic) decodes an extraction record, encodes it
against the dictionaries and grades it with the rule set of
``operators.grading``; method 3 sees method 1's grade; method 4 calls the
judge only where two grades differ (the split is written out: Spark does
not push a filter into a model call).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decode import decode_response
from ..functions.text import clean_text, fill_template
from ..operators.grading import encode_extraction, grade_extraction
from ..operators.profile import PIPELINE_RENAMES, assert_unique, rename_if_absent
from ..schemas import EXTRACTION, GRADE, GRADE_EXPLAINED, JUDGE
from .model import cached_model_call, read_stage, request_key, stage_table, table_version
from .prompts import SYSTEM, TEMPLATES

SYSTEM_ROLE = "developer"


#: Terms of a dictionary that go into every prompt; a larger dictionary is cut to each report's candidates.
MAX_LISTED = 100_000
#: Candidate terms of a report, where the dictionary is larger.
CANDIDATES = 200


def term_list(lexicon: DataFrame, max_terms: int = MAX_LISTED) -> Column:
    """The dictionary's terms in dictionary order, ', '-joined (one scalar, size asserted)."""
    arr = F.array_sort(F.collect_list(F.struct("idx", "term")))
    s = F.array_join(F.transform(arr, lambda x: x["term"]), ", ")
    guarded = F.when(F.count(F.lit(1)) <= max_terms, s).otherwise(
        F.raise_error(F.lit(f"lexicon larger than {max_terms} terms")))
    return lexicon.select(guarded).scalar()


def candidate_terms(reports: DataFrame, lexicon: DataFrame, k: int = CANDIDATES, *, report_col: str = "TEXT_REPORT") -> DataFrame:
    """(report_id, terms): the ``k`` terms of a dictionary of any size that share most with a report, in dictionary order.

    An inverted index from words to terms: a term's score is the sum of the idf (over the terms) of its
    words that the report has, over the sum of all its words' idf; ties go to the first in the dictionary.
    Words are lower-cased, without a plural 's'.  A report that shares no word with any term has an empty list.
    """
    def words(c):
        return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0),
                                            lambda w: F.regexp_replace(w, "(?<=...)s$", "")))

    entry = lexicon.select("idx", "term", words(F.col("term")).alias("w")).select("idx", "term", F.explode("w").alias("word"))
    total = lexicon.select(F.count(F.lit(1))).scalar()
    idf = entry.groupBy("word").agg(F.log((total + 1) / F.count(F.lit(1))).alias("idf"))
    entry = entry.join(idf, "word")
    whole = entry.groupBy("idx").agg(F.sum("idf").alias("whole"))
    index = entry.join(whole, "idx").select("word", "idx", "term", (F.col("idf") / F.greatest("whole", F.lit(1e-9))).alias("part"))
    asked = reports.select("report_id", F.explode(words(F.col(report_col))).alias("word")).distinct()
    score = asked.join(index, "word").groupBy("report_id", "idx", "term").agg(F.round(F.sum("part"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("score"), "idx"))
    best = score.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "term"))), lambda x: x["term"]), ", ").alias("terms"))


def with_term_lists(df: DataFrame, lexicons: dict[str, DataFrame], *, report_col: str = "TEXT_REPORT", max_terms: int = MAX_LISTED,
                    k: int = CANDIDATES) -> DataFrame:
    """``df`` with a column of terms for each dictionary: all of them, or, of a dictionary with more than ``max_terms``
    terms, which no prompt can hold, the report's candidates."""
    for name, lexicon in lexicons.items():
        if lexicon.limit(max_terms + 1).count() <= max_terms:
            df = df.withColumn(name, term_list(lexicon, max_terms))
        else:
            found = candidate_terms(df, lexicon, k, report_col=report_col).withColumnRenamed("terms", name)
            df = df.join(found, "report_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return df


def build_messages(method: str, holes: dict[str, Column], system: str = SYSTEM) -> Column:
    """G1: [system, user] chat messages for one method."""
    user = fill_template(TEMPLATES[method], holes)
    return F.array(F.struct(F.lit(SYSTEM_ROLE).alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


#: Column with ``text_digest`` of a report, where it is taken before a join.
DIGEST = "_text_digest"


def text_digest(text: Column) -> Column:
    """What stands for a text in a request key: a text need not travel through a join to be told from others."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def with_requests(df: DataFrame, method: str, holes: dict[str, Column], model_name: str, keyed: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with messages, report (the text alone), method and request_key.

    The key hashes what differs between prompts of a method, the values of its
    holes, so no prompt is built to find equal ones.  ``keyed`` has the columns that
    stand for a hole's value in the key (see ``text_digest``).
    """
    values = [F.coalesce({**holes, **(keyed or {})}[k].cast("string"), F.lit("")) for k in sorted(holes)]
    return df.withColumns({"messages": build_messages(method, holes), "method": F.lit(method),
                           "report": holes.get("rpt", F.lit(None).cast("string")),
                           "request_key": request_key(model_name, method, TEMPLATES[method] + SYSTEM, values)})


def _answers(df, method, holes, model, model_name, cache, stage, cache_path=None, keyed=None) -> DataFrame:
    """(report_id, payload, error): narrow, so no text travels with the answers."""
    req = with_requests(df, method, holes, model_name, keyed)
    got = cached_model_call(req, model, cache=cache, stage=f"{stage}-answers-{method}" if stage else None,
                            cache_path=cache_path, methods=[method])
    return got.select("report_id", "payload", "error")


def _back(df: DataFrame, narrow: DataFrame) -> DataFrame:
    """The rows of ``df`` with the result columns of their report."""
    return df.join(narrow, "report_id", "left").select(*[F.col(c) for c in df.columns],
                                                       *[F.col(c) for c in narrow.columns if c != "report_id"])


SEMIALGO_PRIORITIES = ["findings_priorities", "lines_priorities", "diagnoses_priorities", "max_finding_priority",
                       "max_line_priority", "max_diagnosis_priority", "overall_max_priority"]


def semialgo_columns(df: DataFrame, model, findings_lex, devices_lex, diagnoses_lex, *, report_col: str = "TEXT_REPORT",
                     model_name: str = "model", cache=None, stage: str | None = None, cache_path=None) -> DataFrame:
    """G2 + G3, narrow: extraction call -> record -> codes -> priorities, by report_id."""
    d = with_term_lists(df, {"_fl": findings_lex, "_dl": devices_lex, "_xl": diagnoses_lex}, report_col=report_col)
    holes = {"findings_str": F.col("_fl"), "devices_str": F.col("_dl"),
             "diagnoses_str": F.col("_xl"), "rpt": F.col(report_col)}
    r = _answers(d, "extract", holes, model, model_name, cache, stage, cache_path)
    r = r.select("report_id", decode_response("payload", EXTRACTION, required=[]).alias("_x"))  # an absent list is an empty one (P12)
    # Read twice, for the terms and for the grades: neither the answers' join nor the decoding is repeated.
    r = stage_table(r, f"{stage}-records") if stage else r.checkpoint()
    # Q8 / Q23: a failed extraction leaves every method-1 column NULL.
    ok = F.col("_x.status") == "ok"
    r = r.withColumn("payload_rec", F.when(ok, F.struct(
        F.col("_x.findings_all").alias("findings_all"), F.col("_x.devices_all").alias("devices_all"),
        F.col("_x.diagnoses_all").alias("diagnoses_all"))))
    g = grade_extraction(encode_extraction(r, findings_lex, devices_lex, diagnoses_lex, payload_col="payload_rec"))
    g = g.withColumns({c: F.when(ok, F.col(c)) for c in SEMIALGO_PRIORITIES})
    g = g.withColumns({"report_findings": F.when(ok, F.col("encoded.findings_all")),
                       "report_lines": F.when(ok, F.col("encoded.devices_all")),
                       "report_diagnoses": F.when(ok, F.col("encoded.diagnoses_all")),
                       "semialgo_status": F.col("_x.status")})
    return g.select("report_id", "report_findings", "report_lines", "report_diagnoses", *SEMIALGO_PRIORITIES, "semialgo_status")


def llm_columns(df: DataFrame, model, *, report_col: str = "TEXT_REPORT", model_name: str = "model", cache=None,
                stage: str | None = None, cache_path=None) -> DataFrame:
    """G4, narrow: direct grade; a failed call gives 0."""
    r = _answers(df, "llm", {"rpt": F.col(report_col)}, model, model_name, cache, stage, cache_path)
    r = r.withColumn("_x", decode_response("payload", GRADE))
    return r.select("report_id", F.coalesce(F.col("_x.grade"), F.lit(0)).alias("llm_grade"),
                    F.col("_x.status").alias("llm_status"))


def hybrid_columns(df: DataFrame, model, findings_lex, diagnoses_lex, *, report_col: str = "TEXT_REPORT",
                   semialgo_col: str = "overall_max_priority", model_name: str = "model", cache=None,
                   stage: str | None = None, cache_path=None) -> DataFrame:
    """G5, narrow: grade that sees method 1's grade; failure -> 0 and ''."""
    d = with_term_lists(df, {"_fl": findings_lex, "_xl": diagnoses_lex}, report_col=report_col)
    holes = {"findings_str": F.col("_fl"), "diagnoses_str": F.col("_xl"),
             "grade_semialgo": F.col(semialgo_col), "rpt": F.col(report_col)}
    r = _answers(d, "hybrid", holes, model, model_name, cache, stage, cache_path)
    r = r.withColumn("_x", decode_response("payload", GRADE_EXPLAINED))  # without explanation the grade stays (P11)
    return r.select("report_id", F.coalesce(F.col("_x.grade"), F.lit(0)).alias("hybrid_grade"),
                    F.coalesce(F.col("_x.explanation"), F.lit("")).alias("hybrid_explanation"),
                    F.col("_x.status").alias("hybrid_status"))


def judge_columns(df: DataFrame, model, *, report_col: str = "TEXT_REPORT", manual_col: str = "priority_manual",
                  algo_col: str = "priority_algo", llm_col: str = "priority_llm", model_name: str = "model",
                  cache=None, stage: str | None = None, cache_path=None, digest_col: str | None = None) -> DataFrame:
    """G6-G8, narrow: judge algo vs LLM, then the verdict vs the manual grade.

    The requests of both steps are keyed by the text's digest.  ``digest_col``: ``df`` has it
    already, taken where the reports are read; then no text goes through the joins unless the model reads it.

    Only rows whose grades differ are asked about (J7).  Equal grades make no
    call: grade kept, choice 3, reasoning NULL (Q14).  Any failed call fails
    the row: 0, 0, '' for both steps (Q8).
    """
    a, l, m = F.col(algo_col), F.col(llm_col), F.col(manual_col)
    same = F.coalesce(a == l, F.lit(False))

    if digest_col is None:
        digest_col, df = DIGEST, df.withColumn(DIGEST, text_digest(F.col(report_col)))

    def verdicts(rows, method, holes, prefix):
        got = _answers(rows, method, holes, model, model_name, cache, stage, cache_path, {"rpt": F.col(digest_col)})
        return got.select("report_id", decode_response("payload", JUDGE, required=["grade", "choice", "explanation"]).alias(prefix))

    grades = df.select("report_id", a.alias("_a"), m.alias("_m"), (~same).alias("_need"))
    inner = verdicts(df.where(~same), "judge", {"grade_algo": a, "grade_llm": l, "rpt": F.col(report_col)}, "_j1")
    s1 = grades.join(inner, "report_id", "left").select(
        "report_id", "_m",
        F.when(~F.col("_need"), F.col("_a")).otherwise(F.col("_j1.grade")).alias("_g1"),
        F.when(~F.col("_need"), F.lit(3)).otherwise(F.col("_j1.choice")).alias("_c1"),
        F.when(F.col("_need"), F.col("_j1.explanation")).alias("_e1"),
        (~F.col("_need") | F.coalesce(F.col("_j1.status") == "ok", F.lit(False))).alias("_ok1"))
    if stage is not None:  # cut the lineage: step 2 reads step 1 twice
        s1 = stage_table(s1, f"{stage}-judge-step1")
    s1 = s1.withColumn("_need", F.col("_ok1") & ~F.coalesce(F.col("_m") == F.col("_g1"), F.lit(False)))
    asked = df.select("report_id", F.col(report_col).alias("_text"), digest_col).join(
        s1.where("_need").select("report_id", "_g1", "_m"), "report_id")
    outer = verdicts(asked, "judge_ext", {"grade_auto": F.col("_g1"), "grade_manual": F.col("_m"), "rpt": F.col("_text")}, "_j2")
    s2 = s1.join(outer, "report_id", "left")
    ok = F.col("_ok1") & (~F.col("_need") | F.coalesce(F.col("_j2.status") == "ok", F.lit(False)))
    g2 = F.when(~F.col("_need"), F.col("_g1")).otherwise(F.col("_j2.grade"))
    c2 = F.when(~F.col("_need"), F.lit(3)).otherwise(F.col("_j2.choice"))
    e2 = F.when(F.col("_need"), F.col("_j2.explanation"))
    return s2.select(
        "report_id",
        F.when(ok, F.col("_g1")).otherwise(0).cast("int").alias("judge_grade"),
        F.when(ok, F.col("_c1")).otherwise(0).cast("int").alias("judge_choice"),
        F.when(ok, F.col("_e1")).otherwise(F.lit("")).alias("judge_reasoning"),
        F.when(ok, g2).otherwise(0).cast("int").alias("judge_grade_ext"),
        F.when(ok, c2).otherwise(0).cast("int").alias("judge_choice_ext"),
        F.when(ok, e2).otherwise(F.lit("")).alias("judge_reasoning_ext"))


def grade_semialgo(df: DataFrame, model, findings_lex, devices_lex, diagnoses_lex, **how) -> DataFrame:
    """G2 + G3: ``df`` with the ten columns of method 1 and its status (see ``semialgo_columns``)."""
    return _back(df, semialgo_columns(df, model, findings_lex, devices_lex, diagnoses_lex, **how))


def grade_llm(df: DataFrame, model, **how) -> DataFrame:
    """``df`` with the direct grade and its status (see ``llm_columns``)."""
    return _back(df, llm_columns(df, model, **how))


def grade_hybrid(df: DataFrame, model, findings_lex, diagnoses_lex, **how) -> DataFrame:
    """``df`` with the hybrid grade, explanation and status (see ``hybrid_columns``)."""
    return _back(df, hybrid_columns(df, model, findings_lex, diagnoses_lex, **how))


def grade_judge(df: DataFrame, model, **how) -> DataFrame:
    """``df`` with the six judge columns (see ``judge_columns``)."""
    return _back(df, judge_columns(df, model, **how))


def grade_all_methods(df: DataFrame, model, findings_lex, devices_lex, diagnoses_lex, *,
                      report_col: str = "TEXT_REPORT", model_name: str = "model", cache=None, cache_path: str | None = None,
                      save_intermediate: bool = True, stage: str = "grading", run: str | None = None) -> DataFrame:
    """Clean -> method 1 -> method 3 -> method 2 -> rename -> method 4.

    With ``save_intermediate`` (the default) the cleaned reports are written
    once under the shared stage folder and every method's result columns in a
    narrow table of their own (S7): a retry after an executor loss reads the
    stage, it does not repeat model calls, and no stage writes the text again.
    With ``run``, the stages belong to that run and a second start takes up
    after the last one that was completed, if reports, dictionaries and model name are the
    same (one pass over them makes the fingerprint that each stage keeps); else they are
    computed anew (``model.clear_run`` removes them).
    Report ids must be unique (Q21); that is checked first.
    """
    stage = f"{run}/{stage}" if run else stage
    version = table_version(df, findings_lex, devices_lex, diagnoses_lex, model=model_name, report=report_col) if run and save_intermediate else None
    # Inner stages (answers, the judge's first step) have the version in their names.
    st = (f"{stage}-{version[:12]}" if version else stage) if save_intermediate else None

    def keep(make, name):
        """A stage that is there is read; what would make it is not even planned, so it calls no model."""
        if not save_intermediate:
            return make()
        found = read_stage(df.sparkSession, f"{stage}-{name}", version=version)
        return found if found is not None else stage_table(make(), f"{stage}-{name}", version=version)

    how = {"report_col": report_col, "model_name": model_name, "cache": cache, "cache_path": cache_path, "stage": st}
    base = keep(lambda: assert_unique(df).withColumn(report_col, clean_text(report_col)), "reports")
    semi = keep(lambda: semialgo_columns(base, model, findings_lex, devices_lex, diagnoses_lex, **how), "semialgo")
    hybrid = keep(lambda: hybrid_columns(_back(base, semi.select("report_id", "overall_max_priority")), model, findings_lex, diagnoses_lex,
                                         **how), "hybrid")
    llm = keep(lambda: llm_columns(base, model, **how), "llm")
    grades = semi.join(hybrid, "report_id").join(llm, "report_id")  # narrow: a row per report in each
    d = rename_if_absent(_back(base.withColumn(DIGEST, text_digest(F.col(report_col))), grades), PIPELINE_RENAMES)
    if all(c in d.columns for c in ("priority_manual", "priority_algo", "priority_llm")):  # P4
        d = _back(d, judge_columns(d, model, digest_col=DIGEST, **how))
    return d.drop(DIGEST)


def score_rows(df: DataFrame, fn, schema, partitions: int | None = None) -> DataFrame:
    """A per-row function whose result dictionary becomes columns (mapInPandas).

    ``fn(row: dict) -> dict``; exceptions give NULL columns for that row.
    """
    from pyspark.sql import types as T
    out_schema = T.StructType(list(df.schema.fields) + list(schema.fields))
    names = [f.name for f in schema.fields]

    def run(batches):
        import pandas as pd
        for pdf in batches:
            res = []
            for rec in pdf.to_dict("records"):
                try:
                    r = fn(rec) or {}
                except Exception:  # noqa: BLE001
                    r = {}
                res.append({k: r.get(k) for k in names})
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(res, columns=names)], axis=1)

    src = df.repartition(partitions) if partitions else df
    return src.mapInPandas(run, out_schema)
