"""Adapter views: shape the given tables into the engine's input schemas.

Each view exists twice: as a DataFrame (Spark side) and as SQL text (the
DuckDB oracle puts it in front of a query as a CTE).  Both were written to
give equal rows; see FIXTURES.md section 2 for the definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table
from ..functions.grouping import group_threshold

# ---------------------------------------------------------------- Spark side


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, term, priority): distinct part names ordered by name.

    DISTINCT first, so the global rank window runs over the distinct names
    only (a dictionary, bounded), never over the part table.
    """
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    r = F.dense_rank().over(Window.orderBy("term")) - 1
    return names.select(r.cast("int").alias("idx"), "term",
                        (F.lit(1) + r % 5).cast("int").alias("priority"))


def lexicon_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second dictionary: priority 6 - priority, every 10th term left out."""
    lx = lexicon(spark, sf_dir)
    return (lx.filter(F.col("idx") % 10 != 9)
            .select("idx", "term", (F.lit(6) - F.col("priority")).cast("int").alias("priority")))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # Part keys run from 0 to their maximum; the prime spreads the events over all of them.
    last = table(spark, sf_dir, "part").select(F.max("p_partkey")).scalar()
    e = e.withColumn("part_key", (F.col("event_id") * 7919) % (last + 1))
    j = e.join(p, p.p_partkey == e.part_key)
    term = (F.when(F.col("event_id") % 5 == 0, F.replace(F.col("p_name"), F.lit("e"), F.lit("")))
            .when(F.col("event_id") % 5 == 1, F.concat(F.col("p_name"), F.lit("s")))
            .otherwise(F.col("p_name")))
    kind = (F.when(F.col("user_id") % 3 == 0, "finding").when(F.col("user_id") % 3 == 1, "device")
            .otherwise("diagnosis"))
    return j.select(
        F.floor(F.col("event_id") / 4).cast("long").alias("report_id"),
        F.col("event_id").alias("mention_id"),
        kind.alias("kind"),
        term.alias("term_raw"),
        (F.col("event_id") % 5).cast("int").alias("temporal"),
        (F.col("event_id") % 3).cast("int").alias("uncertainty"),
        (F.col("event_id") % 4).cast("int").alias("placement"),
        F.col("event_type").alias("system"),
        F.col("ts"),
    )


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("g"))
    k, g = F.col("report_id"), F.col("g")
    return o.select(
        "report_id",
        group_threshold(g).alias("priority_manual"),
        F.when(k % 97 == 0, F.lit(None).cast("int")).when(k % 7 == 0, F.least(F.lit(5), g + 1))
        .when(k % 11 == 0, F.greatest(F.lit(1), g - 1)).otherwise(g).alias("priority_algo"),
        F.when(k % 13 == 0, F.greatest(F.lit(1), g - 2)).otherwise(g).alias("priority_llm"),
        F.when(k % 17 == 0, F.lit(0)).when(k % 9 == 0, F.greatest(F.lit(1), g - 1))
        .otherwise(g).alias("judge_grade"),
        F.when(k % 10 == 0, F.least(F.lit(5), g + 1)).when(k % 43 == 0, F.greatest(F.lit(1), g - 2))
        .otherwise(g).alias("priority_hybrid"),
    )


def graded_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten repeated gradings of every order by four methods, in long form (generated per row, no cross join)."""
    g = graded(spark, sf_dir)
    g = g.select("report_id", "priority_manual", "priority_algo", "priority_llm", "priority_hybrid",
                 F.explode(F.sequence(F.lit(1), F.lit(10))).alias("it"))
    r, it = F.col("report_id"), F.col("it")
    return g.filter((r + 3 * it) % 41 != 0).select(
        "report_id", "it",
        # Run 10 has a manual grade in a handful of reports only: its pairs are too few to test.
        F.when((it < 10) | (r <= 4), F.col("priority_manual")).alias("priority_manual"),
        F.when((r * it) % 29 == 7, F.greatest(F.lit(1), F.col("priority_algo") - 1))
        .otherwise(F.col("priority_algo")).alias("priority_algo"),
        F.when((r + it) % 23 == 0, F.lit(None).cast("int"))
        .when((r * it) % 19 == 3, F.least(F.lit(5), F.col("priority_llm") + 1))
        .otherwise(F.col("priority_llm")).alias("priority_llm"),
        F.when((r * it) % 17 == 5, F.greatest(F.lit(1), F.col("priority_hybrid") - 1))
        .otherwise(F.col("priority_hybrid")).alias("priority_hybrid"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(
        F.col("doc_id").alias("report_id"),
        F.concat(F.lit("CHEST of "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit("-Jan-2024:"),
                 F.lit("\n\n"), F.col("text"), F.lit(" Accession No:A"),
                 F.col("doc_id").cast("string"), F.lit("\n")).alias("TEXT_REPORT"),
    )


def reports_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports plus the graded columns of the same id (pipeline input)."""
    return reports(spark, sf_dir).join(graded(spark, sf_dir), "report_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("report_id"), F.col("quality").alias("truth"),
        F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("pred"),
        F.col("n_chars").alias("score"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("report_id"), "turn", "role", F.col("text").alias("content"))


# ---------------------------------------------------------------- SQL side

VIEW_SQL = {
    "lexicon": """
SELECT CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INT) AS idx, p_name AS term,
       CAST(1 + (dense_rank() OVER (ORDER BY p_name) - 1) % 5 AS INT) AS priority
FROM (SELECT DISTINCT p_name FROM part) t""",
    "lexicon_alt": """
SELECT idx, term, CAST(6 - priority AS INT) AS priority FROM lexicon WHERE idx % 10 <> 9""",
    "mentions": """
SELECT CAST(floor(e.event_id / 4) AS BIGINT) AS report_id, e.event_id AS mention_id,
       CASE e.user_id % 3 WHEN 0 THEN 'finding' WHEN 1 THEN 'device' ELSE 'diagnosis' END AS kind,
       CASE e.event_id % 5 WHEN 0 THEN replace(p.p_name, 'e', '') WHEN 1 THEN concat(p.p_name, 's')
            ELSE p.p_name END AS term_raw,
       CAST(e.event_id % 5 AS INT) AS temporal, CAST(e.event_id % 3 AS INT) AS uncertainty,
       CAST(e.event_id % 4 AS INT) AS placement, e.event_type AS system, e.ts AS ts
FROM events e JOIN part p ON p.p_partkey = (e.event_id * 7919) % ((SELECT max(p_partkey) FROM part) + 1)""",
    "graded": """
SELECT o_orderkey AS report_id,
       CASE WHEN g <= 2 THEN 0 WHEN g <= 4 THEN 1 ELSE 2 END AS priority_manual,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN least(5, g + 1)
            WHEN o_orderkey % 11 = 0 THEN greatest(1, g - 1) ELSE g END AS priority_algo,
       CASE WHEN o_orderkey % 13 = 0 THEN greatest(1, g - 2) ELSE g END AS priority_llm,
       CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 9 = 0 THEN greatest(1, g - 1)
            ELSE g END AS judge_grade,
       CASE WHEN o_orderkey % 10 = 0 THEN least(5, g + 1) WHEN o_orderkey % 43 = 0 THEN greatest(1, g - 2)
            ELSE g END AS priority_hybrid
FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS g FROM orders) t""",
    "graded_iter": """
SELECT report_id, it, CASE WHEN it < 10 OR report_id <= 4 THEN priority_manual END AS priority_manual,
       CASE WHEN (report_id * it) % 29 = 7 THEN greatest(1, priority_algo - 1) ELSE priority_algo END AS priority_algo,
       CASE WHEN (report_id + it) % 23 = 0 THEN NULL
            WHEN (report_id * it) % 19 = 3 THEN least(5, priority_llm + 1)
            ELSE priority_llm END AS priority_llm,
       CASE WHEN (report_id * it) % 17 = 5 THEN greatest(1, priority_hybrid - 1)
            ELSE priority_hybrid END AS priority_hybrid
FROM graded CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS i(it)
WHERE (report_id + 3 * it) % 41 <> 0""",
    "reports": """
SELECT doc_id AS report_id,
       concat('CHEST of ', CAST(doc_id % 28 + 1 AS VARCHAR), '-Jan-2024:', chr(10), chr(10), text,
              ' Accession No:A', CAST(doc_id AS VARCHAR), chr(10)) AS TEXT_REPORT
FROM documents""",
    "reports_with_truth": """
SELECT r.report_id, r.TEXT_REPORT, g.priority_manual, g.priority_algo, g.priority_llm,
       g.judge_grade, g.priority_hybrid
FROM reports r JOIN graded g ON g.report_id = r.report_id""",
    "scored": """
SELECT l.doc_id AS report_id, l.quality AS truth, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS pred,
       d.n_chars AS score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "messages": """
SELECT conv_id AS report_id, turn, role, text AS content FROM conversations""",
}

def clean_sql(x: str) -> str:
    """The clean_text expression (P1) in DuckDB SQL."""
    t = f"regexp_replace({x}, 'CHEST\\sof\\s\\d+-\\S{{3}}-\\d{{4}}:', '', 'g')"
    t = f"regexp_replace({t}, 'Accession\\sNo:\\S+', '', 'g')"
    t = f"regexp_replace({t}, '\\n+', chr(10), 'g')"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


_PLANT_SQL = """CASE WHEN kind = 'diagnosis' THEN (CASE mention_id % 4 WHEN 0 THEN 'Suggestive of infection.'
      WHEN 1 THEN 'Malignancy cannot be excluded.' WHEN 2 THEN 'No evidence of tuberculosis.'
      ELSE 'P1 for ' || term_raw || '.' END)
  ELSE (CASE WHEN mention_id % 7 = 0 THEN 'No ' WHEN uncertainty = 1 THEN 'Possibly ' ELSE '' END) || term_raw
       || list_extract([' is new', ' is better', ' is worse', ' is stable', ''], temporal + 1)
       || CASE WHEN kind = 'device' THEN list_extract([' in satisfactory position', ' in suboptimal position',
                                                     ' malpositioned', ''], placement + 1) ELSE '' END || '.' END"""

VIEW_SQL["annotated_reports"] = f"""
SELECT r.report_id, {clean_sql('r.TEXT_REPORT')} || chr(10) || p.planted AS TEXT_REPORT
FROM reports r JOIN (SELECT report_id, string_agg({_PLANT_SQL}, chr(10) ORDER BY mention_id) AS planted
                     FROM mentions GROUP BY report_id) p ON p.report_id = r.report_id"""

VIEW_DEPS = {
    "annotated_reports": ["reports", "mentions"],
    "lexicon_alt": ["lexicon"],
    "graded_iter": ["graded"],
    "reports_with_truth": ["reports", "graded"],
}


def with_views(views: list[str] | str, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the adapter views it needs as CTEs (dependencies first)."""
    if isinstance(views, str):
        views = [views]
    order: list[str] = []

    def add(v):
        for d in VIEW_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in order]
    ctes += [f"{n} AS ({s.strip()})" for n, s in (extra or [])]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":  # the body's own CTEs follow the views
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _word(code, words):
    return F.element_at(F.array(*[F.lit(w) for w in words]), code + 1)


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested extraction records (one per report), as a model would return them.

    Built from ``mentions``: codes become the words of the fixed code lists,
    list order is mention order.  A report's lists hold what one response
    holds (4 mentions per report by construction of the fixture).
    """
    from ..schemas import PLACEMENT, TEMPORAL, UNCERTAINTY

    m = mentions(spark, sf_dir)
    k = F.col("kind")
    fnd = F.struct(F.col("term_raw").alias("finding"), F.lit(None).cast("string").alias("location"),
                   F.col("system").alias("system"), _word(F.col("temporal"), TEMPORAL).alias("temporal"),
                   _word(F.col("uncertainty"), UNCERTAINTY).alias("uncertainty"))
    dev = F.struct(F.col("term_raw").alias("medical_device"),
                   _word(F.col("placement"), PLACEMENT).alias("placement"))
    dia = F.struct(F.col("term_raw").alias("diagnosis"), _word(F.col("temporal"), TEMPORAL).alias("temporal"))

    def ordered(kind, v):
        arr = F.array_sort(F.collect_list(F.when(k == kind, F.struct(F.col("mention_id").alias("o"), v.alias("v")))))
        return F.transform(arr, lambda x: x["v"])

    return m.groupBy("report_id").agg(F.struct(
        ordered("finding", fnd).alias("findings_all"),
        ordered("device", dev).alias("devices_all"),
        ordered("diagnosis", dia).alias("diagnoses_all")).alias("payload"))


def replay_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model responses per (method, report_id), made from ``graded``.

    Variants by report_id % 10 exercise the decoder: 3 wrapped in text,
    5 cut off, 7 wrong type (llm) / failed call (judge_ext), 9 no JSON.
    Judge grade 0 means the judge call failed (NULL payload).
    """
    g = reports_with_truth(spark, sf_dir).drop("TEXT_REPORT")
    v = F.col("report_id") % 10
    s = lambda c: F.col(c).cast("string")
    llm_ok = F.concat(F.lit('{"grade": '), s("priority_llm"), F.lit("}"))
    llm = (F.when(v == 3, F.concat(F.lit("Sure: "), llm_ok, F.lit(" done")))
           .when(v == 5, F.concat(F.lit('{"grade": '), s("priority_llm")))
           .when(v == 7, F.lit('{"grade": "high"}'))
           .when(v == 9, F.lit("I cannot grade this report."))
           .otherwise(llm_ok))
    expl = F.when(F.col("priority_hybrid") == F.col("priority_algo"), F.lit("agree")).otherwise(F.lit("disagree"))
    hyb = F.when(v == 5, F.concat(F.lit('{"grade": '), s("priority_hybrid"), F.lit(', "explanation": "cut'))) \
        .otherwise(F.concat(F.lit('{"grade": '), s("priority_hybrid"), F.lit(', "explanation": "'), expl,
                            F.lit('"}')))
    jc = (F.when(F.col("judge_grade") == F.col("priority_algo"), 1)
          .when(F.col("judge_grade") == F.col("priority_llm"), 2).otherwise(0))
    judge = F.when(F.col("judge_grade") != 0, F.concat(
        F.lit('{"grade": '), s("judge_grade"), F.lit(', "choice": '), jc.cast("string"),
        F.lit(', "explanation": "inner"}')))
    e = F.greatest(F.lit(1), F.col("priority_hybrid"))
    ec = F.when(e == F.col("priority_manual"), 2).otherwise(1)
    judge_ext = F.when(v != 7, F.concat(F.lit('{"grade": '), e.cast("string"), F.lit(', "choice": '),
                                         ec.cast("string"), F.lit(', "explanation": "outer"}')))
    rows = g.select("report_id", F.explode(F.array(
        F.struct(F.lit("llm").alias("method"), llm.alias("payload")),
        F.struct(F.lit("hybrid").alias("method"), hyb.alias("payload")),
        F.struct(F.lit("judge").alias("method"), judge.alias("payload")),
        F.struct(F.lit("judge_ext").alias("method"), judge_ext.alias("payload")))).alias("r"))
    rows = rows.select("report_id", "r.method", "r.payload")
    ext = extractions(spark, sf_dir).select("report_id", F.lit("extract").alias("method"),
                                            F.to_json("payload").alias("payload"))
    return rows.unionByName(ext)


def planted_sentence() -> "F.Column":
    """One sentence per mention, planted into the report text (see annotated_reports)."""
    m, t, k = F.col("mention_id"), F.col("term_raw"), F.col("kind")
    tmp = F.element_at(F.array(F.lit(" is new"), F.lit(" is better"), F.lit(" is worse"), F.lit(" is stable"),
                               F.lit("")), F.col("temporal") + 1)
    plc = F.when(k == "device", F.element_at(F.array(
        F.lit(" in satisfactory position"), F.lit(" in suboptimal position"), F.lit(" malpositioned"), F.lit("")),
        F.col("placement") + 1)).otherwise(F.lit(""))
    pre = F.when(m % 7 == 0, F.lit("No ")).when(F.col("uncertainty") == 1, F.lit("Possibly ")).otherwise(F.lit(""))
    diag = F.element_at(F.array(F.lit("Suggestive of infection."), F.lit("Malignancy cannot be excluded."),
                                F.lit("No evidence of tuberculosis."), F.concat(F.lit("P1 for "), t, F.lit("."))),
                        (m % 4 + 1).cast("int"))
    return F.when(k == "diagnosis", diag).otherwise(F.concat(pre, t, tmp, plc, F.lit(".")))


def annotated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned reports with one planted line per mention (terms and cue phrases)."""
    from ..functions.text import clean_text
    m = mentions(spark, sf_dir)
    lines = m.groupBy("report_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("mention_id", planted_sentence().alias("s")))),
        lambda x: x["s"]), "\n").alias("planted"))
    r = reports(spark, sf_dir).select("report_id", clean_text("TEXT_REPORT").alias("txt"))
    return r.join(lines, "report_id").select(
        "report_id", F.concat(F.col("txt"), F.lit("\n"), F.col("planted")).alias("TEXT_REPORT"))


#: Sentences whose reading is known: (text, grade, diagnosis, [(words as they stand, dictionary term, negated, uncertainty,
#: temporal, placement)]).  They are planted by ``case_reports``; the oracles read this list, not a pattern.
CASES = [
    ("No mass but massive consolidation.", 4, None, [("mass", "mass", 1, 0, 4, 3), ("consolidation", "consolidation", 0, 0, 4, 3)]),
    ("No pneumothorax on the left; pneumothorax on the right.", 5, None,
     [("pneumothorax", "pneumothorax", 1, 0, 4, 3), ("pneumothorax on the right", "pneumothorax", 0, 0, 4, 3)]),
    ("No pneumothorax is seen and there is a new consolidation.", 4, None,
     [("pneumothorax", "pneumothorax", 1, 0, 4, 3), ("consolidation", "consolidation", 0, 0, 0, 3)]),
    ("No pleural effusion, large pneumothorax on the right.", 5, None,
     [("pleural effusion", "pleural effusion", 1, 0, 4, 3), ("pneumothorax", "pneumothorax", 0, 0, 4, 3)]),
    ("Pneumothorax is excluded.", 1, None, [("Pneumothorax", "pneumothorax", 1, 0, 4, 3)]),
    ("Bilateral pleural effusions.", 4, None, [("pleural effusions", "pleural effusion", 0, 0, 4, 3)]),
    ("Several masses in the lung.", 4, None, [("masses", "mass", 0, 0, 4, 3)]),
    ("Airspace opacity, probably new.", 4, None, [("Airspace opacity", "airspace opacities", 0, 0, 0, 3)]),
    ("Multiple nodules are unchanged.", 3, None, [("nodules", "nodule", 0, 0, 3, 3)]),
    ("Vascular calcifications are seen.", 2, None, []),
    ("A hazy opacity is possible.", 4, None, []),
    ("Calcified adenopathy.", 3, None, [("Calcified adenopathy", "calcified adenopathy", 0, 0, 4, 3)]),
    ("There is a small left pleural effusion.", 3, None, [("pleural effusion", "pleural effusion", 0, 0, 4, 3)]),
    ("Possibly a mass, while cardiomegaly is stable.", 4, None, [("mass", "mass", 0, 1, 4, 3), ("cardiomegaly", "cardiomegaly", 0, 0, 3, 3)]),
    ("No consolidation, mass or pneumothorax.", 1, None,
     [("consolidation", "consolidation", 1, 0, 4, 3), ("mass", "mass", 1, 0, 4, 3), ("pneumothorax", "pneumothorax", 1, 0, 4, 3)]),
    ("Pneumothorax, mass and consolidation are excluded.", 1, None,
     [("Pneumothorax", "pneumothorax", 1, 0, 4, 3), ("mass", "mass", 1, 0, 4, 3), ("consolidation", "consolidation", 1, 0, 4, 3)]),
    ("Malignancy cannot be excluded.", 4, "Lung cancer", []),
    ("The loculated pleural effusion has resolved.", 1, None, [("loculated pleural effusion", "loculated pleural effusion", 1, 0, 4, 3)]),
    ("Stable tuberculosis, with new consolidation.", 4, "Tuberculosis", [("consolidation", "consolidation", 0, 0, 0, 3)]),
    ("The chest drain is malpositioned without pneumothorax.", 5, None, [("pneumothorax", "pneumothorax", 1, 0, 4, 2)]),
    ("No change in the large pneumothorax.", 5, None, [("pneumothorax", "pneumothorax", 0, 0, 4, 3)]),
    ("No evidence of infection; the tumour is unchanged.", 3, "Lung cancer", []),
    ("The mass is no longer seen.", 1, None, [("mass", "mass", 1, 0, 4, 3)]),
]


def case_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of four sentences out of ``CASES``, one sentence a line, as the events name them."""
    cases = F.array(*[F.lit(c[0]) for c in CASES])
    e = table(spark, sf_dir, "events").select("event_id")
    line = F.element_at(cases, ((F.col("event_id") * 7) % len(CASES) + 1).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("o"), line.alias("s"))))
    return e.groupBy(F.floor(F.col("event_id") / 4).cast("long").alias("report_id")).agg(
        F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("TEXT_REPORT"))


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


VIEW_SQL["cases"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_quoted(t)}, {g}, {_quoted(d)})" for i, (t, g, d, _) in enumerate(CASES)) + ") AS v(case_no, sentence, grade, diagnosis)"
VIEW_SQL["case_terms"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_quoted(m[0])}, {_quoted(m[1])}, {m[2]} = 1, {m[3]}, {m[4]}, {m[5]})" for i, c in enumerate(CASES) for m in c[3]
) + ") AS v(case_no, surface, term, negated, uncertainty, temporal, placement)"
VIEW_SQL["case_lines"] = f"""
SELECT CAST(floor(event_id / 4) AS BIGINT) AS report_id, (event_id * 7) % {len(CASES)} AS case_no, cases.sentence, cases.grade, cases.diagnosis,
       row_number() OVER w - 1 AS sent_no, sum(length(cases.sentence) + 1) OVER w - length(cases.sentence) - 1 AS line_start
FROM events JOIN cases ON cases.case_no = (event_id * 7) % {len(CASES)}
WINDOW w AS (PARTITION BY floor(event_id / 4) ORDER BY event_id)"""
VIEW_DEPS["case_lines"] = ["cases"]
