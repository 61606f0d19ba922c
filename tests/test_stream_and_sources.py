"""Stream equals batch (R1); dictionary file scan keeps order."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from kappaflow.sources import adapters as A
from kappaflow.sources.dictionaries import FINDINGS
from kappaflow.sources.files import lexicon_scan


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    s = sorted(tuple(r) for r in qs["grade_stream"](spark, SF_SMALL).select(
        "report_id", "overall_max_priority", "findings_priorities").collect())
    b = sorted(tuple(r) for r in qs["grade_semialgo_nested"](spark, SF_SMALL).select(
        "report_id", "overall_max_priority", "findings_priorities").collect())
    assert s == b and len(s) > 0


def test_dictionary_file_order(spark, tmp_path):
    p = tmp_path / "findings.json"
    p.write_text(json.dumps(FINDINGS, indent=4))
    got = lexicon_scan(spark, str(p)).orderBy("idx").select("term", "priority").collect()
    assert [(r["term"], r["priority"]) for r in got] == list(FINDINGS.items())


def test_header_guard_reads_the_first_line_of_each_file(spark, tmp_path):
    import pytest
    from kappaflow.sources.files import scan_iterations
    for i in (1, 2):
        (tmp_path / f"iteration_{i}").mkdir()
        (tmp_path / f"iteration_{i}" / "a.csv").write_text(f"report_id,priority_llm_{i}\n1,2\n3,4\n")
    pattern, cols, head = f"{tmp_path}/iteration_*/*.csv", ["report_id", "priority_llm"], r"^report_id,priority_llm_\d+$"
    assert sorted(tuple(r) for r in scan_iterations(spark, pattern, cols, head).collect()) == [(1, 2, 1), (1, 2, 2), (3, 4, 1), (3, 4, 2)]
    (tmp_path / "iteration_2" / "a.csv").write_text("priority_llm_2,report_id\n100,3\n")
    with pytest.raises(ValueError, match="unexpected header"):
        scan_iterations(spark, pattern, cols, head)


def test_dictionary_terms_with_escapes_survive_the_file(spark, tmp_path):
    import pytest
    from kappaflow.sources.files import write_lexicon_json
    terms = ['a "b"', "c\\d", "e\nf", "é\u00a0x", "{g: 1}"]
    lex = spark.createDataFrame([(i, t, i) for i, t in enumerate(terms)], "idx int, term string, priority int")
    write_lexicon_json(lex, str(tmp_path / "lex"))
    got = [r["term"] for r in lexicon_scan(spark, str(tmp_path / "lex")).orderBy("idx").collect()]
    assert got == terms
    text = "".join(p.read_text() for p in (tmp_path / "lex").glob("*.txt"))
    assert list(json.loads(text).items()) == [(t, i) for i, t in enumerate(terms)]
    with pytest.raises(Exception, match="at most 2 terms"):
        write_lexicon_json(lex, str(tmp_path / "lex2"), max_terms=2)


def test_runs_keyed_by_report_text(spark, tmp_path):
    from kappaflow.sources.files import scan_iterations
    (tmp_path / "iteration_3").mkdir()
    (tmp_path / "iteration_3" / "a.csv").write_text('REPORT,priority_llm_3\n"line one\nline ""two""",4\n')
    got = scan_iterations(spark, f"{tmp_path}/iteration_*/*.csv", ["REPORT", "priority_llm"], r"^REPORT,priority_llm_\d+$", ("REPORT",)).collect()
    assert [tuple(r) for r in got] == [('line one\nline "two"', 4, 3)]


def test_a_key_written_twice_is_one_entry(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text('{"mass": 4, "nodule": 3, "mass": 2, "cyst": 1}')
    got = [(r["idx"], r["term"], r["priority"]) for r in lexicon_scan(spark, str(p)).orderBy("idx").collect()]
    assert got == [(i, t, v) for i, (t, v) in enumerate(json.loads(p.read_text()).items())]


def test_quoted_csv_is_read_by_many_tasks(spark, tmp_path):
    """Byte ranges that begin and end anywhere give the records of a whole-file read."""
    import csv
    import random

    from kappaflow.schemas import REPORTS
    from kappaflow.sources.files import scan_quoted_csv
    rnd = random.Random(3)
    names = [f.name for f in REPORTS.fields]
    assert names == ["report_id", "TEXT_REPORT", "GROUND_TRUTH"]
    (tmp_path / "in").mkdir()
    want = []
    for part in range(2):
        rows = []
        for i in range(300):
            text = "".join(rnd.choice(["a", "b c", "\n", '"', '""', ",", "\r\n", "\n\n", "\u00e9", "x" * 40]) for _ in range(rnd.randrange(1, 30)))
            rows.append((1000 * part + i, "t" + text + ("\n" * 900 if i == 7 else "") + ".", rnd.choice([None, 1, 2])))
        want += rows
        with open(tmp_path / "in" / f"part-{part}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            w.writerow(names)
            w.writerows([("" if v is None else v) for v in r] for r in rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        df = scan_quoted_csv(spark, str(tmp_path / "in"), REPORTS)
        got = sorted(tuple(r) for r in df.collect())
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = spark.read.schema(REPORTS).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "in"))
    assert got == sorted(tuple(r) for r in whole.collect()) == sorted(want)


def test_a_term_is_searched_in_the_first_batch_that_has_it(spark, tmp_path):
    """The code map outlives a batch and a restart; a replayed batch rewrites its part; merged parts are read alone."""
    from kappaflow.sources.dictionaries import lexicon_df
    from kappaflow.streaming import grade_stream as G
    lex = lexicon_df(spark, FINDINGS, "finding")
    root = str(tmp_path / "codes")

    def batch(*terms):
        rows = [(i, ([(t, None, None, None, None)], [], [])) for i, t in enumerate(terms)]
        from pyspark.sql import types as T

        from kappaflow.schemas import EXTRACTION
        return spark.createDataFrame(rows, T.StructType([T.StructField("report_id", T.LongType()), T.StructField("payload", EXTRACTION)]))

    asked = []
    real = G.codes_of_terms
    G.codes_of_terms = lambda terms, *a, **k: (asked.append(sorted(r["term_raw"] for r in terms.collect())), real(terms, *a, **k))[1]
    try:
        def run(n, *terms):
            return {r["term_raw"]: r["term"] for r in G.update_code_map(batch(*terms), n, lex, root, compact=3).collect()}

        assert run(0, "mass", "nodul") == {"mass": "mass", "nodul": "nodule"}
        assert run(1, "mass", "nodul", "cysts") == {"mass": "mass", "nodul": "nodule", "cysts": "cyst"}
        assert run(1, "mass", "nodul", "cysts")["cysts"] == "cyst"  # replayed
        assert set(run(2, "cysts")) == {"mass", "nodul", "cysts"}
        assert set(run(3, "cysts", "goitr")) == {"mass", "nodul", "cysts", "goitr"}
        assert asked == [["mass", "nodul"], ["cysts"], ["cysts"], ["goitr"]]
        assert sorted(G.code_map_parts(spark, root)) == [0, 1, 2, 3] and G.code_map_parts(spark, root)[2].endswith("upto=2")
    finally:
        G.codes_of_terms = real


def test_only_touched_reports_are_graded_again(spark):
    from kappaflow.operators.lexicon_ops import grade_with, lexicon_version, regrade_changed, term_index
    m, a = A.mentions(spark, SF_SMALL), A.lexicon(spark, SF_SMALL)
    b = a.where("idx <> 5").withColumn("priority", F.when(F.col("idx") == 3, 6 - F.col("priority")).otherwise(F.col("priority")).cast("int"))
    graded = grade_with(m, a).checkpoint()
    want = sorted(tuple(r) for r in grade_with(m, b).collect())
    for index in (None, term_index(m)):
        got = regrade_changed(graded, m, a, b, index).collect()
        assert sorted(tuple(r)[:-1] for r in got) == want
        assert 0 < sum(r["regraded"] for r in got) < len(got) / 2
    assert not any(r["regraded"] for r in regrade_changed(graded, m, a, a).collect())
    assert lexicon_version(a) == lexicon_version(a.repartition(5)) != lexicon_version(b)
