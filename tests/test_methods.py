"""Model-call discipline: judge calls only where grades differ; the cache makes a rerun free."""

import json

from pyspark.sql import functions as F

from kappaflow.plans import methods as M
from kappaflow.plans.model import PandasModel, ReplayModel, RuleModel, cached_model_call


def counting_model(spark, answer):
    acc = spark.sparkContext.accumulator(0)

    def call(client, messages, method):
        acc.add(1)
        return answer(messages, method)

    return PandasModel(call), acc


def reports(spark):
    rows = [(1, "Lungs clear.", 0, 3, 3), (2, "Small effusion.", 1, 3, 4), (3, "Nodule.", 1, 2, 2),
            (4, "Pneumothorax.", 2, 5, 4), (5, "Lungs clear.", 0, 1, 1)]
    return spark.createDataFrame(rows, "report_id long, TEXT_REPORT string, priority_manual int, "
                                       "priority_algo int, priority_llm int")


def test_judge_calls_equal_disagreements(spark):
    model, acc = counting_model(spark, lambda m, meth: json.dumps({"grade": 4, "choice": 1, "explanation": "e"}))
    out = M.grade_judge(reports(spark), model, stage="t-judge").collect()
    inner = sum(1 for r in reports(spark).collect() if r["priority_algo"] != r["priority_llm"])
    outer = sum(1 for r in out if r["judge_choice_ext"] != 3)
    assert acc.value == inner + outer
    same = {r["report_id"]: r for r in out}
    assert same[1]["judge_choice"] == 3 and same[1]["judge_reasoning"] is None and same[1]["judge_grade"] == 3


def test_judge_keys_carry_no_text_through_joins(spark, monkeypatch):
    """The digest is taken where the reports are read; the keys of both steps are made without the texts."""
    from kappaflow.plans.q_lexicon import q_choice_label
    from kappaflow.plans.q_models import q_grade_judge
    seen, call = [], M.cached_model_call

    def watched(requests, *args, **kw):
        keys = requests.select("report_id", "method", "request_key")
        seen.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return call(requests, *args, **kw)

    monkeypatch.setattr(M, "cached_model_call", watched)
    for query in (q_grade_judge, q_choice_label):
        query(spark, "/root/testdata/sf0.001")
    assert len(seen) == 4
    for plan in seen:
        assert "TEXT_REPORT" not in plan.split("Join")[0] and "Join" in plan


def test_judge_results_with_and_without_a_digest(spark):
    answer = lambda m, meth: json.dumps({"grade": 1 + len(m[-1]["content"]) % 5, "choice": 1, "explanation": meth})
    rows = reports(spark).union(reports(spark).where("report_id = 2").selectExpr(
        "6L", "TEXT_REPORT", "priority_manual", "priority_algo", "priority_llm"))
    plain, acc = counting_model(spark, answer)
    first = sorted(map(str, M.grade_judge(rows, plain, stage="t-d0").collect()))
    digest, acc2 = counting_model(spark, answer)
    d = rows.withColumn(M.DIGEST, M.text_digest(F.col("TEXT_REPORT")))
    second = sorted(map(str, M.grade_judge(d, digest, stage="t-d1", digest_col=M.DIGEST).drop(M.DIGEST).collect()))
    assert first == second and acc.value == acc2.value


def test_failed_call_defaults(spark):
    def boom(m, meth):
        raise RuntimeError("down")
    model, _ = counting_model(spark, boom)
    r = M.grade_llm(reports(spark), model).collect()
    assert all(x["llm_grade"] == 0 and x["llm_status"] == "no_response" for x in r)
    h = M.grade_hybrid(reports(spark), model, *(spark.createDataFrame([(0, "nodule", 3)], "idx int, term string, priority int"),) * 2,
                       semialgo_col="priority_algo").collect()
    assert all(x["hybrid_grade"] == 0 and x["hybrid_explanation"] == "" for x in h)


def test_equal_prompts_are_sent_once_and_cache_makes_rerun_free(spark, tmp_path):
    model, acc = counting_model(spark, lambda m, meth: '{"grade": 2}')
    req = M.with_requests(reports(spark), "llm", {"rpt": F.col("TEXT_REPORT")}, "m")
    cache_path = str(tmp_path / "cache")
    out = cached_model_call(req, model, cache_path=cache_path).collect()
    assert len(out) == 5 and acc.value == 4  # two reports share one text
    cache = spark.read.parquet(cache_path)
    model2, acc2 = counting_model(spark, lambda m, meth: '{"grade": 2}')
    again = cached_model_call(req, model2, cache=cache).collect()
    assert acc2.value == 0 and all(r["cached"] for r in again) and len(again) == 5


def test_replay_and_rule_models(spark):
    req = M.with_requests(reports(spark), "llm", {"rpt": F.col("TEXT_REPORT")}, "m")
    rec = spark.createDataFrame([(1, "llm", '{"grade": 5}')], "report_id long, method string, payload string")
    r = {x["report_id"]: x["payload"] for x in cached_model_call(req, ReplayModel(rec)).collect()}
    assert r[1] == '{"grade": 5}' and r[2] is None
    g = {x["report_id"]: x["llm_grade"] for x in M.grade_llm(reports(spark), RuleModel()).collect()}
    assert g[4] == 5 and g[1] == 1


def lexicon(spark):
    return spark.createDataFrame([(0, "nodule", 3), (1, "tube", 2)], "idx int, term string, priority int")


def test_grade_stays_without_explanation_and_out_of_range_is_flagged(spark):
    answers = {1: '{"grade": 4}', 2: '{"grade": 6}', 3: '{"grade": 0, "explanation": "x"}', 4: '{"grade": 5, "explanation": "y"}'}
    rec = spark.createDataFrame([(i, "hybrid", p) for i, p in answers.items()], "report_id long, method string, payload string")
    rows = reports(spark).where("report_id < 5")
    out = {r["report_id"]: (r["hybrid_grade"], r["hybrid_explanation"], r["hybrid_status"])
           for r in M.grade_hybrid(rows, ReplayModel(rec), lexicon(spark), lexicon(spark), semialgo_col="priority_algo").collect()}
    assert out == {1: (4, "", "ok"), 2: (0, "", "out_of_range"), 3: (0, "", "out_of_range"), 4: (5, "y", "ok")}


def test_absent_lists_are_empty(spark):
    answers = [(1, '{"devices_all": [{"medical_device": "tube", "placement": "malpositioned"}]}'), (2, "{}"), (3, "no json")]
    rec = spark.createDataFrame([(i, "extract", p) for i, p in answers], "report_id long, method string, payload string")
    lx = lexicon(spark)
    out = {r["report_id"]: (r["overall_max_priority"], r["semialgo_status"])
           for r in M.grade_semialgo(reports(spark).where("report_id < 4"), ReplayModel(rec), lx, lx, lx).collect()}
    assert out == {1: (5, "ok"), 2: (1, "ok"), 3: (None, "no_json")}


def test_a_cache_that_holds_a_key_twice_answers_once(spark):
    req = M.with_requests(reports(spark), "llm", {"rpt": F.col("TEXT_REPORT")}, "m")
    cache = req.select("request_key", F.lit('{"grade": 2}').alias("payload"))
    model, acc = counting_model(spark, lambda m, meth: '{"grade": 2}')
    out = cached_model_call(req, model, cache=cache.union(cache)).collect()
    assert len(out) == 5 and acc.value == 0 and all(r["cached"] for r in out)


def test_rule_model_answers_hybrid_and_judge(spark):
    out = {r["report_id"]: r["hybrid_status"] for r in M.grade_hybrid(
        reports(spark), RuleModel(), lexicon(spark), lexicon(spark), semialgo_col="priority_algo").collect()}
    assert set(out.values()) == {"ok"}


def test_a_run_is_resumed_after_its_last_stage(spark):
    """The second start reads the completed stages; no call is made again; clearing the run starts over."""
    import uuid
    from kappaflow.plans.model import clear_run
    answers = {"extract": '{"findings_all": []}', "hybrid": '{"grade": 3, "explanation": "h"}', "llm": '{"grade": 2}',
               "judge": '{"grade": 4, "choice": 1, "explanation": "j"}', "judge_ext": '{"grade": 4, "choice": 1, "explanation": "k"}'}
    run, lx = f"run-{uuid.uuid4().hex[:8]}", lexicon(spark)
    rows = reports(spark).select("report_id", "TEXT_REPORT", F.col("priority_manual").alias("GROUND_TRUTH"))
    failing = {"on": True}

    def answer(m, meth):
        if meth == "llm" and failing["on"]:
            raise SystemError("lost")
        return answers[meth]

    model, acc = counting_model(spark, answer)
    first = M.grade_all_methods(rows, model, lx, lx, lx, run=run).collect()
    calls = acc.value
    failing["on"] = False
    again, acc2 = counting_model(spark, answer)
    second = M.grade_all_methods(rows, again, lx, lx, lx, run=run).collect()
    assert calls > 0 and acc2.value == 0 and sorted(map(str, first)) == sorted(map(str, second))
    assert clear_run(spark, run) and not clear_run(spark, run)
    fresh, acc3 = counting_model(spark, answer)
    third = M.grade_all_methods(rows, fresh, lx, lx, lx, run=run).collect()
    assert acc3.value > 0 and {r["priority_llm"] for r in third} == {2}


def test_report_ids_must_be_unique(spark):
    import pytest
    model, _ = counting_model(spark, lambda m, meth: "{}")
    lx = lexicon(spark)
    with pytest.raises(ValueError, match="report_id 1 occurs 2 times"):
        M.grade_all_methods(reports(spark).union(reports(spark).where("report_id = 1")), model, lx, lx, lx)


def test_timed_stage(spark):
    from kappaflow.plans.model import timed_stage
    df = spark.createDataFrame([(1, "ok"), (2, "malformed"), (3, "ok")], "report_id long, status string")
    out, stats = timed_stage(df, "t-timed", "status")
    assert out.count() == 3 and (stats["rows"], stats["failures"]) == (3, 1) and stats["seconds_per_row"] > 0


def test_values_that_look_like_holes_stay(spark):
    from kappaflow.functions.text import fill_template
    out = spark.range(1).select(fill_template("a ${x} ${rpt} ${no}", {"x": F.lit("${rpt}"), "rpt": F.lit("r ${x}")}).alias("t"))
    assert out.first()["t"] == "a ${rpt} r ${x} ${no}"


def _requests(spark, n, text="q"):
    from pyspark.sql import functions as F
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(text), F.col("id").cast("string")).alias("content")))
    return spark.range(n).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("request_key"), F.lit("llm").alias("method"), msgs.alias("messages"))


def test_calls_in_flight_rate_and_log(spark, tmp_path):
    """Many small tasks, at most five calls at once, a rate for all tasks together; a second start sends nothing again."""
    import time

    from kappaflow.plans.model import PandasModel, read_answers
    folder = str(tmp_path)

    def call(client, messages, method):
        began = time.time()
        time.sleep(0.02)
        with open(f"{folder}/calls-{time.time_ns()}-{messages[0]['content']}", "w") as f:
            f.write(f"{began} {time.time()}")
        if messages[0]["content"] == "q7":
            raise ValueError("not now")
        return messages[0]["content"].upper()

    model = PandasModel(call, partitions=5, calls_per_task=4)
    req = _requests(spark, 100).union(_requests(spark, 3))  # three of them twice
    log = f"{folder}/log"
    got = {r["request_key"]: (r["payload"], r["error"]) for r in model.answer(req, log=log).collect()}
    assert got == {f"q{i}": (f"Q{i}", None) if i != 7 else (None, "ValueError: not now") for i in range(100)}
    times = [tuple(map(float, p.read_text().split())) for p in tmp_path.glob("calls-*")]
    assert len(times) == 100
    assert max(sum(a <= t < b for a, b in times) for t, _ in times) <= 5
    assert len(read_answers(spark, f"{log}/answers").inputFiles()) >= 20  # tasks, each with a few calls
    assert model.answer(req.where("request_key <> 'q7'"), log=log).count() == 99
    assert len(list(tmp_path.glob("calls-*"))) == 100  # nothing was sent again
    model.answer(req, log=log).collect()
    assert len(list(tmp_path.glob("calls-*"))) == 101  # the failed one was
    began = time.time()
    assert PandasModel(call, partitions=4, calls_per_task=50, per_second=40.0).answer(_requests(spark, 60, "r")).count() == 60
    assert time.time() - began > 60 / 40 * 0.6
    assert model.answer(req.limit(0)).count() == 0


def test_quick_calls_go_out_in_growing_waves(spark, tmp_path, monkeypatch):
    """Every request is sent once; the waves do not grow in number with the requests, unless the calls take their time."""
    from kappaflow.plans import model as m
    req, files = _requests(spark, 2000), {}
    for name, seconds in (("quick", 1000.0), ("slow", 0.0)):
        monkeypatch.setattr(m, "WAVE_SECONDS", seconds)
        acc = spark.sparkContext.accumulator(0)

        def call(client, messages, method):
            acc.add(1)
            return messages[0]["content"]

        got = {r["request_key"]: r["payload"] for r in PandasModel(call).answer(req, log=f"{tmp_path}/{name}").collect()}
        assert got == {f"q{i}": f"q{i}" for i in range(2000)} and acc.value == 2000
        files[name] = len(m.read_answers(spark, f"{tmp_path}/{name}/answers").inputFiles())
    assert files["quick"] <= 4 * 5 and files["slow"] >= 8 * 5  # tasks: 250 + 500 + 1000 + 2000 calls, and 250 each


def test_a_killed_task_repeats_its_open_calls_only(spark, tmp_path):
    """A wave that dies leaves the waves before it answered."""
    import os
    import time

    import pytest

    from kappaflow.plans.model import PandasModel
    folder = str(tmp_path)

    def call(client, messages, method):
        with open(f"{folder}/calls-{time.time_ns()}-{messages[0]['content']}", "w"):
            pass
        if messages[0]["content"] == "q33" and not os.path.exists(f"{folder}/again"):
            open(f"{folder}/again", "w").close()
            os._exit(1)  # the worker is gone
        return "ok"

    model, log = PandasModel(call, partitions=2, calls_per_task=5), f"{folder}/log"
    try:
        model.answer(_requests(spark, 80), log=log).count()
    except Exception:  # noqa: BLE001  local mode does not retry tasks
        pass
    assert model.answer(_requests(spark, 80), log=log).where("payload = 'ok'").count() == 80
    sent = len(list(tmp_path.glob("calls-*")))
    assert 80 < sent <= 80 + 2 * 2 * 10  # of one wave, which holds about ten calls


def test_stages_know_their_input(spark):
    from pyspark.sql import functions as F

    from kappaflow.plans.model import clear_old_stages, clear_run, stage_table, table_version
    from kappaflow.session import stage_root
    a = spark.range(10).withColumn("x", F.col("id") % 3)
    version = table_version(a, model="m")
    assert version == table_version(a.repartition(4).orderBy(F.desc("id")), model="m")
    assert len({version, table_version(a, model="n"), table_version(a.where("id < 9"), model="m"), table_version(a.union(a), model="m")}) == 4
    assert stage_table(a, "t-run/s", version=version).count() == 10
    assert stage_table(a.where("id < 5"), "t-run/s", version=version).count() == 10  # the same version is read
    assert stage_table(a.where("id < 5"), "t-run/s", version="other").count() == 5
    assert stage_table(a, "t-run/s", version=version).count() == 10
    root = f"{stage_root(spark)}/t-old"
    assert clear_old_stages(spark, 0, root) == []
    stage_table(a, "r/s", folder=root)
    assert clear_old_stages(spark, 3600, root) == [] and clear_old_stages(spark, -5, root) == ["r"]
    assert clear_run(spark, "t-run")


def test_large_dictionaries_give_candidate_terms(spark):
    """No failure above the listed size: each report's prompt holds the terms that share most with it."""
    from pyspark.sql import functions as F

    from kappaflow.plans.methods import candidate_terms, with_term_lists
    lex = spark.range(150_000).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("site "), F.col("id").cast("string"), F.lit(" lesions")).alias("term"),
                                      F.lit(3).alias("priority"))
    reports = spark.createDataFrame([(1, "A lesion at Site 149999 and site 7."), (2, "Nothing known."), (3, None)], "report_id long, TEXT_REPORT string")
    got = {r["report_id"]: r["_t"] for r in with_term_lists(reports, {"_t": lex}, k=2).collect()}
    assert got == {1: "site 7 lesions, site 149999 lesions", 2: "", 3: ""}
    small = lex.limit(3)
    assert {r["_t"] for r in with_term_lists(reports, {"_t": small}).collect()} == {"site 0 lesions, site 1 lesions, site 2 lesions"}
    plan = with_term_lists(reports, {"_t": lex}, k=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" not in plan
    assert [r["terms"] for r in candidate_terms(reports, small, 1).collect()] == ["site 0 lesions"]


def test_cache_generations_merge_to_one_row_a_key(spark, tmp_path):
    from kappaflow.plans.model import append_cache, compact_cache, read_cache
    path = str(tmp_path / "cache")
    rows = lambda *keys: spark.createDataFrame([(k, None if k == "none" else f"p-{k}") for k in keys], "request_key string, payload string")
    assert read_cache(spark, path).count() == 0 and compact_cache(spark, path) == 0
    append_cache(rows("a", "b", "none"), path)
    append_cache(rows("b", "c"), path)
    assert sorted(r["request_key"] for r in read_cache(spark, path).collect()) == ["a", "b", "b", "c"]
    assert compact_cache(spark, path, drop=False) == 2  # the old generations are still there, and not read
    assert sorted(tuple(r) for r in read_cache(spark, path).collect()) == [("a", "p-a"), ("b", "p-b"), ("c", "p-c")]
    append_cache(rows("d"), path)
    assert compact_cache(spark, path) == 2
    assert sorted(r["request_key"] for r in read_cache(spark, path).collect()) == ["a", "b", "c", "d"]
