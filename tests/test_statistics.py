"""Statistics against direct computation (McNemar, Bonferroni, Wilcoxon, kappa, AUC)."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kappaflow.operators import agreement as G
from kappaflow.operators import significance as S


def crosstab(spark, b, c):
    return spark.createDataFrame([(0, 0, 5), (0, 1, b), (1, 0, c), (1, 1, 7)], "a_correct int, b_correct int, n long")


def test_mcnemar_exact(spark):
    r = G.mcnemar_exact(crosstab(spark, 9, 24)).collect()[0]
    assert r["statistic"] == 9 and abs(r["p_value"] - 0.0135309868) < 1e-9 and r["significant"]
    r0 = G.mcnemar_exact(crosstab(spark, 0, 0)).collect()[0]
    assert r0["statistic"] == 0 and r0["p_value"] == 1.0


def test_mcnemar_large_counts_match_exact_sum(spark):
    # exact big-integer tail where that is cheap; full log-space sum beyond it
    b, c = 300, 362
    n, m = b + c, min(b, c)
    exact = min(1.0, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2 ** n)
    r = G.mcnemar_exact(crosstab(spark, b, c)).collect()[0]
    assert abs(r["p_value"] - exact) < 1e-9
    b, c = 40000, 40500
    n, m = b + c, min(b, c)
    lt = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(m + 1)]
    top = max(lt)
    full = min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in lt))
    r = G.mcnemar_exact(crosstab(spark, b, c)).collect()[0]
    assert abs(r["p_value"] - full) < 1e-8


def test_bonferroni(spark):
    t = spark.createDataFrame([("m", f"c{i}", i, i + 1, p, "tested") for i, p in enumerate([0.02, 0.4, 0.6])],
                              "method string, comparison string, it_a int, it_b int, p_value double, status string")
    got = sorted((r["raw_p_value"], r["corrected_p_value"], r["significant"]) for r in S.bonferroni(t).collect())
    assert [g[1] for g in got] == [0.06, 1.0, 1.0] and not any(g[2] for g in got)


def wilcoxon_direct(x, y):
    d = [a - b for a, b in zip(x, y) if a - b != 0]
    n = len(d)
    if n == 0:
        return 0.0, None
    ad = sorted(abs(v) for v in d)
    ranks = {}
    i = 0
    while i < n:
        j = i
        while j < n and ad[j] == ad[i]:
            j += 1
        ranks[ad[i]] = (i + 1 + j) / 2.0
        i = j
    rp = sum(ranks[abs(v)] for v in d if v > 0)
    rm = sum(ranks[abs(v)] for v in d if v < 0)
    w = min(rp, rm)
    ties = sum(t ** 3 - t for t in [ad.count(v) for v in set(ad)])
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    z = (w - n * (n + 1) / 4.0) / math.sqrt(var)
    return w, math.erfc(abs(z) / math.sqrt(2))


def test_wilcoxon_against_direct(spark):
    rnd = random.Random(7)
    rows = []
    for rid in range(60):
        base = rnd.randint(1, 5)
        for it in (1, 2, 3):
            g = None if rnd.random() < 0.1 else max(1, min(5, base + rnd.choice([-1, 0, 0, 0, 1])))
            rows.append((rid, it, g))
    df = spark.createDataFrame(rows, "report_id long, it int, g int")
    got = {(r["it_a"], r["it_b"]): r for r in S.wilcoxon_pairs(df, ["g"]).collect()}
    by = {}
    for rid, it, g in rows:
        by.setdefault(rid, {})[it] = g
    for a, b in itertools.combinations([1, 2, 3], 2):
        pairs = [(v[a], v[b]) for v in by.values() if v.get(a) is not None and v.get(b) is not None]
        w, p = wilcoxon_direct([x for x, _ in pairs], [y for _, y in pairs])
        r = got[(a, b)]
        assert r["n_common"] == len(pairs) and abs(r["statistic"] - w) < 1e-6
        assert abs(r["p_value"] - p) < 2e-6


def test_wilcoxon_few_rows_insufficient(spark):
    rows = [(i, it, i % 3 + it) for i in range(5) for it in (1, 2)]
    r = S.wilcoxon_pairs(spark.createDataFrame(rows, "report_id long, it int, g int"), ["g"]).collect()[0]
    assert r["status"] == "insufficient" and r["p_value"] is None


def kappa_direct(y1, y2, quadratic=False):
    labels = sorted(set(y1) | set(y2))
    pos = {l: i for i, l in enumerate(labels)}
    n = len(y1)
    o = {}
    for a, b in zip(y1, y2):
        o[(a, b)] = o.get((a, b), 0) + 1
    r = {l: sum(1 for a in y1 if a == l) for l in labels}
    c = {l: sum(1 for b in y2 if b == l) for l in labels}
    w = (lambda i, j: (pos[i] - pos[j]) ** 2) if quadratic else (lambda i, j: 0 if i == j else 1)
    num = sum(w(i, j) * o.get((i, j), 0) for i in labels for j in labels)
    den = sum(w(i, j) * r[i] * c[j] / n for i in labels for j in labels)
    return 1 - num / den


def test_kappa_against_direct(spark):
    rnd = random.Random(3)
    y1 = [rnd.choice([0, 1, 2]) for _ in range(300)]
    y2 = [v if rnd.random() < 0.7 else rnd.choice([0, 2]) for v in y1]
    conf = G.confusion(spark.createDataFrame([("m", a, b) for a, b in zip(y1, y2)], "method string, truth int, pred int"))
    k = G.cohen_kappa(conf).collect()[0]
    assert abs(k["cohen_kappa"] - round(kappa_direct(y1, y2), 6)) < 2e-6
    assert abs(k["cohen_kappa_quadratic"] - round(kappa_direct(y1, y2, True), 6)) < 2e-6


def test_auc_by_rank_against_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 40))) for _ in range(400)]
    pos = [s for t, s in rows if t == 1]
    neg = [s for t, s in rows if t == 0]
    brute = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    r = G.roc_auc_scores(spark.createDataFrame(rows, "truth int, score double")).collect()[0]
    assert abs(r["roc_auc"] - round(brute, 6)) < 2e-6


def test_auc_binary_equals_sens_spec_mean(spark):
    rows = [(1, 1.0)] * 30 + [(1, 0.0)] * 10 + [(0, 0.0)] * 45 + [(0, 1.0)] * 15
    r = G.roc_auc_scores(spark.createDataFrame(rows, "truth int, score double")).collect()[0]
    assert abs(r["roc_auc"] - (30 / 40 + 45 / 60) / 2) < 1e-6


def test_confusion_cells_sum_to_rows(spark):
    from conftest import SF_SMALL
    from kappaflow.sources import adapters as A
    g = A.graded(spark, SF_SMALL)
    n = g.count()
    conf = G.confusion_fixed(G.confusion(G.methods_long(g)), [0, 1, 2])
    sums = {r["method"]: r["s"] for r in conf.groupBy("method").agg(F.sum("n").alias("s")).collect()}
    assert all(v == n for v in sums.values()) and len(sums) == 4


def test_every_run_of_the_data_counts(spark):
    """Twelve runs in, twelve runs out; no parameter names them."""
    df = spark.createDataFrame([(i, it, i % 5 + 1) for i in range(20) for it in range(1, 13)], "report_id long, it int, g int")
    assert sum(r["n"] for r in S.grade_counts_by_iteration(df, ["g"]).collect()) == 240
    assert len(S.join_iterations(df, ["g"]).columns) == 13
    assert S.iteration_pairs(df, ["g"]).count() == 66


def test_a_report_graded_twice_in_a_run_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 1, 5), (1, 2, 3)], "report_id long, it int, g int")
    for out in (S.join_iterations(df, ["g"]), S.wilcoxon_pairs(df, ["g"])):
        with pytest.raises(Exception, match="graded more than once"):
            out.collect()


def test_bonferroni_multiplies_the_unrounded_value(spark):
    t = spark.createDataFrame([("m", f"c{i}", i, i + 1, p, "tested") for i, p in enumerate([0.00000049, 0.4])],
                              "method string, comparison string, it_a int, it_b int, p_value double, status string")
    assert min(r["corrected_p_value"] for r in S.bonferroni(t).collect()) == pytest.approx(0.00000098)


def test_auc_leaves_out_rows_without_score_and_spreads_a_skewed_one(spark):
    rnd = random.Random(2)
    rows = [(int(rnd.random() < 0.4), 2.0 ** rnd.randint(0, 60) if rnd.random() < 0.9 else None) for _ in range(500)] + [(None, 3.0)]
    pos = [s for t, s in rows if t == 1 and s is not None]
    neg = [s for t, s in rows if t == 0 and s is not None]
    brute = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    r = G.roc_auc_scores(spark.createDataFrame(rows, "truth int, score double")).collect()[0]
    assert r["roc_auc"] == pytest.approx(brute) and r["n_unranked"] == 501 - len(pos) - len(neg)
    by = G.roc_auc_scores(spark.createDataFrame([(i % 2, *x) for i, x in enumerate(rows)], "g int, truth int, score double"), by=["g"]).collect()
    for r in by:
        own = [x for i, x in enumerate(rows) if i % 2 == r["g"] and None not in x]
        pos, neg = [s for t, s in own if t == 1], [s for t, s in own if t == 0]
        assert r["roc_auc"] == pytest.approx(sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg)))
