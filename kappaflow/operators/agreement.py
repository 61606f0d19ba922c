"""Agreement between graders.

Plan: one ``unpivot`` of the method columns to (report_id, truth, method,
grade), one grouped count to the confusion cells (method, truth, pred, n)
-- partial aggregation makes this a few hundred bytes per map task -- and
every metric is arithmetic on that tiny table.  No metric rescans the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouping import binary_group, correct, group_threshold, merge_two_into_one
from ..schemas import METHOD_COLUMNS

def _nan() -> Column:
    return F.lit(float("nan"))


def _div(num: Column, den: Column, empty: Column | None = None) -> Column:
    """num / den as double; ``empty`` (NaN by default) when den is 0 (ANSI mode would raise)."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(_nan() if empty is None else empty)


def methods_long(graded: DataFrame, *, truth_col: str = "priority_manual",
                 methods: dict[str, str] | None = None, grouped: bool = True) -> DataFrame:
    """U4: stack the method columns -> (report_id, truth, method, grade, pred).

    ``pred`` is the threshold grouping of the grade (Q9) when ``grouped``.
    """
    methods = methods or METHOD_COLUMNS
    base = graded.select("report_id", F.col(truth_col).alias("truth"),
                         *[F.col(c).alias(m) for m, c in methods.items()])
    long = base.unpivot(["report_id", "truth"], list(methods), "method", "grade")
    return long.withColumn("pred", group_threshold("grade") if grouped else F.col("grade"))


def confusion(long: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(method, truth, pred, n): the one aggregate everything else reads.

    The result has at most methods x labels^2 rows.  Branches of one query that
    read it share its exchange at run time.
    """
    return long.groupBy("method", F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def label_grid(conf: DataFrame, labels: list[int]) -> DataFrame:
    """(method, truth, pred) for every pair of fixed labels, per method present."""
    arr = F.array(*[F.lit(x) for x in labels])
    return (conf.select("method").distinct()
            .withColumn("truth", F.explode(arr)).withColumn("pred", F.explode(arr)))


def confusion_fixed(conf: DataFrame, labels: list[int]) -> DataFrame:
    """Counts on a fixed label grid, absent cells 0, other labels dropped."""
    return (label_grid(conf, labels).join(conf, ["method", "truth", "pred"], "left")
            .select("method", "truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_binary(long: DataFrame) -> DataFrame:
    """Confusion after merging grouped class 2 into 1, labels 0..1."""
    b = long.withColumn("truth", merge_two_into_one("truth")).withColumn("pred", merge_two_into_one("pred"))
    return confusion_fixed(confusion(b), [0, 1])


def exact_agreement(conf: DataFrame) -> DataFrame:
    """A5 (Q11): share of equal grades x100; a missing side counts as unequal."""
    return conf.groupBy("method").agg(
        _div(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) * 100.0,
                     F.sum("n")).alias("exact_agreement_pct"),
        F.sum("n").alias("n"))


def method_cells(conf: DataFrame) -> DataFrame:
    """One row per method holding its confusion cells (at most labels^2 of them).

    The label domain of a grade is small, so the list is bounded; every
    kappa term is then row-local arithmetic on it (no joins, no windows).
    """
    return conf.where(F.col("truth").isNotNull()).groupBy("method").agg(
        F.collect_list(F.struct("truth", "pred", "n")).alias("cells"))


def _sum(arr, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))


def cohen_kappa(conf: DataFrame) -> DataFrame:
    """A8 + A9: plain and quadratic-weighted kappa per method.

    Weights use label *positions* in the sorted union of labels (as the
    usual library does), and E = outer(r, c) / N.  A zero denominator gives
    NaN.  Computed from each method's cell list in one projection.
    """
    cells = F.col("cells")
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(cells, lambda c: c["truth"]),
                                                     F.transform(cells, lambda c: c["pred"]))))

    def pos(v):
        return (F.array_position(F.col("labels"), v) - 1).cast("double")

    def row(l):
        return _sum(F.filter(cells, lambda c: c["truth"] == l), lambda c: c["n"])

    def col(l):
        return _sum(F.filter(cells, lambda c: c["pred"] == l), lambda c: c["n"])

    m = method_cells(conf).withColumn("labels", labels)
    lab = F.col("labels")
    N = _sum(cells, lambda c: c["n"])
    tr = _sum(F.filter(cells, lambda c: c["truth"] == c["pred"]), lambda c: c["n"])
    rc = _sum(lab, lambda l: row(l) * col(l))
    wo = _sum(cells, lambda c: c["n"] * (pos(c["truth"]) - pos(c["pred"])) ** 2)
    r2 = _sum(lab, lambda l: row(l) * pos(l) ** 2)
    c2 = _sum(lab, lambda l: col(l) * pos(l) ** 2)
    r1 = _sum(lab, lambda l: row(l) * pos(l))
    c1 = _sum(lab, lambda l: col(l) * pos(l))
    k = m.select("method", N.alias("N"), tr.alias("tr"), rc.alias("rc"), wo.alias("wo"), r2.alias("r2"),
                 c2.alias("c2"), r1.alias("r1"), c1.alias("c1"))
    Nn = F.col("N")
    off_obs = Nn - F.col("tr")
    off_exp = Nn - _div(F.col("rc"), Nn, F.lit(0.0))
    w_exp = F.col("r2") + F.col("c2") - _div(2.0 * F.col("r1") * F.col("c1"), Nn, F.lit(0.0))
    return k.select(
        "method",
        (F.when(off_exp != 0, 1.0 - off_obs / off_exp).otherwise(_nan())).alias("cohen_kappa"),
        (F.when(w_exp != 0, 1.0 - F.col("wo") / w_exp).otherwise(_nan())).alias("cohen_kappa_quadratic"))


def binary_counts(conf: DataFrame) -> DataFrame:
    """tp / fp / fn / tn per method for normal (0) vs abnormal (1, 2)."""
    t, p, n = binary_group("truth"), binary_group("pred"), F.col("n")
    return conf.groupBy("method").agg(
        F.sum(F.when((t == 1) & (p == 1), n).otherwise(0)).alias("tp"),
        F.sum(F.when((t == 0) & (p == 1), n).otherwise(0)).alias("fp"),
        F.sum(F.when((t == 1) & (p == 0), n).otherwise(0)).alias("fn"),
        F.sum(F.when((t == 0) & (p == 0), n).otherwise(0)).alias("tn"))


def binary_metrics(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A10-A15 from tp/fp/fn/tn; zero division -> 0, AUC of one class -> NaN."""
    keys = keys or ["method"]
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    sens = _div(tp, tp + fn, zero)
    spec = _div(tn, tn + fp, zero)
    one_class = ((tp + fn) == 0) | ((tn + fp) == 0)
    return counts.select(
        *keys,
        _div(tp, tp + fp, zero).alias("precision"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        _div(tn, tn + fn, zero).alias("npv"),
        _div(2 * tp, 2 * tp + fp + fn, zero).alias("f1"),
        F.when(one_class, _nan()).otherwise((sens + spec) / 2.0).alias("roc_auc"))


def score_quality(conf: DataFrame) -> DataFrame:
    """M7: one long table (method, metric, value) from the single confusion aggregate."""
    t, p, n = binary_group("truth"), binary_group("pred"), F.col("n")
    agg = conf.groupBy("method").agg(
        _div(F.sum(F.when(F.col("truth") == F.col("pred"), n).otherwise(0)), F.sum(n))
        .alias("exact_agreement"),
        F.sum(F.when((t == 1) & (p == 1), n).otherwise(0)).alias("tp"),
        F.sum(F.when((t == 0) & (p == 1), n).otherwise(0)).alias("fp"),
        F.sum(F.when((t == 1) & (p == 0), n).otherwise(0)).alias("fn"),
        F.sum(F.when((t == 0) & (p == 0), n).otherwise(0)).alias("tn"))
    wide = binary_metrics(agg, ["method", "exact_agreement"]).join(cohen_kappa(conf), "method")
    metrics = ["exact_agreement", "cohen_kappa", "cohen_kappa_quadratic", "precision", "sensitivity",
               "specificity", "npv", "f1", "roc_auc"]
    return wide.unpivot(["method"], metrics, "metric", "value")


def per_class_metrics(conf: DataFrame, labels=(0, 1, 2)) -> DataFrame:
    """One-vs-rest metrics per (method, class) from the confusion cells.

    tp = n(c,c), fn = row(c) - tp, fp = col(c) - tp, tn = N - tp - fn - fp;
    the class list is generated per method row (explode), not joined.
    """
    cells = conf.withColumn("class", F.explode(F.array(*[F.lit(x) for x in labels])))
    t = F.coalesce(F.col("truth") == F.col("class"), F.lit(False))
    p = F.coalesce(F.col("pred") == F.col("class"), F.lit(False))
    n = F.col("n")
    cnt = cells.groupBy("method", "class").agg(
        F.sum(F.when(t & p, n).otherwise(0)).alias("tp"),
        F.sum(F.when(~t & p, n).otherwise(0)).alias("fp"),
        F.sum(F.when(t & ~p, n).otherwise(0)).alias("fn"),
        F.sum(F.when(~t & ~p, n).otherwise(0)).alias("tn"))
    return (binary_metrics(cnt, ["method", "class"])
            .select("method", F.col("class").cast("int").alias("class"), "sensitivity", "specificity",
                    F.col("precision").alias("ppv"), "npv", "f1", "roc_auc"))


def macro_average(per_class: DataFrame) -> DataFrame:
    """Mean over classes per method and metric; NaN spreads (not NULL)."""
    metrics = ["sensitivity", "specificity", "ppv", "npv", "f1", "roc_auc"]
    long = per_class.unpivot(["method", "class"], metrics, "metric", "value")
    return long.groupBy("method", "metric").agg(F.avg("value").alias("value"))


def correctness_flags(graded: DataFrame, a: str = "priority_hybrid", b: str = "judge_grade",
                      truth_col: str = "priority_manual") -> DataFrame:
    """K8 on the binary scale: 1 where the method agrees with the truth."""
    tb = binary_group(truth_col)
    return graded.select(
        "report_id",
        correct(binary_group(group_threshold(a)), tb).alias("a_correct"),
        correct(binary_group(group_threshold(b)), tb).alias("b_correct"))


def correctness_crosstab(flags: DataFrame) -> DataFrame:
    """2x2 of correct / incorrect, all four cells present (missing -> 0)."""
    obs = flags.groupBy("a_correct", "b_correct").agg(F.count(F.lit(1)).alias("n"))
    grid = (flags.sparkSession.range(1).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("a_correct"))
            .withColumn("b_correct", F.explode(F.array(F.lit(0), F.lit(1)))))
    return (grid.join(obs, ["a_correct", "b_correct"], "left")
            .select("a_correct", "b_correct", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def binomial_half_tail(n: Column, m: Column) -> Column:
    """P[Bin(n, 1/2) <= m] for 0 <= m <= n / 2, as a regularised incomplete beta function.

    I_{1/2}(n - m, m + 1) by its continued fraction (modified Lentz steps); it
    settles after a number of steps of the order of sqrt(n), and is given twenty
    times that.  Nothing is left out, whatever the counts.
    """
    from ..functions.stats import ln_choose

    a, b, x = (n - m).cast("double"), (m + 1).cast("double"), F.lit(0.5)
    steps = (F.lit(20.0) * F.sqrt(n.cast("double")) + 200).cast("int")
    d0 = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(acc, coefficient):
        d = 1 / (1 + coefficient * acc["d"])
        c = 1 + coefficient / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    def step(acc, i):
        even = i * (b - i) * x / ((a - 1 + 2 * i) * (a + 2 * i))
        odd = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 1 + 2 * i))
        return half(half(acc, even), odd)

    fraction = F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda i: i.cast("double")), start, step,
                           lambda acc: acc["h"])
    scale = F.exp(ln_choose(n, m) - (n.cast("double") + 1) * F.lit(0.6931471805599453))
    return F.when(n == 0, F.lit(1.0)).otherwise(scale * fraction)


def mcnemar_exact(crosstab: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Exact McNemar test on the discordant cells.

    statistic = min(b, c); p = min(1, 2 * P[Bin(b + c, 1/2) <= min]), in closed
    form on the single result row.
    """
    d = crosstab.agg(
        F.sum(F.when((F.col("a_correct") == 0) & (F.col("b_correct") == 1), F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when((F.col("a_correct") == 1) & (F.col("b_correct") == 0), F.col("n")).otherwise(0)).alias("c"))
    stat = F.least("b", "c")
    p = F.least(F.lit(1.0), 2.0 * binomial_half_tail(F.col("b") + F.col("c"), stat))
    return d.select(F.col("b").alias("n_a_wrong_b_right"), F.col("c").alias("n_a_right_b_wrong"),
                    stat.cast("double").alias("statistic"), p.alias("p_value")).withColumn("significant", F.col("p_value") < alpha)


def accuracy_difference(flags: DataFrame) -> DataFrame:
    """Mean correctness of both methods and their difference."""
    return flags.agg(
        F.avg(F.col("a_correct").cast("double")).alias("accuracy_a"),
        F.avg(F.col("b_correct").cast("double")).alias("accuracy_b"),
        (F.avg(F.col("a_correct").cast("double")) - F.avg(F.col("b_correct").cast("double")))
        .alias("accuracy_diff"))


def undergrading_rate(long: DataFrame) -> DataFrame:
    """Truth >= 1 graded 0, per method; percent NULL when no abnormal case."""
    ab = F.col("truth") >= 1
    g = long.groupBy("method").agg(
        F.count(F.when(ab & (F.col("pred") == 0), 1)).alias("undergraded"),
        F.count(F.when(ab, 1)).alias("abnormal"))
    return g.withColumn("undergraded_pct", F.when(
        F.col("abnormal") > 0, F.col("undergraded") * 100.0 / F.col("abnormal")))


def roc_auc_scores(df: DataFrame, truth: str = "truth", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """A15 general form: AUC of a continuous score by rank sums, ties averaged.

    1. histogram (by, score) -> pos, neg              (partial agg; rows -> distinct scores)
    2. dealt out by ranges of (by, score) that Spark samples, so a skewed score
       spreads over all tasks, and written once to the checkpoint folder
    3. negatives below each range from one total per range
    4. window ordered by score inside a range         (never one global window)
    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N); one class -> NaN.
    Rows without truth or score have no rank and are counted in ``n_unranked``.
    """
    from ..session import ensure_checkpoint_dir

    by = by or []
    ensure_checkpoint_dir(df.sparkSession)
    y, s = F.col(truth), F.col(score).cast("double")
    ranked = y.isNotNull() & s.isNotNull() & ~F.isnan(s)
    h = (df.groupBy(*by, F.when(ranked, s).alias("s")).agg(
        F.count(F.when(ranked & (y == 1), 1)).alias("pos"), F.count(F.when(ranked & (y != 1), 1)).alias("neg"),
        F.count(F.when(~ranked, 1)).alias("out"))
        .repartitionByRange(*by, "s").withColumn("part", F.spark_partition_id()).checkpoint())
    parts = h.groupBy(*by, "part").agg(F.sum("neg").alias("n"))  # a row per range
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("neg_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("part").alias("_part"), "neg_before")
    on = h["part"] == same["_part"]
    for c in by:
        on = on & h[c].eqNullSafe(same[f"_{c}"])
    inside = Window.partitionBy(*by, "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(same, on).withColumn("below", F.col("neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    g = h.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum("out").alias("n_unranked"))
    den = F.col("P") * F.col("N")
    return g.select(*by, "P", "N", "n_unranked", F.when(den > 0, F.col("u") / den).otherwise(_nan()).alias("roc_auc"))
