"""Repeated-run consistency: pairwise signed-rank tests.

Plan (one method column or several):

    long (report_id, it, method, grade)
      -> grouped by (report_id, method): the list of its runs   (one shuffle)
      -> reports with equal lists counted together (partial counts first)
      -> the run pairs of a list, exploded and counted by (method, pair, x - y)
         in the same stage: partial counts leave k(k-1)/2 times a few
         differences per task, whatever the number of reports
      -> average ranks by a window over the few |d| of one pair
The runs are those in the data: none is left out.  A report graded twice in
one run is an error.  The test is the tie-corrected normal form without
continuity correction: W = min(R+, R-), z = (W - n(n+1)/4) / sqrt(n(n+1)(2n+1)/24 -
sum(t^3 - t)/48), p = erfc(|z| / sqrt 2).  Zeros are dropped; n = 0 gives W = 0 and
p NULL.  A pair needs more than ``min_rows`` complete rows, else status
'insufficient'.  No value is rounded here; queries round for display.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouping import group_membership
from ..functions.stats import erfc


def runs_long(it_long: DataFrame, methods: list[str]) -> DataFrame:
    """(report_id, it, method, grade) from one column per method."""
    return it_long.select("report_id", "it", *methods).unpivot(["report_id", "it"], methods, "method", "grade")


def _once(n, what: str):
    """``what`` if it was seen at most once, else an error naming the report."""
    return F.when(n <= 1, what).otherwise(F.raise_error(F.concat(
        F.lit("graded more than once in one run: report "), F.col("report_id").cast("string"))))


def run_numbers(it_long: DataFrame) -> list[int]:
    """The runs in the data; one row per run reaches the driver."""
    return sorted(r["it"] for r in it_long.select("it").where(F.col("it").isNotNull()).distinct().collect())


def join_iterations(it_long: DataFrame, methods: list[str]) -> DataFrame:
    """One row per report, one column per method and run (``<method>_<it>``), for every run in the data.

    The column names are data, so a small job lists the runs first.
    """
    its = run_numbers(it_long)
    cells = [_once(F.count(F.when(F.col("it") == i, 1)), F.max(F.when(F.col("it") == i, F.col(m)))).alias(f"{m}_{i}")
             for i in its for m in methods]
    return it_long.groupBy("report_id").agg(*cells) if cells else it_long.select("report_id").distinct()


def pair_differences(it_long: DataFrame, methods: list[str]) -> DataFrame:
    """(method, it_a, it_b, d, n): how many reports differ by d = x - y in runs a < b, both graded."""
    runs = runs_long(it_long, methods).groupBy("report_id", "method").agg(
        F.array_sort(F.collect_list(F.when(F.col("it").isNotNull(), F.struct("it", "grade")))).alias("runs"))  # as many as runs
    doubled = F.size(F.array_distinct(F.transform("runs", lambda r: r["it"]))) != F.size("runs")
    runs = runs.withColumn("runs", _once(F.when(doubled, 2).otherwise(1), F.col("runs")))
    graded = F.filter("runs", lambda r: r["grade"].isNotNull())
    pairs = F.flatten(F.transform(graded, lambda a: F.transform(
        F.filter(graded, lambda b: b["it"] > a["it"]),
        lambda b: F.struct(a["it"].alias("it_a"), b["it"].alias("it_b"), (a["grade"] - b["grade"]).alias("d")))))
    # Reports with the same grades in all runs share their pairs: counted first, map side.
    alike = runs.groupBy("method", "runs").agg(F.count(F.lit(1)).alias("same"))
    return (alike.select("method", "same", F.explode(pairs).alias("p")).select("method", "same", "p.*")
            .groupBy("method", "it_a", "it_b", "d").agg(F.sum("same").alias("n")))


def iteration_pairs(it_long: DataFrame, methods: list[str]) -> DataFrame:
    """J6 summarised per run pair: rows complete in both runs, equal / differing, mean difference."""
    d = pair_differences(it_long, methods)
    return d.groupBy("method", "it_a", "it_b").agg(
        F.sum("n").alias("n_common"),
        F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).alias("n_equal"),
        F.sum(F.when(F.col("d") != 0, F.col("n")).otherwise(0)).alias("n_diff"),
        (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_diff"))


def wilcoxon_pairs(it_long: DataFrame, methods: list[str], min_rows: int = 5) -> DataFrame:
    """A22 + A25: signed-rank test for every run pair of every method."""
    keys = ["method", "it_a", "it_b"]
    nz = pair_differences(it_long, methods).groupBy(*keys, F.abs("d").cast("double").alias("ad")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("npos"),
        F.sum(F.when(F.col("d") < 0, F.col("n")).otherwise(0)).alias("nneg"))
    t = F.col("npos") + F.col("nneg")
    w = Window.partitionBy(*keys).orderBy("ad").rowsBetween(Window.unboundedPreceding, 0)
    # Equal pairs (ad = 0) have npos = nneg = t = 0, so they take no rank and no tie.
    nz = nz.withColumn("t", t).withColumn("rank", F.sum("t").over(w) - F.col("t") + (F.col("t") + 1) / 2.0)
    j = nz.groupBy(*keys).agg(
        F.sum("n").alias("n_common"),
        F.sum(F.col("rank") * F.col("npos")).alias("r_plus"),
        F.sum(F.col("rank") * F.col("nneg")).alias("r_minus"),
        F.sum("t").alias("n_nonzero"),
        F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n_nonzero").cast("double")
    W = F.least("r_plus", "r_minus")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.when(var > 0, (W - n * (n + 1) / 4.0) / F.sqrt(var))
    tested = F.col("n_common") > min_rows
    return j.select(
        *keys,
        F.concat(F.col("method"), F.lit("_"), F.col("it_a").cast("string"), F.lit(" vs "),
                 F.col("method"), F.lit("_"), F.col("it_b").cast("string")).alias("comparison"),
        "n_common", F.col("n_nonzero").cast("long").alias("n_nonzero"),
        F.when(tested, W).alias("statistic"),
        F.when(tested, z).alias("z"),
        F.when(tested, erfc(F.abs(z) / math.sqrt(2.0))).alias("p_value"),
        F.when(tested, F.lit("tested")).otherwise(F.lit("insufficient")).alias("status"))


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """P * m capped at 1, m = tests done for the method; reject if p <= alpha / m."""
    done = tests.where(F.col("status") == "tested")
    m = F.count(F.lit(1)).over(Window.partitionBy("method"))  # <= k(k-1)/2 rows per method
    return done.select(
        "method", "comparison", "it_a", "it_b", F.col("p_value").alias("raw_p_value"),
        m.alias("m")).select(
        "*",
        F.least(F.lit(1.0), F.col("raw_p_value") * F.col("m")).alias("corrected_p_value"),
        F.coalesce(F.col("raw_p_value") <= alpha / F.col("m"), F.lit(False)).alias("significant"))


def significant_summary(corrected: DataFrame) -> DataFrame:
    """A24: 'k/m' per method."""
    g = corrected.groupBy("method").agg(
        F.sum(F.col("significant").cast("int")).alias("n_significant"), F.count(F.lit(1)).alias("n_tests"))
    return g.withColumn("summary", F.concat_ws("/", F.col("n_significant").cast("string"),
                                               F.col("n_tests").cast("string")))


def grade_counts_by_iteration(it_long: DataFrame, methods: list[str]) -> DataFrame:
    """Counts of membership groups 0/1/2 per method and run of the data, zero-filled.

    Missing grades are not counted; other values (0 stays 0) keep their own
    group as the membership grouping leaves them unchanged, and only groups
    0..2 are reported.
    """
    grp = group_membership("grade")
    per_run = runs_long(it_long, methods).groupBy("method", "it").agg(
        *[F.count(F.when(grp == k, 1)).alias(f"n{k}") for k in (0, 1, 2)])
    return per_run.select("method", "it", F.explode(F.array(*[
        F.struct(F.lit(k).alias("grade_group"), F.col(f"n{k}").alias("n")) for k in (0, 1, 2)])).alias("g")).select(
            "method", "it", "g.grade_group", "g.n")
