"""Distributions and review lists.

Every distribution is a grouped count first (partial aggregation: rows
become a handful of (column, value, n) cells) and any further statistic is
computed on those cells -- percentiles use the frequency form of
``percentile``, whiskers read the same cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import group_threshold


def system_frequency(mentions: DataFrame, *, kind_col: str = "kind", system_col: str = "system",
                     kind: str = "finding") -> DataFrame:
    """A4 + O1: findings per body system (only findings carrying one), most frequent first."""
    return (mentions.where((F.col(kind_col) == kind) & F.col(system_col).isNotNull())
            .groupBy(F.col(system_col).alias("system")).agg(F.count(F.lit(1)).alias("frequency"))
            .orderBy(F.desc("frequency"), "system"))


def grouped_columns(graded: DataFrame, truth_col: str = "priority_manual",
                    methods=("priority_algo", "priority_llm", "judge_grade", "priority_hybrid")) -> DataFrame:
    """The truth column plus the threshold-grouped method columns (``<m>_grouped``)."""
    return graded.select("report_id", truth_col, *[group_threshold(m).alias(f"{m}_grouped") for m in methods])


def value_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n): the distribution of several columns in one aggregate."""
    return (df.select(*cols).unpivot([], cols, "column", "value")
            .where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def grade_histogram(df: DataFrame, cols: list[str], edges=(0, 1, 2, 3)) -> DataFrame:
    """Counts per bin [e0,e1), ..., [e_{k-1}, e_k] (last bin closed), zero-filled."""
    cells = value_cells(df, cols)
    lo, hi, nb = edges[0], edges[-1], len(edges) - 1
    v = F.col("value").cast("double")
    b = F.when((v >= lo) & (v < hi), F.floor((v - lo) / ((hi - lo) / nb))).when(v == hi, nb - 1)
    obs = cells.withColumn("bin", b.cast("int")).where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(
        F.sum("n").alias("n"))
    grid = (cells.select("column").distinct()
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))))
    width = (hi - lo) / nb
    return (grid.join(obs, ["column", "bin"], "left")
            .select("column", (F.lit(float(lo)) + F.col("bin") * width).alias("bin_start"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def error_histogram(long: DataFrame, lo: int = -2, hi: int = 2) -> DataFrame:
    """Counts of pred - truth per method over integer errors lo..hi, zero-filled."""
    e = long.select("method", (F.col("pred") - F.col("truth")).alias("error"))
    obs = e.where(F.col("error").between(lo, hi)).groupBy("method", "error").agg(F.count(F.lit(1)).alias("n"))
    grid = e.select("method").distinct().withColumn("error", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return (grid.join(obs, ["method", "error"], "left")
            .select("method", "error", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def box_summary(df: DataFrame, cols: list[str], whis: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation), whiskers within whis * IQR, outlier count."""
    cells = value_cells(df, cols).withColumn("value", F.col("value").cast("double"))
    q = cells.groupBy("column").agg(
        F.percentile(F.col("value"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"),
        F.sum("n").alias("count"))
    q = q.select("column", "count", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = cells.join(q, "column")
    lo_ok = F.col("value") >= F.col("q1") - whis * F.col("iqr")
    hi_ok = F.col("value") <= F.col("q3") + whis * F.col("iqr")
    w = j.groupBy("column", "count", "q1", "median", "q3").agg(
        F.min(F.when(lo_ok, F.col("value"))).alias("whisker_low"),
        F.max(F.when(hi_ok, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~(lo_ok & hi_ok), F.col("n")).otherwise(0)).alias("n_outliers"))
    return w.select("column", "count", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"),
                    F.round("q3", 6).alias("q3"),
                    F.coalesce("whisker_low", "q1").alias("whisker_low"),
                    F.coalesce("whisker_high", "q3").alias("whisker_high"), "n_outliers")


def undergraded(grouped: DataFrame, truth_col: str = "priority_manual",
                pred_col: str = "priority_hybrid_grouped") -> DataFrame:
    """Truth abnormal (>= 1) but graded normal (0)."""
    return grouped.where((F.col(truth_col) >= 1) & (F.col(pred_col) == 0))


def overgraded(grouped: DataFrame, truth_col: str = "priority_manual",
               pred_col: str = "priority_hybrid_grouped") -> DataFrame:
    """Truth normal (0) but graded abnormal (>= 1)."""
    return grouped.where((F.col(truth_col) == 0) & (F.col(pred_col) >= 1))


def review_sample(df: DataFrame, n: int = 20, seed: int = 42, key: str = "report_id") -> DataFrame:
    """O3: at most ``n`` rows, chosen by a seeded hash of the key.

    The order is sha-256 of "seed:key" then the key: the same rows under
    any partitioning or engine.  orderBy + limit plans as a per-partition
    top-n with a final merge, not a full sort.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a missing value in any of ``cols`` removed."""
    return df.na.drop(subset=cols)


def row_range(df: DataFrame, start: int = 0, end: int = -1, key: str = "report_id") -> DataFrame:
    """P10: inclusive key range; ``end = -1`` means to the last row."""
    c = F.col(key)
    return df.where(c >= start) if end == -1 else df.where(c.between(start, end))


def rename_if_absent(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename source -> target only where the source exists and the target does not.

    A schema check on the driver; no job runs.
    """
    cols = set(df.columns)
    todo = {s: t for s, t in mapping.items() if s in cols and t not in cols}
    return df.withColumnsRenamed(todo) if todo else df


PIPELINE_RENAMES = {
    "GROUND_TRUTH": "priority_manual",
    "hybrid_grade": "priority_hybrid",
    "overall_max_priority": "priority_algo",
    "llm_grade": "priority_llm",
}


def duplicate_texts(df: DataFrame, text_col: str = "TEXT_REPORT") -> DataFrame:
    """Q22: texts, reports, and reports that share their text with another; texts are grouped by their hash."""
    per_text = df.groupBy(F.sha2(F.col(text_col), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per_text.agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_reports"),
                        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_sharing_a_text"))


def assert_unique(df: DataFrame, key: str = "report_id") -> DataFrame:
    """Q21: the same table, or an error naming a key that occurs twice (one grouped count on the key alone)."""
    twice = df.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} occurs {twice[0][1]} times; it must name one row")
    return df
