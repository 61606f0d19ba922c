"""Dictionary comparison and regrading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import codes_of_terms, distinct_terms, encode_mentions
from .grading import grade_reports, mention_priority

PAIR = ["kind", "term_raw"]


def lexicon_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """M5: added / removed / changed / same per term (full outer join on term)."""
    x = a.select("term", F.col("idx").alias("idx_a"), F.col("priority").alias("priority_a"))
    y = b.select("term", F.col("idx").alias("idx_b"), F.col("priority").alias("priority_b"))
    j = x.join(y, "term", "full_outer")
    status = (F.when(F.col("idx_a").isNull(), "added").when(F.col("idx_b").isNull(), "removed")
              .when(F.col("priority_a") != F.col("priority_b"), "changed").otherwise("same"))
    return j.select("term", "idx_a", "idx_b", "priority_a", "priority_b", status.alias("status"))


def lexicon_version(lexicon: DataFrame) -> str:
    """Fingerprint of a dictionary, whatever the order of its rows: number and sum of row hashes."""
    cols = [c for c in ("kind", "idx", "term", "priority") if c in lexicon.columns]
    n, total = lexicon.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return f"{n}-{int(total or 0) % (1 << 64):016x}"


def code_changes(mentions: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, term_raw, priority_a, priority_b) of every distinct term under two dictionaries, staged.

    The terms are taken once and looked up in both.  A term's code changes when its entry does, or
    when its nearest entry is another one.
    """
    terms = distinct_terms(mentions)
    x = codes_of_terms(terms, a).select(*PAIR, F.col("priority").alias("priority_a"))
    y = codes_of_terms(terms, b).select(*PAIR, F.col("priority").alias("priority_b"))
    return x.join(y, PAIR).checkpoint()


def term_index(mentions: DataFrame) -> DataFrame:
    """Inverted index: the reports that hold a (kind, term_raw), each once."""
    return mentions.select(*PAIR, "report_id").where(F.col("term_raw").isNotNull()).distinct()


def regrade_changed(graded: DataFrame, mentions: DataFrame, a: DataFrame, b: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Grades under ``b`` of reports that were graded under ``a``; ``graded`` is what ``grade_reports`` gave.

    Only reports that hold a term whose priority differs are graded again; the others keep their row.  With ``index``
    (a stored ``term_index``) the mentions of the others are not read for their terms.
    Adds ``regraded``: whether the row is new.
    """
    codes = code_changes(mentions if index is None else index, a, b)
    changed = codes.where(~F.col("priority_a").eqNullSafe(F.col("priority_b"))).select(*PAIR)
    touched = (term_index(mentions) if index is None else index).join(changed, PAIR, "left_semi").select("report_id").distinct().checkpoint()
    theirs = mentions.join(touched, "report_id", "left_semi").join(codes.withColumnRenamed("priority_b", "priority"), PAIR, "left")
    new = grade_reports(mention_priority(theirs)).withColumn("regraded", F.lit(True))
    return graded.join(touched, "report_id", "left_anti").withColumn("regraded", F.lit(False)).unionByName(new)


def regrade_with_lexicon(mentions: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """M6: the same mentions graded under two dictionaries; counts of (grade_a, grade_b).

    Where neither grade is there yet: both codes are joined to the mentions in one code map and graded in one
    aggregate by report; the final crosstab is a 5 x 5 count.  The mentions are read for their terms and for this.
    """
    codes = code_changes(mentions, a, b).withColumnsRenamed({"priority_a": "p_a", "priority_b": "p_b"})
    both = mentions.join(codes, PAIR, "left")
    graded = mention_priority(mention_priority(both, priority_col="p_a").withColumnRenamed("effective_priority", "e_a"), priority_col="p_b")
    overall = []
    for name, e in (("overall_a", F.col("e_a")), ("overall_b", F.col("effective_priority"))):
        counts = F.count(F.when(F.col("kind").isin("finding", "device"), e)) > 0
        overall.append(F.when(counts, F.max(e)).otherwise(F.lit(1)).cast("int").alias(name))
    j = graded.groupBy("report_id").agg(*overall)
    return j.groupBy("overall_a", "overall_b").agg(F.count(F.lit(1)).alias("n"),
                                                   F.count(F.when(F.col("overall_a") != F.col("overall_b"), 1))
                                                   .alias("n_changed"))


def grade_with(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Grades of all reports under one dictionary."""
    return grade_reports(mention_priority(encode_mentions(mentions, lexicon)))

