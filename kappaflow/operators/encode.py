"""Term encoding against ordered dictionaries (J1 exact, J2 nearest, J3 priority).

One plan for dictionaries of any size, shared by the long, nested and
streaming forms:

    lexicon  -> one entry per (kind, term), staged once
    mentions --distinct(kind, term)--> terms            (partial agg, one shuffle)
    terms  LEFT JOIN lexicon ON term                    (exact; staged once)
    unmatched fuzzy terms -> nearest entry by the index of ``nearest``
    mentions LEFT JOIN code-map ON (kind, term)         (code-map = distinct terms)

Edit distances are computed once per *distinct* unmatched term and candidate,
never per mention.  The staged tables are those of distinct terms and entries:
small jobs that run while the plan is built, so that neither the mentions nor the dictionary is read
again for the exact and the nearest branch.  Nothing of the dictionary passes through
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .nearest import BLOCK, nearest_terms, one_entry_per_term

CODE_MAP = "kind string, term_raw string, idx int, term string, priority int, match string, distance int"


def distinct_terms(mentions: DataFrame, term_col: str = "term_raw", kind_col: str = "kind") -> DataFrame:
    """The different (kind, term_raw) of ``mentions``, staged."""
    ensure_checkpoint_dir(mentions.sparkSession)
    return (mentions.select(F.col(kind_col).alias("kind"), F.col(term_col).alias("term_raw"))
            .where(F.col("term_raw").isNotNull()).distinct().checkpoint())


def codes_of_terms(terms: DataFrame, lexicon: DataFrame, *, fuzzy_kinds=("finding",), max_distance: int | None = None,
                   block: int = BLOCK, no_index: int = BLOCK) -> DataFrame:
    """Code map (``CODE_MAP``) of distinct (kind, term_raw): exact match first (J1); nearest only for unmatched
    terms of ``fuzzy_kinds`` (Q5, Q6).  ``lexicon`` may carry a ``kind`` column (one dictionary per kind); then
    matching is within the kind.
    """
    ensure_checkpoint_dir(terms.sparkSession)
    on = ["kind", "term_raw"] if "kind" in lexicon.columns else ["term_raw"]
    entries = one_entry_per_term(lexicon).checkpoint()
    lx = entries.select(*on[:-1], F.col("term").alias("term_raw"), F.col("idx").alias("x_idx"),
                        F.col("term").alias("x_term"), F.col("priority").alias("x_pri"))
    exact = terms.join(lx, on, "left").select("kind", "term_raw", "x_idx", "x_term", "x_pri")
    if fuzzy_kinds:
        exact = exact.checkpoint()
        fuzzy = F.col("kind").isin(list(fuzzy_kinds))
        searched = entries.where(fuzzy) if len(on) > 1 else entries
        near = nearest_terms(exact.where(F.col("x_idx").isNull() & fuzzy), searched, block, no_index=no_index, staged=True)
        if max_distance is not None:
            near = near.where(F.col("dist") <= max_distance)
        near = near.select(*on, F.struct("dist", "idx", "term", "priority").alias("_n"))
        both = exact.join(near, on, "left").withColumn("_n", F.when(F.col("x_idx").isNull() & fuzzy, F.col("_n")))
    else:
        both = exact.withColumn("_n", F.lit(None).cast("struct<dist:int,idx:int,term:string,priority:int>"))
    return both.select(
        "kind", "term_raw",
        F.coalesce("x_idx", F.col("_n.idx")).alias("idx"),
        F.coalesce("x_term", F.col("_n.term")).alias("term"),
        F.coalesce("x_pri", F.col("_n.priority")).alias("priority"),
        F.when(F.col("x_idx").isNotNull(), F.lit("exact"))
        .when(F.col("_n").isNotNull(), F.lit("nearest")).alias("match"),
        F.when(F.col("x_idx").isNotNull(), F.lit(0)).otherwise(F.col("_n.dist")).alias("distance"))


def term_codes(mentions: DataFrame, lexicon: DataFrame, *, term_col: str = "term_raw",
               kind_col: str = "kind", **how) -> DataFrame:
    """Code map over the distinct (kind, term) pairs of ``mentions`` (see ``codes_of_terms``)."""
    return codes_of_terms(distinct_terms(mentions, term_col, kind_col), lexicon, **how)


def encode_mentions(mentions: DataFrame, lexicon: DataFrame, *, term_col: str = "term_raw",
                    kind_col: str = "kind", **how) -> DataFrame:
    """Attach idx / term / priority / match / distance to every mention row.

    Unmatched rows keep NULL codes (the raw text stays in ``term_col``).
    """
    codes = term_codes(mentions, lexicon, term_col=term_col, kind_col=kind_col, **how)
    codes = codes.withColumnRenamed("kind", kind_col).withColumnRenamed("term_raw", term_col)
    return mentions.join(codes, [kind_col, term_col], "left")


def encode_exact(mentions: DataFrame, lexicon: DataFrame, **kw) -> DataFrame:
    """J1 alone: no nearest-term fallback for any kind."""
    return encode_mentions(mentions, lexicon, fuzzy_kinds=(), **kw)


def code_of(word: Column, words: list[str]) -> Column:
    """Position of ``word`` in a fixed code list (0-based); NULL when absent."""
    pos = F.array_position(F.array(*[F.lit(w) for w in words]), word)
    return F.when(pos > 0, (pos - 1).cast("int"))
