"""Corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Quality rules, exact dedup, SimHash near-dedup, mixing of sources to target
weights, and BPE encoding.  Every stage takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet to the shared folder and read again
as the next stage's ``docs``; all but the last return the columns of
``documents``.  Stage folders are named by the run, so a new run never reads
another run's rows; a run with a name takes up after its last completed stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.llm.bpe import bpe_round_trip
from kappaflow.llm.exact_dedup import drop_exact_copies
from kappaflow.llm.mixing import mix_sources
from kappaflow.llm.quality import keep_quality, train_field
from kappaflow.llm.queries import MIX_SEED, OTHER_WEIGHT, SOURCE_WEIGHTS, TOKENIZER, table
from kappaflow.llm.simhash import drop_near_copies
from kappaflow.plans.model import read_stage, stage_table, table_version


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the line labels."""
    return keep_quality(docs, train_field(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one document: that with the smallest id."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in the target proportions, globally shuffled."""
    return mix_sources(docs, SOURCE_WEIGHTS, other_weight=OTHER_WEIGHT, seed=MIX_SEED, numbered=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, the text that they decode to, and what names it."""
    coded = bpe_round_trip(docs, public_tokenizers.path(TOKENIZER), keep=("lang", "source"))
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "ids",
                        F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash", near), ("mix", mix), ("bpe", encode)]

#: The field, the fingerprints and BPE have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The stages one after the other.

    A run with a ``name`` can be resumed: stages that were completed for the same documents and
    labels are read (``clear_run(spark, name)`` removes them).  A run without one has folders of its own.
    """
    docs = table(spark, sf_dir, "documents")
    version = table_version(docs, table(spark, sf_dir, "labels"), stages=[s for s, _ in STAGES]) if name else None
    root = name or f"pipeline-{uuid.uuid4().hex}"
    for stage_name, stage in STAGES[:-1]:
        done = read_stage(spark, f"{root}/{stage_name}", version=version)
        docs = done if done is not None else stage_table(stage(spark, docs, sf_dir), f"{root}/{stage_name}", version=version)
    return STAGES[-1][1](spark, docs, sf_dir)
