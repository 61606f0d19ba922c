"""Grade extraction records as they arrive; restart without repeating work.

Each micro-batch is encoded (J1/J2) and graded (A1) as a batch DataFrame
inside ``foreachBatch`` by the same functions as a table, and written to
``<out>/batch_id=<n>`` with overwrite: a batch replayed after a failure
rewrites its own folder, never duplicates rows.  The checkpoint folder records
which files were consumed.

The *code map* is state that outlives a batch: ``<out>/_codes/<version>/batch_id=<n>`` holds
the codes of the terms that batch n was the first to bring.  A batch searches
only terms that no earlier batch has searched; a replayed batch reads the map of
the batches before it and rewrites its own part.  The version is a fingerprint of
the dictionaries, so a changed dictionary starts a map of its own.  Every ``compact`` batches
the parts are merged into one, so a batch reads a bounded number of folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.encode import CODE_MAP, codes_of_terms
from ..operators.grading import encode_extraction, extraction_terms, grade_extraction, of_kinds
from ..operators.lexicon_ops import lexicon_version
from ..plans.model import _file_system
from ..session import ensure_checkpoint_dir

#: Batches after which the parts of the code map are merged.
COMPACT = 20


def code_map_parts(spark: SparkSession, root: str) -> dict[int, str]:
    """Parts of a code map that are complete, by batch; a merged part counts for its last batch."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {int(n.split("=")[1]): f"{root}/{n}" for n in names
            if n.startswith(("batch_id=", "upto=")) and fs.exists(_file_system(spark, f"{root}/{n}/_SUCCESS")[1])}


def known_codes(spark: SparkSession, root: str, before: int) -> DataFrame:
    """The code map of all batches before ``before``: the last merged part and what came after it."""
    fs, path = _file_system(spark, root)
    parts = {n: p for n, p in code_map_parts(spark, root).items() if n < before}
    merged = max((n for n, p in parts.items() if "/upto=" in p), default=-1)
    paths = [p for n, p in sorted(parts.items()) if n > merged or "/upto=" in p and n == merged]
    return spark.read.schema(CODE_MAP).parquet(*paths) if paths else spark.createDataFrame([], CODE_MAP)


def update_code_map(batch: DataFrame, batch_id: int, lexicon: DataFrame, root: str, *, max_distance: int | None = None,
                    compact: int = COMPACT) -> DataFrame:
    """The code map with the batch's new terms; only those are looked up in the dictionary."""
    spark = batch.sparkSession
    known = known_codes(spark, root, batch_id)
    terms = extraction_terms(batch).distinct()
    new = terms.join(known.select("kind", "term_raw"), ["kind", "term_raw"], "left_anti").checkpoint()
    part = f"{root}/batch_id={batch_id}"
    codes = codes_of_terms(new, lexicon, max_distance=max_distance) if not new.isEmpty() else spark.createDataFrame([], CODE_MAP)
    codes.write.mode("overwrite").parquet(part)
    now = known.unionByName(spark.read.schema(CODE_MAP).parquet(part))
    if compact and batch_id % compact == compact - 1:
        # Parts stay where they are: a replay of an earlier batch still finds its own.
        now.write.mode("overwrite").parquet(f"{root}/upto={batch_id}")
    return now


def grade_stream(spark: SparkSession, source: str, schema: T.StructType, findings_lex: DataFrame,
                 devices_lex: DataFrame, diagnoses_lex: DataFrame, out: str, checkpoint: str, *,
                 files_per_trigger: int | None = None, available_now: bool = True, fmt: str = "parquet",
                 select: list[str] | None = None, compact: int = COMPACT):
    """Start the stream; returns the StreamingQuery (await it for availableNow)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    src = reader.load(source)
    lexicon = of_kinds({"finding": findings_lex, "device": devices_lex, "diagnosis": diagnoses_lex})
    out = out.rstrip("/")
    codes_root = f"{out}/_codes/{lexicon_version(lexicon)}"
    ensure_checkpoint_dir(spark)
    lexicon = lexicon.checkpoint()  # every batch reads it

    def grade_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.checkpoint()  # read twice: for its terms and for its grades
        codes = update_code_map(batch, batch_id, lexicon, codes_root, compact=compact)
        g = grade_extraction(encode_extraction(batch, findings_lex, devices_lex, diagnoses_lex, codes=codes))
        if select:
            g = g.select(*select)
        g.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = src.writeStream.foreachBatch(grade_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
