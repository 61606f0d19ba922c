"""File sources and sinks: dictionaries (JSON), reports (CSV), run files.

Reading never trusts a file's key order implicitly: dictionary position is
made explicit as ``idx`` at scan time (``posexplode`` keeps text order; a
MAP would not promise it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = r'"((?:[^"\\]|\\.)*)"\s*:\s*(-?\d+)'


def lexicon_scan(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """JSON object files ``{"term": priority, ...}`` -> (file, idx, term, priority[, kind]).

    ``wholetext`` reads one row per file (a dictionary, small by nature);
    pairs are taken in text order and numbered by ``posexplode``.  A key that is
    written twice is one entry, at its first place and with its last value.
    """
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    pairs = t.select("file", F.arrays_zip(F.regexp_extract_all("value", F.lit(PAIR), 1).alias("term"),
                                          F.regexp_extract_all("value", F.lit(PAIR), 2).alias("priority")).alias("p"))
    e = pairs.select("file", F.posexplode("p").alias("idx", "x"))
    out = e.select("file", F.col("idx").cast("int").alias("idx"),
                   F.from_json(F.concat(F.lit('["'), F.col("x.term"), F.lit('"]')), "array<string>")[0].alias("term"),
                   F.col("x.priority").cast("int").alias("priority"))
    once = out.groupBy("file", "term").agg(F.min("idx").alias("place"), F.max_by("priority", "idx").alias("priority"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1
    out = once.select("file", place.cast("int").alias("idx"), "term", "priority")
    return out.withColumn("kind", F.lit(kind)) if kind is not None else out


#: Terms of a dictionary that may be written as one JSON object, which one task holds.
MAX_JSON_TERMS = 1_000_000


def write_lexicon_json(lexicon: DataFrame, path: str, max_terms: int = MAX_JSON_TERMS) -> None:
    """Write a lexicon as one JSON object file, keys in ``idx`` order; an error beyond ``max_terms``."""
    term = F.regexp_replace(F.to_json(F.array("term")), r"^\[|\]$", "")  # quoted and escaped
    arr = F.array_sort(F.collect_list(F.struct("idx", F.concat(F.lit("    "), term, F.lit(": "),
                                                               F.col("priority").cast("string")).alias("line"))))
    body = F.concat(F.lit("{\n"), F.array_join(F.transform(arr, lambda x: x["line"]), ",\n"), F.lit("\n}\n"))
    body = F.when(F.count(F.lit(1)) <= max_terms, body).otherwise(
        F.raise_error(F.lit(f"a JSON dictionary holds at most {max_terms} terms")))
    lexicon.agg(body.alias("value")).write.mode("overwrite").text(path)


def scan_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV reports whose text holds line breaks and quotes; a large file is read by many tasks."""
    return scan_quoted_csv(spark, path, schema)


FRAGMENT = "file string, block long, kind int, text string"
WHOLE, OPENED, INSIDE, CLOSED = 0, 1, 2, 3


def scan_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, file_col: str | None = None) -> DataFrame:
    """CSV files with a header, in which quoted values may hold line breaks, split over byte ranges.

    A line break ends a record where the number of quotes before it is even (a quote inside a value is
    doubled, so it does not change the parity).  One pass counts the quotes of each byte
    range; a prefix sum over the ranges of a file (a few numbers each) gives the parity at which each begins; a second
    pass puts the lines of a range together to records.  What a range's end cuts
    is the only thing that moves: fragments are joined by file and record.
    Equal to a read with ``multiLine``, which gives a file to one task.  ``file_col`` adds the file's path.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2
    ranges = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("begins"))
    # The lines of a range stay in the order in which its task reads them; a shuffle join would lose it, so what each
    # range needs to know comes with the table of ranges, which is as long as the number of input splits.
    known = {(r["file"], r["block"]): r["begins"] for r in begins.where("begins = 1").toLocalIterator()}
    odd = spark.sparkContext.broadcast(known)

    def assemble(batches):
        import pyarrow as pa

        held: list[str] = []
        at, inside, cut, first = None, False, False, True

        def row(kind, text):
            return {"file": at[0], "block": at[1], "kind": kind, "text": text}

        def last():
            if held:
                yield row(INSIDE if cut else OPENED, "\n".join(held))

        out = []
        for batch in batches:
            for value, file, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != at:
                    out += last()
                    at, inside = (file, block), odd.value.get((file, block), 0) == 1
                    # The first record of a range may have begun in an earlier one; the header is the first of the file.
                    held, cut, first = [], inside, block == 0
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    if cut:
                        out.append(row(CLOSED, "\n".join(held)))
                    elif not first and held != [""]:
                        out.append(row(WHOLE, held[0] if len(held) == 1 else "\n".join(held)))
                    elif first and len(held) == 1 and value == "":
                        held = []  # empty lines before the header
                        continue
                    held, cut, first = [], False, False
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, fragment_schema())
                out = []
        out += last()
        if out:
            yield pa.RecordBatch.from_pylist(out, fragment_schema())

    parts = lines.select("value", "file", "block").mapInArrow(assemble, FRAGMENT)
    # A cut record: what one range opened, all of the ranges inside it, and what a later one closed.
    cut = parts.where(F.col("kind") != WHOLE)
    number = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == OPENED, 1).otherwise(0))
    cut = cut.withColumn("record", F.sum(F.when(F.col("kind") == OPENED, 1).otherwise(0)).over(number))
    joined = cut.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    records = parts.where(F.col("kind") == WHOLE).select("file", "text").union(joined.select("file", "text"))
    read = F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "mode": "PERMISSIVE"})
    file = [F.col("file").alias(file_col)] if file_col else []
    return records.select(read.alias("r"), "file").select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], *file)


def fragment_schema():
    import pyarrow as pa
    return pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink; nested columns are written as JSON text."""
    cols = [F.to_json(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name)
            for f in df.schema.fields]
    # The writer trims white space around values by default; report text keeps it.
    (df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def scan_iterations(spark: SparkSession, pattern: str, columns: list[str],
                    header_regex: str | None = None, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """S3: one CSV file per run, headers suffixed by the run number.

    Read by position with neutral names; the run number comes from the file
    name (``iteration_<n>``).  When ``header_regex`` is given every file's
    first line is checked against it first (positional reading trusts the
    column order), in one distributed pass over the files.  ``text_columns``
    are read as text that may hold line breaks (runs keyed by the report's
    text), by byte ranges as in ``scan_quoted_csv``.
    """
    if header_regex is not None:
        # The first line of a file is the first row of the split that starts at byte 0.
        lines = spark.read.text(pattern).select(
            "value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
            F.col("_metadata.file_path").alias("file"))
        heads = lines.where(F.col("start") == 0).groupBy("file").agg(F.min_by("value", "at").alias("head"))
        if heads.where(~F.col("head").rlike(header_regex)).limit(1).count():
            raise ValueError("a run file has an unexpected header; positional reading would misalign")
    schema = T.StructType([T.StructField(c, T.LongType() if c == "report_id" else T.StringType() if c in text_columns
                                         else T.IntegerType()) for c in columns])
    if text_columns:
        df, file = scan_quoted_csv(spark, pattern, schema, file_col="_file"), F.col("_file")
    else:
        df, file = spark.read.schema(schema).option("header", True).option("escape", '"').csv(pattern), F.col("_metadata.file_path")
    return df.select(*columns, F.regexp_extract(file, r"iteration_(\d+)", 1).cast("int").alias("it"))


def write_iterations(it_long: DataFrame, folder: str, methods: list[str]) -> None:
    """Write a long run table as one CSV file per run with suffixed headers (the source shape of S3)."""
    its = [r["it"] for r in it_long.select("it").distinct().collect()]  # run numbers: a handful
    for i in sorted(its):
        part = it_long.where(F.col("it") == i).select("report_id", *[F.col(m).alias(f"{m}_{i}") for m in methods])
        part.write.mode("overwrite").option("header", True).csv(f"{folder}/iteration_{i}")
