"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handed to numpy at once hold about this many characters of text; a
#: single longer text makes a slice of its own.
SLICE_CHARS = 2_000_000


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that do not clash (case-insensitively) with ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"_{w}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """Text column with null read as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64-bit hash of a whole row; breaks ties between rows with equal ids.

    Maps have no hash in Spark, so they enter as their JSON text.
    """
    cols = [F.to_json(F.struct(col(c))) if "map<" in t else col(c) for c, t in df.dtypes]
    return F.xxhash64(F.lit(seed), *cols)


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str,
                limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows whose texts stay under ``limit`` characters."""
    for batch in batches:
        where = batch.schema.get_field_index(text_col)
        # Byte lengths bound the character counts from above.
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(where)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(where).to_pylist()]
                start, total = i, 0
            total += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, [t or "" for t in part.column(where).to_pylist()]


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
