"""Exact dedup by an extendible-hash index on shared files.

The index is Spark data from end to end (DataFrame functions only):

1. every row gets a 64-bit hash of its whole text (the index key);
2. the directory starts with one slot and doubles while a bucket holds more
   distinct keys than its capacity, so a bucket owns the key range of one
   hash prefix.  It has two tiers: the first is sized from a histogram over the
   first ``max_depth`` bits; a slot that is overfull at that depth gets a directory of its own
   over as many further bits.  The driver sees at most ``2**max_depth`` rows for each tier, and
   there are up to ``4**max_depth`` buckets (2**28, a billion times a thousand keys);
   buckets overfull beyond that are long chains;
3. equal texts collapse on the map side to a few rows (by ``SALTS`` hashes of the id, so a
   text that makes up a third of the table is not one task's work), which go to the owner
   task of their bucket.  The owner sorts its key range, chains the texts of a
   key and compares each with the one before, byte by byte: only that comparison says what is equal,
   and makes the entry: the id that stays and the number of rows;
4. the entries (one per different text) are written to the shared folder of
   ``spark.checkpoint.dir``.  Rows find their entry by key and SHA-256 without moving texts
   again; should two texts of a chain share both, their rows find it by the text itself.

Defined cases: a null text counts as the empty text; of equal texts the row
with the largest id stays, null ids lose against any other; rows that repeat
an id and a text are one group of that many rows, of which exactly one stays;
an empty table gives an empty result; other columns are never read by the
decisions, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import check_columns, col, row_hash, text_of

#: Distinct keys that a bucket holds before it is split.
BUCKET_KEYS = 4096
#: Largest global depth of a tier; a tier has at most 2**MAX_DEPTH slots.
MAX_DEPTH = 14
#: Rows of one text that reach its owner at most.
SALTS = 16


def index_key(text: Column, key_bits: int = 64) -> Column:
    """Hash whose leading bits address the directory; fewer bits force collisions (tests)."""
    h = F.xxhash64(text)
    return h if key_bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - key_bits), 64 - key_bits)


def split_directory(histogram: dict[int, int], capacity: int, max_depth: int) -> list[int]:
    """Directory slots -> first slot of the owning bucket, by doubling.

    ``histogram`` counts distinct keys by their first ``max_depth`` bits.  The
    slots of the returned list number a power of two, the final global depth.
    """
    counts = [histogram.get(i, 0) for i in range(1 << max_depth)]
    depth_sums = [counts]  # depth_sums[k]: keys by their first max_depth - k bits
    while len(depth_sums[-1]) > 1:
        below = depth_sums[-1]
        depth_sums.append([below[i] + below[i + 1] for i in range(0, len(below), 2)])
    directory, depth, local = [0], 0, {0: 0}  # slot -> bucket; bucket -> local depth
    while depth < max_depth:
        load = depth_sums[max_depth - depth]
        full = {b for b, d in local.items() if d == depth and load[b] > capacity}
        if not full:
            break
        # Double: every slot becomes two; only overfull buckets get a second owner.
        directory = [2 * b for b in directory for _ in (0, 1)]
        local = {2 * b: d for b, d in local.items()}
        depth += 1
        for b in (2 * b for b in full):
            directory[b + 1] = b + 1
            local[b] = local[b + 1] = depth
    return directory


def bucket_of(key: Column, directory: tuple[list[int], dict[int, int]]) -> Column:
    """Number of the owning bucket: that of the first tier, and the further bits where there is a second one."""
    slots, further = directory
    depth = len(slots).bit_length() - 1
    if depth == 0:
        return F.lit(0).cast("long")
    slot = F.shiftrightunsigned(key, 64 - depth).cast("int")
    bucket = F.element_at(F.array(*[F.lit(b) for b in slots]), slot + 1).cast("long")
    if not further:
        return bucket
    bits = F.element_at(F.array(*[F.lit(further.get(i, 0)) for i in range(len(slots))]), slot + 1)
    # The bits after the first ``depth``: moved to the top, then down; none where there is no second tier.
    rest = F.when(bits > 0, F.call_function("shiftrightunsigned", F.shiftleft(key, depth), F.lit(64) - bits)).otherwise(F.lit(0).cast("long"))
    return F.shiftleft(bucket, 32) + rest


def _directory(keys: DataFrame, key: str, capacity: int, max_depth: int) -> tuple[list[int], dict[int, int]]:
    different = keys.select(col(key).alias("key")).distinct()
    slot = F.shiftrightunsigned(F.col("key"), 64 - max_depth).cast("int")
    slots = [tuple(r) for r in different.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()]  # <= 2**max_depth rows
    first = split_directory(dict(slots), capacity, max_depth)
    full = [s for s, n in slots if n > capacity]
    if not full:
        return first, {}
    # Overfull slots have the full depth.  Keys by their next bits, then the fullest part at each number of bits.
    part = F.shiftrightunsigned(F.shiftleft(F.col("key"), max_depth), 64 - max_depth).cast("int")
    flagged = F.element_at(F.array(*[F.lit(s in set(full)) for s in range(1 << max_depth)]), slot + 1)
    parts = different.where(flagged).groupBy(slot.alias("slot"), part.alias("part")).agg(F.count("*").alias("n"))
    levels = parts.select("slot", "part", "n", F.explode(F.sequence(F.lit(1), F.lit(max_depth))).alias("e"))
    levels = levels.groupBy("slot", "e", F.call_function("shiftright", F.col("part"), F.lit(max_depth) - F.col("e")).alias("p")).agg(F.sum("n").alias("n"))
    loads = levels.groupBy("slot", "e").agg(F.max("n").alias("n")).where((F.col("n") <= capacity) | (F.col("e") == max_depth))
    least = {r["slot"]: r["e"] for r in loads.groupBy("slot").agg(F.min("e").alias("e")).collect()}  # <= 2**max_depth rows
    return first, least


def _owned(collapsed: DataFrame) -> DataFrame:
    """Rows (bucket, key, text, ...) at the owners of their buckets, with ``chain_pos``: the place of the text in the chain of its key.

    A text that differs from the one before it in the sorted key range begins a new link of the chain.
    """
    chain = Window.partitionBy("bucket", "key").orderBy("text")
    owner = collapsed.repartition("bucket").sortWithinPartitions("bucket", "key", "text")
    differs = F.coalesce(F.lag("text").over(chain) != F.col("text"), F.lit(True)).cast("int")
    return owner.withColumn("differs", differs).withColumn("chain_pos", F.sum("differs").over(chain)).drop("differs")


def salt_of(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(SALTS))


def text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = BUCKET_KEYS,
                max_depth: int = MAX_DEPTH, key_bits: int = 64, digest=text_digest) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): rows by (key, sha, id) with their number, and one entry per different text.

    Entries have bucket, key, sha, chain_pos, keep_id and group_size, and the text where its digest does not tell it from another's.
    """
    check_columns(docs, id_col, text_col)
    ensure_checkpoint_dir(docs.sparkSession)
    text = text_of(text_col)
    hashed = docs.select(col(id_col).alias("id"), index_key(text, key_bits).alias("key"), text.alias("text"))
    rows = hashed.groupBy("key", digest(F.col("text")).alias("sha"), "id").agg(F.count("*").alias("n")).checkpoint()
    directory = _directory(rows, "key", capacity, max_depth)
    collapsed = hashed.withColumn("bucket", bucket_of(F.col("key"), directory)).groupBy(
        "bucket", "key", "text", salt_of(F.col("id")).alias("salt")).agg(F.max("id").alias("id"), F.count("*").alias("n"))
    links = _owned(collapsed.select("bucket", "key", "text", "id", "n"))
    # Still at the owners: the links of a chain become entries.
    entries = links.groupBy("bucket", "key", "chain_pos").agg(
        F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.first("text").alias("text"))
    entries = entries.withColumn("sha", digest(F.col("text")))
    twins = F.count("*").over(Window.partitionBy("bucket", "key", "sha"))
    entries = entries.withColumn("text", F.when(twins > 1, F.col("text")))
    return rows, entries.checkpoint()


def resolve(rows: DataFrame, entries: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """Rows with what their entry says; ``hashed`` (key, sha, id, text) is read for texts that share key and digest only."""
    plain = entries.where(F.col("text").isNull()).drop("text")
    found = rows.join(plain, ["key", "sha"])
    if hashed is not None:
        twins = entries.where(F.col("text").isNotNull())
        theirs = hashed.join(twins, ["key", "sha", "text"]).drop("text").groupBy(
            "key", "sha", "id", "bucket", "chain_pos", "keep_id", "group_size").agg(F.count("*").alias("n"))
        found = found.unionByName(theirs)
    return found


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=text_digest, key_bits: int = 64, **index) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket, chain_pos."""
    rows, entries = build_index(docs, id_col, text_col, digest=digest, key_bits=key_bits, **index)
    hashed = None
    if not entries.where(F.col("text").isNotNull()).isEmpty():
        text = text_of(text_col)
        hashed = docs.select(index_key(text, key_bits).alias("key"), digest(text).alias("sha"), col(id_col).alias("id"), text.alias("text"))
    return (resolve(rows, entries, hashed)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long"),
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.col("sha").alias("text_sha256"), "bucket", "chain_pos"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                      capacity: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH, key_bits: int = 64) -> DataFrame:
    """The rows that stay, with all their columns: one per different text, as the owner's chain says.

    The row with the largest (id, row hash) of a text wins, first among those that collapse on the
    map side, then at the owner of the bucket.
    """
    check_columns(docs, id_col, text_col)
    best = F.struct(*[col(c) for c in docs.columns if c != text_col], col(text_col).isNull().alias("null text"))
    rank = F.struct(col(id_col).alias("id"), row_hash(docs).alias("h"))
    keyed = docs.select(index_key(text_of(text_col), key_bits).alias("key"), text_of(text_col).alias("text"), best.alias("best"),
                        rank.alias("rank"), salt_of(col(id_col)).alias("salt"))
    directory = _directory(keyed.select("key"), "key", capacity, max_depth)
    collapsed = keyed.withColumn("bucket", bucket_of(F.col("key"), directory)).groupBy("bucket", "key", "text", "salt").agg(
        F.max_by("best", "rank").alias("best"), F.max("rank").alias("rank"))
    won = _owned(collapsed.drop("salt")).groupBy("bucket", "key", "chain_pos").agg(
        F.max_by("best", "rank").alias("best"), F.first("text").alias("text"))
    back = F.when(~F.col("best").getField("null text"), F.col("text"))
    return won.select(*[back.alias(c) if c == text_col else F.col("best").getField(c).alias(c) for c in docs.columns])
