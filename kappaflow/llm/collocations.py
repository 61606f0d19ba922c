"""Phrase collocation mining with mergeable Misra-Gries summaries.

1. *Summaries.*  Every task turns its texts into streams of words by language
   and counts the phrases of one to ``max_words`` words in runs of
   ``RUN_WORDS`` words.  A phrase is a 64-bit hash there; its leading bits name
   its hash partition.  Each run sends one packed row per partition (hashes and
   counts) and one row with the partition's mass.  The owner of a partition reads the masses
   first, so its Misra-Gries summary gets a capacity of ``CAPACITY`` times
   mass / threshold before the first count arrives; runs are merged into it one
   after the other (add counts; if there are more than the capacity, subtract the next one
   from all).  The counts lost by any phrase sum to ``lost`` < threshold, so every
   phrase of at least ``least`` occurrences has count + lost >= least and survives.
2. *Exact counts.*  The survivors of a partition become a slice of a bitmap
   (``BITS`` bits each, at most ``MOST_BITS`` in all, so at most 128 MB to the driver and
   to each executor).  A second pass over the texts counts, as strings, the phrases
   that the bitmap lets pass, and drops those below ``least``: hash collisions and a
   full bitmap let more pass but change nothing.
3. *Scores.*  A candidate's cuts meet the counts of their two parts in two equi-joins;
   score = floor(1000000 a a / (l r)) in decimals.  Candidates inside a longer one that takes
   half of their occurrences are dropped; the first rows by language are found in
   three steps (by hash, by few hashes, by language), so no task sorts a whole language.

Defined cases: a null text has no words; a null language counts as ``und``; an
empty table gives an empty result; ids are not read, repeated rows count as often as they are there.  Words
of any length and pieces of any length are counted; long texts are read in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import check_columns, col

LEAST, MOST_WORDS, FIRST, ABSORB_PERCENT = 10, 3, 2000, 50
#: Words counted together in a task, bytes of text split at once, bytes of text for a hash partition.
RUN_WORDS, READ_BYTES, PARTITION_BYTES = 1_000_000, 4_000_000, 16_000_000
#: Capacity of a summary over mass / threshold; 1 is enough to lose no frequent phrase, more leaves fewer others.
CAPACITY = 4
BITS, MOST_BITS = 16, 1 << 30
#: Summaries take in packed rows until they hold this many entries, then merge.
MERGE_ENTRIES = 1_000_000
LOW_BITS = 40
SPREAD = 16
UNKNOWN = "und"

#: A-Z lower-cased, piece ends as line feeds, tabs as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str) -> Iterator[list[bytes]]:
    """Words, and a line feed at the end of each piece and of the text; long texts in parts."""
    data = text.encode().translate(FOLD)
    at = 0
    while at < len(data):
        end = min(at + READ_BYTES, len(data))
        while end < len(data) and data[end] not in b" \n":
            end += 1
        yield data[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end
    yield [b"\n"]


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_runs(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[tuple]:
    """(language, words, their hashes, stream, own): the stream has the number of each word, -1 at piece ends.

    Phrases that begin in the first ``own`` places belong to this run; the places
    behind are the beginning of the next run.
    """
    waiting: dict[str, list] = {}
    total = 0

    def run(lang, last):
        found = WordNumbers({b"\n": 0, b"": 1})
        held = waiting.pop(lang)
        stream = np.fromiter(map(found.__getitem__, held), np.int64, len(held))
        where = np.flatnonzero(stream != 1)
        stream = stream[where] - 2
        stream[stream < 0] = -1
        own = len(stream) if last else max(0, len(stream) - most_words + 1)
        if own < len(stream):
            waiting[lang] = [held[i] for i in where[own:]]
        words = list(found)[2:]
        return lang, words, np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), stream, own

    for batch in batches:
        for i in range(batch.num_rows):
            text, lang = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for part in tokens(text or ""):
                waiting.setdefault(lang, []).extend(part)
                total += len(part)
                if total > RUN_WORDS:  # of all languages: the one with the most words goes
                    most = max(waiting, key=lambda x: len(waiting[x]))
                    total -= len(waiting[most])
                    yield run(most, False)
                    total += len(waiting.get(most, ()))
    for lang in list(waiting):
        yield run(lang, True)


def phrase_keys(lang: str, hashes: np.ndarray, stream: np.ndarray, own: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the phrases of ``size`` words that begin in the run's own places."""
    n = min(own, len(stream) - size + 1)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(n, bool)
    for i in range(size):
        whole &= stream[i:i + n] >= 0
    at = np.flatnonzero(whole)
    key = np.full(len(at), xxhash.xxh64_intdigest(f"{size}:{lang}"), np.uint64)
    for i in range(size):
        key = (key * MIX_A ^ hashes[stream[at + i]]) * MIX_B
        key ^= key >> np.uint64(29)
    return at, key


def split_keys(keys: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition and low bits of a key; sorted keys have sorted partitions."""
    part = (keys >> np.uint64(LOW_BITS)) * np.uint64(partitions) >> np.uint64(64 - LOW_BITS)
    return part.astype(np.int64), keys & np.uint64((1 << LOW_BITS) - 1)


def pack(low: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Low bits in five bytes, counts in one; counts above 255 are zero there and follow by themselves."""
    large = counts > 255
    return (low.view(np.uint8).reshape(-1, 8)[:, :LOW_BITS // 8].tobytes(), np.where(large, 0, counts).astype(np.uint8).tobytes(),
            counts[large].astype(np.int64).tobytes())


def unpack(low: bytes, counts: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.zeros((len(counts), 8), np.uint8)
    raw[:, :LOW_BITS // 8] = np.frombuffer(low, np.uint8).reshape(-1, LOW_BITS // 8)
    n = np.frombuffer(counts, np.uint8).astype(np.int64)
    n[n == 0] = np.frombuffer(large, np.int64)
    return raw.view(np.uint64).ravel(), n


class MisraGries:
    """Mergeable summary of weighted keys: at most ``capacity`` counters, each below its true count by ``lost`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= MERGE_ENTRIES:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.held = [], 0
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            less = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += less
            keys, counts = keys[counts > less], counts[counts > less] - less
        self.keys, self.counts = keys, counts

    def survivors(self, least: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.lost >= least]


def _summary_rows(partitions: int, most_words: int):
    """Packed rows (part, step, mass, low, counts, large) of every run: the masses (step 0), then the counts (step 1)."""
    schema = pa.schema([("part", pa.int32()), ("step", pa.int32()), ("mass", pa.int64()), ("low", pa.binary()),
                        ("counts", pa.binary()), ("large", pa.binary())])

    def run(batches):
        for lang, _, hashes, stream, own in word_runs(batches, most_words):
            keys = np.concatenate([phrase_keys(lang, hashes, stream, own, size)[1] for size in range(1, most_words + 1)])
            keys, counts = np.unique(keys, return_counts=True)
            part, low = split_keys(keys, partitions)
            if not len(part):
                continue
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
                p = int(part[a])
                yield pa.RecordBatch.from_pylist([{"part": p, "step": 0, "mass": int(counts[a:b].sum())}, dict(zip(
                    schema.names, (p, 1, 0, *pack(low[a:b], counts[a:b])), strict=True))], schema)

    return run


def _survivor_rows(least: int):
    """Of rows sorted by (part, step): the survivors of each partition's summary."""

    def run(batches):
        part, mass, summary = None, 0, None

        def done():
            left = summary.survivors(least) if summary else np.zeros(0, np.uint64)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(left)], pa.int64()), pa.array([left.tobytes()], pa.binary())],
                                                 names=["part", "n", "low"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield from done()
                    part, mass, summary = row["part"], 0, None
                if row["step"] == 0:
                    mass += row["mass"]
                else:
                    summary = summary or MisraGries(CAPACITY * mass // least + 1)
                    summary.add(*unpack(row["low"], row["counts"], row["large"]))
        yield from done()

    return run


def survivors(texts: DataFrame, partitions: int, *, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """(part, n, low): low bits of all phrases that may occur ``least`` times; ``texts`` has a text and a language."""
    rows = texts.mapInArrow(_summary_rows(partitions, most_words), "part int, step int, mass long, low binary, counts binary, large binary")
    # The number is fixed by the data's size, so that a summary's memory is.
    owned = rows.repartition(partitions, "part").sortWithinPartitions("part", "step")
    return owned.mapInArrow(_survivor_rows(least), "part int, n long, low binary")


def survivor_bitmap(found: DataFrame, partitions: int) -> np.ndarray:
    """Bits of the survivors, partition by partition, each with a slice of the same size."""
    number = found.agg(F.sum("n")).first()[0] or 0
    size = max(64, min(MOST_BITS, BITS * number) // partitions // 64 * 64)

    def slices(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bits = np.zeros(size, bool)
                bits[(np.frombuffer(row["low"], np.uint64) % np.uint64(size)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                                 names=["part", "bits"])

    bitmap = np.zeros((partitions, size // 8), np.uint8)
    for row in found.select("part", "low").mapInArrow(slices, "part int, bits binary").toLocalIterator():
        bitmap[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def exact_counts(texts: DataFrame, found: DataFrame, partitions: int, *, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of at least ``least`` occurrences, and size 0 for all words of a language."""
    sent = texts.sparkSession.sparkContext.broadcast(survivor_bitmap(found, partitions))
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        bitmap = sent.value
        for lang, words, hashes, stream, own in word_runs(batches, most_words):
            out = [([""], [int((stream[:own] >= 0).sum())], 0)]
            for size in range(1, most_words + 1):
                at, keys = phrase_keys(lang, hashes, stream, own, size)
                part, low = split_keys(keys, partitions)
                bit = (low % np.uint64(bitmap.shape[1] * 8)).astype(np.int64)
                at = at[bitmap[part, bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
                if len(at):
                    code = stream[at]
                    for i in range(1, size):  # the number of a phrase among those seen, extended word by word
                        code = np.unique(code * len(words) + stream[at + i], return_inverse=True)[1].astype(np.int64)
                    _, first, counts = np.unique(code, return_index=True, return_counts=True)
                    texts_ = [b" ".join([words[w] for w in stream[a:a + size].tolist()]).decode() for a in at[first].tolist()]
                    out.append((texts_, counts.tolist(), size))
            for phrases, counts, size in out:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array([size] * len(phrases), pa.int32()),
                                                  pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], schema=schema)

    rows = texts.mapInArrow(run, "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def scored(counts: DataFrame, *, most_words: int = MOST_WORDS, percent: int = ABSORB_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one absorbs."""
    number = F.col("n")
    grams = counts.where("size > 0")
    words = grams.where("size > 1").select("lang", "phrase", "size", number.alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.select("lang", "phrase", "size", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("w", 1, k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("right")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "size", "a", "cut.*")
    part = grams.select("lang", F.col("phrase").alias("part"), number.alias("f"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(
        part.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    wide = {f"d{c}": F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumns(wide).withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(38,0)) * da * da) div (dl * dr)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "size", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    # Every shorter phrase inside a candidate, with the candidate's number.
    inner = words.where("size > 2").select("lang", F.col("a").alias("f"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(
            F.slice("w", i, m), " "))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "l", "r", "score")


def first_by_language(rows: DataFrame, first: int, groups: int) -> DataFrame:
    """The first rows of each language with their rank, by groups of hashes that shrink in three steps."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    many, few = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD * groups)), F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    for group in (many, few, F.lit(0)):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(F.col("rank") <= first)
    return rows


def mine_collocations(docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS, first: int = FIRST,
                      percent: int = ABSORB_PERCENT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each language."""
    check_columns(docs, text_col, lang_col)
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    texts = docs.select(col(text_col).cast("string").alias("text"), F.coalesce(col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    found = survivors(texts, partitions, least=least, most_words=most_words).checkpoint()
    counts = exact_counts(texts, found, partitions, least=least, most_words=most_words).checkpoint()
    rows = first_by_language(scored(counts, most_words=most_words, percent=percent), first, partitions)
    total = counts.where("size = 0").select("lang", "n")
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
