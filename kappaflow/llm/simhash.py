"""SimHash near-dedup with bit-sliced comparison.

1. Every whole text gets a 64-bit fingerprint of its word shingles.
2. The different fingerprints are compared in buckets.  Fingerprints within
   ``radius`` bits agree on at least one of ``radius + 1`` bit blocks, so each
   goes to one bucket per block.  A bucket with more than ``BUCKET`` members
   is dealt out again by ``radius + 1`` blocks of its remaining bits, which is
   exact by the same argument; after the last bits are spent, a bucket holds
   at most 2**rest fingerprints.
3. Inside a bucket the comparison is bit-sliced: bit planes are stored
   vertically, 64 fingerprints to a word; a query updates 64 distances at a
   time with carry-save counters, plane by plane, and a block of 64 is
   abandoned once all its distances exceed the radius.  A block whose members
   already share the query's component is skipped: it can add no link that
   changes a class.
4. A bucket emits one link per member to its local component; connected
   components over these links (alternating large and small stars) give the
   classes.

Defined cases: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; fewer words than a shingle make one
shingle of all words; rows that repeat get equal results; null ids are
carried along and never name a class unless all of its ids are null; an empty
table gives an empty result; other columns are not read by the decisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import check_columns, col, fresh, row_hash, text_of, text_slices
from .components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Members of a bucket above which it is dealt out by further blocks.
BUCKET = 20_000
#: Buckets with fewer free bits than this per block are compared as they are: at most 2**rest members.
FEWEST_BITS = 6
#: Words of a text hashed at once, and (query, block) pairs compared at once.
RUN_WORDS = 100_000
TILE = 65_536


def word_runs(data: bytes, shingle: int) -> Iterator[list[bytes]]:
    """Words in runs of bounded length; each run repeats the last ``shingle - 1`` words of the one before."""
    step = RUN_WORDS * 8
    if len(data) <= step:
        yield data.split()
        return
    at, carry = 0, []
    while at < len(data):
        end = min(at + step, len(data))
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carry + data[at:end].split()
        at = end
        if len(words) >= shingle or at >= len(data):
            yield words
            carry = words[len(words) - shingle + 1:] if shingle > 1 else []
        else:
            carry = words


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set when it is set in over half of the shingles' hashes."""
    data = text.encode().lower()  # bytes: A-Z only
    ones, total = np.zeros(64, np.int64), 0
    hash_of = xxhash.xxh64_intdigest
    for words in word_runs(data, shingle):
        n = len(words) - shingle + 1
        if n < 1:
            if total or not words:
                continue
            hashes = [hash_of(b" ".join(words), seed)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[:n - 1] + 1).tolist()]
            hashes = [hash_of(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)]
        got = np.array(hashes, np.uint64)
        total += len(got)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """id, ``text_hash`` (tells rows of one id apart) and ``fp``, the fingerprint as a signed long, for every row."""
    check_columns(docs, id_col, text_col)
    text = "text"
    source = docs.select(col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), col(text_col).cast("string").alias(text))
    out_schema = T.StructType([*source.schema.fields[:2], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch, texts in text_slices(batches, text):
            found = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=out_schema.names)

    return source.mapInArrow(run, out_schema)


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    size, more = divmod(len(bits), parts)
    cut = [0]
    for i in range(parts):
        cut.append(cut[-1] + size + (i < more))
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def near_lanes(fps: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (a, b) within ``radius`` bits, bucket by bucket, in bounded tiles.

    ``fps`` holds the members of many buckets one after the other; bucket i has
    ``size[i]`` members from ``first[i]`` on.  After each tile the caller may
    send back component numbers of all members; pairs that they make needless
    are then left out.
    """
    counters = max(1, radius.bit_length())
    blocks = -(-size // 64)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    # Lanes: each bucket is padded to whole words of 64 fingerprints.
    bucket = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(fps)) - first[bucket]
    lane = block_first[bucket] * 64 + place
    lanes = np.zeros(block_first[-1] * 64, np.uint64)
    lanes[lane] = fps
    member = np.full(len(lanes), -1, np.int64)
    member[lane] = np.arange(len(fps))
    planes = np.empty((64, block_first[-1]), np.uint64)
    for p in range(64):
        bits = ((lanes >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        planes[p] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    used = np.packbits((member >= 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    grid = member.reshape(-1, 64)
    component = np.arange(len(fps))
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    # A query meets its own block and the later ones of its bucket: each pair once (twice inside a block).
    own = lane // 64
    rest = block_first[bucket + 1] - own
    upto = np.concatenate([[0], np.cumsum(rest)])
    start = 0
    while start < len(fps):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + TILE, "right")) - 1)
        ask = np.repeat(np.arange(start, stop), rest[start:stop])
        word = own[ask] + np.arange(len(ask)) - np.repeat(upto[start:stop] - upto[start], rest[start:stop])
        start = stop
        # Blocks that are wholly in the query's component can add nothing.
        padded = np.where(grid >= 0, component[grid], -1) if len(grid) < TILE else None
        if padded is not None:
            low = np.where(grid >= 0, padded, np.iinfo(np.int64).max).min(1)
            useful = (low[word] != component[ask]) | (padded.max(1)[word] != component[ask])
            ask, word = ask[useful], word[useful]
        if not len(ask):
            continue
        sums = [np.zeros(len(ask), np.uint64) for _ in range(counters)]
        over = ~used[word]
        for p in range(64):
            flip = np.where((fps[ask] >> np.uint64(p)) & np.uint64(1), every, np.uint64(0))
            carry = planes[p][word] ^ flip
            for k in range(counters):  # carry-save: add one bit to 64 counters
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            over |= carry
            if p % 8 == 7:
                gone = over.copy()
                # A counter above the radius: compare the sliced number with it, highest bit first.
                more, same = np.zeros_like(over), np.full_like(over, every)
                for k in reversed(range(counters)):
                    if radius >> k & 1:
                        same &= sums[k]
                    else:
                        more |= same & sums[k]
                        same &= ~sums[k]
                gone |= more
                live = gone != every
                if not live.all():
                    ask, word, over = ask[live], word[live], over[live]
                    sums = [s[live] for s in sums]
                    gone = gone[live]
                if not len(ask):
                    break
        if not len(ask):
            continue
        near = np.unpackbits((~gone).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        entry, bit = np.nonzero(near)
        a, b = ask[entry], grid[word[entry], bit]
        apart = a != b
        sent = yield a[apart], b[apart]
        if sent is not None:
            component = sent


def local_links(fps: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) places: every member that is linked in its bucket with its component's first member."""
    component = np.arange(len(fps))
    pairs = near_lanes(fps, first, size, radius)
    try:
        a, b = next(pairs)
        while True:
            while True:
                x, y = component[a], component[b]
                apart = x != y
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                x, y = x[apart], y[apart]
                np.minimum.at(component, np.maximum(x, y), np.minimum(x, y))
                while (component != component[component]).any():
                    component = component[component]
            a, b = pairs.send(component)
    except StopIteration:
        pass
    member = np.flatnonzero(component != np.arange(len(fps)))
    return member, component[member]


def _bucket_links(radius: int):
    """Arrow function over rows sorted by bucket: links of each bucket, many small buckets at a time."""

    def links(keys, fps):
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([cut, [len(keys)]]))
        many = size > 1
        if not many.any():
            return None
        member = np.repeat(many, size)
        fps, size = fps[member], size[many]
        first = np.concatenate([[0], np.cumsum(size[:-1])])
        a, b = local_links(fps, first, size, radius)
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["u", "v"])

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            done = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and (keys != keys[-1]).any() else 0
            if done:  # the last bucket may go on in the next batch
                out = links(keys[:done], fps[:done])
                if out:
                    yield out
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            out = links(keys, fps)
            if out:
                yield out

    return run


def near_links(prints: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between different fingerprints that connect all that are within ``radius`` bits.

    ``prints`` has one distinct long column ``fp``.  A bucket's key is a hash of
    its block's number and bits; should two buckets share a key, they are
    compared together, which finds the same links.
    """
    spark = prints.sparkSession
    if radius == 0:
        return spark.createDataFrame([], "u long, v long")
    work = prints.select("fp")
    jobs: list[tuple[DataFrame, list[int], int]] = [(work, list(range(64)), 0)]
    found: DataFrame | None = None
    while jobs:
        work, bits, salt = jobs.pop()
        parts = [b for b in _blocks(bits, radius + 1) if b]
        dealt = work.select(*[c for c in work.columns if c != "key"], F.explode(F.array(*[
            F.struct(F.lit(i).alias("block"), F.xxhash64(*([F.col("key")] if "key" in work.columns else []), F.lit(salt + i),
                     F.col("fp").bitwiseAND(F.lit(_mask(b)))).alias("key")) for i, b in enumerate(parts)])).alias("at"))
        dealt = dealt.select("fp", "at.block", "at.key")
        hot = dealt.groupBy("key", "block").count().where(F.col("count") > bucket).select("key", "block").checkpoint()
        crowded = {r["block"] for r in hot.select("block").distinct().collect()}  # at most radius + 1 rows
        deeper = {i for i in crowded if (len(bits) - len(parts[i])) // (radius + 1) >= FEWEST_BITS}
        if deeper:
            deep = hot.where(F.col("block").isin(*deeper))
            flat = dealt.join(deep, ["key", "block"], "left_anti")
            for i in sorted(deeper):
                again = dealt.where(F.col("block") == i).join(deep.where(F.col("block") == i).select("key"), "key", "left_semi")
                jobs.append((again.select("fp", "key"), [b for b in bits if b not in parts[i]], salt * 8 + (i + 1) * 1000))
        else:
            flat = dealt
        links = (flat.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
                 .mapInArrow(_bucket_links(radius), "u long, v long"))
        found = links if found is None else found.union(links)
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE,
                 radius: int = RADIUS, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """id, text_hash, fp and class (smallest id reachable by links of at most ``radius`` bits), for every row.

    ``first_hash`` is the text hash of the row that names the class: the one with the least (id, text hash), null ids last.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, shingle=shingle, seed=seed).checkpoint()
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    prints = rows.groupBy("fp").agg(F.min(first).alias("first")).checkpoint()
    parts = connected_components(near_links(prints.select("fp"), radius=radius, bucket=bucket))
    labelled = (prints.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
                .select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = labelled.groupBy("component").agg(F.min("first").alias("first"))
    by_print = labelled.drop("first").join(least, "component").select("fp", "first")
    return rows.join(by_print, "fp").select(F.col("id").alias(id_col), "text_hash", "fp", F.col("first.id").alias("class"),
                                            F.col("first.text_hash").alias("first_hash"))


def hex_print(fp) -> F.col:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class with all its columns: the one with the least (id, text hash, row hash), null ids last.

    Whatever rows repeat, of every class exactly one stays.
    """
    classes = near_classes(docs, id_col, text_col, **how)
    id_, hash_, row, rank = fresh(docs, "id", "hash", "row", "rank")
    found = F.col(classes.columns[0])
    # Ids as text, null apart, so that join and window are dealt out by the same columns.
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    stay = (classes.where(found.eqNullSafe(F.col("class")) & (F.col("text_hash") == F.col("first_hash")))
            .select(named(found).alias(id_), F.col("text_hash").alias(hash_)).distinct())
    keyed = docs.select("*", named(col(id_col)).alias(id_), F.xxhash64(text_of(text_col)).alias(hash_), row_hash(docs).alias(row))
    one = F.row_number().over(Window.partitionBy(id_, hash_).orderBy(row))
    return keyed.join(stay, [id_, hash_], "left_semi").withColumn(rank, one).where(col(rank) == 1).select(*[col(c) for c in docs.columns])
