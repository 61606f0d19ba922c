"""Best-fit packing of documents into sequences of a fixed number of tokens.

1. Every whole text is encoded (the tokenizers library on its words, which
   each task keeps; the pre-tokenizer drops white space, so a text's ids are
   those of its words one after the other), followed by the separator id.  Texts
   longer than ``capacity`` are cut into pieces; only lengths and checksums move on.
2. Range sort: pieces are dealt out by (length, hash) ranges, a hot length over
   many ranges, and get their place in the range.  Pieces of one length in one
   range are a *run*, an interval of places; sequences of equal free room with
   consecutive numbers are runs as well.  A run is one row whatever it holds, so
   the rounds below work on ranges + ``capacity`` rows at first, and not on rows
   of documents.
3. Bulk-synchronous rounds.  Runs of documents and of gaps are dealt out by ranges of their
   size, descending.  Every range is sorted and swept by its own task: each document takes
   the smallest gap that holds it (its successor).  Where several documents want
   the same gaps, ranks decide: the first ranks of the run of documents take the
   first ranks of the run of gaps, as many of a length in one gap as fit.  What a
   range could not match meets the leftover gaps of the larger ranges, ``FAN``
   ranges at a time, up a tree.  Then gaps are updated and the next round begins.
4. When no document fits any gap, the largest documents open new sequences: all
   above half of the capacity, and at least ``OPEN_SHARE`` of the number that the
   remaining tokens fill.
5. Rules (interval of places -> sequences and offsets) go back to the pieces by
   (range, block of places).

Defined cases: a null text counts as empty and has the separator only; repeated
rows and rows with equal or null ids are packed one by one; an empty table gives
an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import ensure_checkpoint_dir
from .bpe import read_tokenizer
from .common import check_columns, col, fresh, text_slices

CAPACITY = 4096
SEPARATOR = 1
#: Share of the sequences that the remaining tokens would fill which are opened at once.
OPEN_SHARE = 0.9
#: Rows (runs) that one task sweeps, and ranges whose leftovers meet in one task.
SWEEP_ROWS, FAN = 4096, 8
#: Places in a range that are looked up together at the end.
BLOCK_BITS = 12
#: Words that a worker keeps (in each of two generations), if they are no longer than this many bytes; text read at once.
KEEP_WORDS, LONG_WORD, READ_BYTES = 700_000, 64, 4_000_000
LAST_SIGN = re.compile(rb"(?<=[A-Za-z])([.,;:!?])(?=[ \n])")
GAP, DOC, RULE = 0, 1, 2
RUNS = "kind int, size int, n long, a long, b long, bin long, per int, part long"


class WordEncoder:
    """Ids of texts as 32-bit little-endian bytes; equal to the library's on the whole text.

    Solved words are kept in two generations, so that memory is bounded and
    what is met again stays; words not met before go to the library together.
    """

    def __init__(self, spec_json: str):
        self.tokenizer = Tokenizer.from_str(spec_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.by_word = drops_white_space(spec_json)
        self.lowers = lower_cases(spec_json)

    def words(self, text: str) -> list[bytes]:
        """Parts between ASCII white space (other white space stays in them).

        A sign between a letter and white space is a piece of its own for the pre-tokenizer,
        so it is set apart.  Where the normalizer lower-cases, A-Z are lower-cased here if that can
        change neither the canonical composition nor a special token.
        """
        data = text.encode()
        if self.lowers and b"<|" not in data:
            low = data.lower()  # A-Z only
            if text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low.decode()):
                data = low
        return LAST_SIGN.sub(rb" \1", data).split()

    def ids(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        if len(self.known) > KEEP_WORDS:
            self.old, self.known = self.known, {}
            found = [None] * len(words)
        open_ = {w for w, x in zip(words, found, strict=True) if x is None}
        new = {w: x for w in open_ if (x := self.old.get(w)) is not None}
        missing = sorted(open_ - new.keys())
        solved = self.tokenizer.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)
        new.update((w, array("I", e.ids).tobytes()) for w, e in zip(missing, solved, strict=True))
        self.known.update((w, x) for w, x in new.items() if len(w) <= LONG_WORD)
        return [new[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids of a text in parts of bounded size."""
        if not self.by_word:
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return
        data = text.encode()
        at = 0
        while at < len(data):
            end = min(at + READ_BYTES, len(data))
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            yield b"".join(self.ids(self.words(data[at:end].decode())))
            at = end

    def all(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """Ids of each text in parts; the words of short texts are looked up together."""
        if not self.by_word or len(texts) == 1:
            yield from map(self.parts, texts)
            return
        words = [self.words(t) for t in texts]
        found = self.ids([w for part in words for w in part])
        at = 0
        for part in words:
            yield iter([b"".join(found[at:at + len(part)])])
            at += len(part)


def drops_white_space(spec_json: str) -> bool:
    """Whether the pre-tokenizer keeps only matches of a pattern that never holds white space."""
    spec = json.loads(spec_json)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex")
    if (first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True) or not pattern:
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])):
        return False
    probe = " a \t'\n1 \r. 's  'x\x0b\x0ć é 'll 22 ,,  "
    return not any(c.isspace() for m in regex.finditer(pattern, probe) for c in m.group())


def lower_cases(spec_json: str) -> bool:
    """Whether the normalizer composes, unifies white space and then lower-cases, and special tokens stand in <| |>."""
    spec = json.loads(spec_json)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))


@lru_cache(maxsize=2)
def word_encoder(spec_json: str) -> WordEncoder:
    return WordEncoder(spec_json)


def cut_pieces(parts: Iterator[bytes], capacity: int, separator: int) -> Iterator[bytes]:
    """The ids of a document and its separator in pieces of ``capacity`` ids."""
    held, size = b"", capacity * 4
    for part in parts:
        held += part
        full = len(held) // size * size
        for at in range(0, full, size):
            yield held[at:at + size]
        held = held[full:]
    held += separator.to_bytes(4, "little")
    yield held


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, separator: int = SEPARATOR,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (of little-endian 32-bit ids) of every piece, and with ``with_ids`` its ids."""
    check_columns(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # the size of the vocabulary
    (text,) = fresh(docs, "text")
    source = docs.select(col(id_col), col(text_col).cast("string").alias(text))
    more = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []
    schema = T.StructType([source.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *more])

    def run(batches):
        encoder = word_encoder(spec.value)
        for batch, texts in text_slices(batches, text):
            rows, piece, length, crc, ids = [], [], [], [], []
            for i, t in enumerate(encoder.all(texts)):
                for k, data in enumerate(cut_pieces(t, capacity, separator)):
                    rows.append(i)
                    piece.append(k)
                    length.append(len(data) // 4)
                    crc.append(zlib.crc32(data))
                    if with_ids:
                        ids.append(np.frombuffer(data, "<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()),
                       pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def sweep(rows: list[tuple]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Match runs of documents to runs of gaps, largest first; each document takes the smallest gap that holds it.

    Rows are (kind, size, n, a, b): for a gap a is its first sequence, for a
    document a is the range and b the first place.  Returns rules (size, n, a, b,
    bin, per, offset room), rows left over, and gaps as they are after the round.
    """
    stack, rules, left, new = [], [], [], []
    for kind, size, n, a, b in sorted(rows, key=lambda r: (-r[1], r[0], r[3], r[4])):
        if kind == GAP:
            stack.append([size, n, a])
            continue
        while n and stack:
            room, bins, first = stack[-1]
            per = room // size
            used = min(bins, -(-n // per))
            placed = min(n, used * per)
            full, rest = divmod(placed, per)
            rules.append((room, placed, a, b, first, per, size))
            if full and room > per * size:
                new.append((GAP, room - per * size, full, first, 0))
            if rest and room > rest * size:
                new.append((GAP, room - rest * size, 1, first + full, 0))
            n, b = n - placed, b + placed
            if bins > used:
                stack[-1][1:] = [bins - used, first + used]
            else:
                stack.pop()
        if n:
            left.append((DOC, size, n, a, b))
    return rules, left + [(GAP, s, n, a, 0) for s, n, a in stack], new


def _sweep_range(table: pa.Table) -> pa.Table:
    """One sweep over the runs of a range; gaps made in this round wait for the next one (part -1)."""
    rows = [tuple(r.values()) for r in table.to_pylist()]
    rules, left, new = sweep([r[:5] for r in rows])
    out = [*[(RULE, s, n, a, b, bin_, per, room) for room, n, a, b, bin_, per, s in rules],
           *[(*r, 0, 0, rows[0][7]) for r in left], *[(*r, 0, 0, -1) for r in new]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["kind", "size", "n", "a", "b", "bin", "per", "part"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def sweep_round(runs: DataFrame, cuts: list[int]) -> DataFrame:
    """One round: ranges of sizes (``cuts``, descending), each swept by a task, then the leftovers of ``FAN``
    neighbours, up the tree.  A range is a number in the rows, whatever partitions Spark makes."""
    part = sum((F.when(F.col("size") < c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")
    out = runs.withColumn("part", part).groupBy("part").applyInArrow(_sweep_range, RUNS)
    parts = len(cuts) + 1
    while parts > 1:
        parts = -(-parts // FAN)
        done = out.where((F.col("kind") == RULE) | (F.col("part") < 0))
        open_ = out.where((F.col("kind") != RULE) & (F.col("part") >= 0)).withColumn("part", F.floor(F.col("part") / FAN))
        out = open_.groupBy("part").applyInArrow(_sweep_range, RUNS).unionByName(done)
    return out


def range_cuts(state: DataFrame, rows: int) -> list[int]:
    """Sizes, descending, that cut the runs into ranges of about ``SWEEP_ROWS`` rows."""
    parts = -(-rows // SWEEP_ROWS)
    if parts < 2:
        return []
    found = state.agg(F.percentile_approx("size", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(found), reverse=True)


def open_sequences(runs: DataFrame, docs: dict[int, int], capacity: int) -> DataFrame:
    """Runs after the largest documents (``docs``: number by length) have opened sequences of their own.

    A sequence's number is the place of the document that opens it, so nothing is counted across tasks.
    """
    mass = sum(size * n for size, n in docs.items())
    number = max(sum(n for size, n in docs.items() if 2 * size > capacity), -int(-mass * OPEN_SHARE // capacity), 1)
    least, some = 0, 0  # all documents longer than ``least`` open one, and ``some`` of that length
    for size in sorted(docs, reverse=True):
        least, some = size, min(number, docs[size])
        number -= some
        if not number:
            break
    last = Window.partitionBy("size").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_doc = F.col("kind") == DOC
    at = runs.where(is_doc & (F.col("size") == least)).withColumn("upto", F.sum("n").over(last))
    at = at.withColumn("opens", F.greatest(F.lit(0), F.least(F.col("n"), F.col("n") - F.col("upto") + some)))
    above = runs.where(is_doc & (F.col("size") > least)).withColumn("upto", F.lit(0).cast("long")).withColumn("opens", F.col("n"))
    seeds = above.unionByName(at)
    first = F.shiftleft(F.col("a"), 33) + F.col("b")
    zero = F.lit(0).cast("long")
    rows = F.array(
        F.struct(F.lit(RULE).alias("kind"), "size", F.col("opens").alias("n"), "a", "b", first.alias("bin"), F.lit(1).alias("per"),
                 F.lit(capacity).cast("long").alias("part")),
        F.struct(F.lit(GAP).alias("kind"), (F.lit(capacity) - F.col("size")).alias("size"), F.col("opens").alias("n"), first.alias("a"),
                 zero.alias("b"), zero.alias("bin"), F.lit(0).alias("per"), zero.alias("part")),
        F.struct(F.lit(DOC).alias("kind"), "size", (F.col("n") - F.col("opens")).alias("n"), "a", (F.col("b") + F.col("opens")).alias("b"),
                 zero.alias("bin"), F.lit(0).alias("per"), zero.alias("part")))
    opened = seeds.select(F.inline(F.filter(rows, lambda r: (r["n"] > 0) & (r["size"] > 0))))
    return opened.unionByName(runs.where(~is_doc | (F.col("size") < least)))


def pack_runs(runs: DataFrame, capacity: int) -> DataFrame:
    """Rules for all runs of documents; every round's rows are checkpointed, the driver sees sums by length only."""
    rules = None
    state = runs
    while True:
        seen = state.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.min("size").alias("least"), F.max("size").alias("most")).collect()
        by = {r["kind"]: r for r in seen}
        if DOC not in by:
            break
        if GAP in by and by[GAP]["most"] >= by[DOC]["least"]:
            # Gaps below every document stay as they are.
            out = sweep_round(state, range_cuts(state, sum(r["rows"] for r in seen)))
        else:
            docs = {r["size"]: r["n"] for r in state.where(F.col("kind") == DOC).groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
            out = open_sequences(state, docs, capacity)
        out = out.checkpoint()
        made = out.where(F.col("kind") == RULE)
        rules = made if rules is None else rules.unionByName(made)
        state = out.where(F.col("kind") != RULE)
    return rules


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, separator: int = SEPARATOR,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    ensure_checkpoint_dir(docs.sparkSession)
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, separator=separator, id_col=id_col, text_col=text_col)
    pieces = pieces.checkpoint()  # the range sort reads them twice
    names = [f"c{i}" for i in range(len(pieces.columns))]
    dealt = pieces.toDF(*names).withColumn("h", F.xxhash64("c0", "c1", "c4")).repartitionByRange("c3", "h")
    placed = dealt.sortWithinPartitions("c3", "h", "c0", "c1").select(*names, F.monotonically_increasing_id().alias("at")).checkpoint()
    # The number has the range above 33 bits and the place in it below.
    placed = placed.withColumn("a", F.shiftright("at", 33)).withColumn("b", F.col("at").bitwiseAND((1 << 33) - 1))
    runs = placed.groupBy("a", F.col("c3").cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    zero = F.lit(0).cast("long")
    runs = runs.select(F.lit(DOC).alias("kind"), "size", "n", "a", "b", zero.alias("bin"), F.lit(0).alias("per"), zero.alias("part")).checkpoint()
    rules = pack_runs(runs, capacity)
    out_names = [id_col, "piece", "start", "length", "ids_crc32"]
    if rules is None:
        return placed.select(*[F.col(n).alias(o) for n, o in zip(names, out_names, strict=True)], zero.alias("sequence_id"), zero.alias("offset"))
    block = F.shiftright("b", BLOCK_BITS)
    by_block = rules.select("a", "b", F.struct("b", "bin", "per", "size", (F.lit(capacity) - F.col("part")).alias("off")).alias("rule"),
                            F.explode(F.sequence(block, F.shiftright(F.col("b") + F.col("n") - 1, BLOCK_BITS))).alias("block"))
    by_block = by_block.withColumn("b", F.greatest("b", F.shiftleft("block", BLOCK_BITS))).withColumn("is_piece", F.lit(0))
    asked = placed.withColumn("block", block).withColumn("is_piece", F.lit(1))
    before = Window.partitionBy("a", "block").orderBy("b", "is_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (asked.unionByName(by_block, allowMissingColumns=True).withColumn("rule", F.last("rule", ignorenulls=True).over(before))
             .where("is_piece = 1"))
    rank = F.col("b") - F.col("rule.b")
    return found.select(*[F.col(n).alias(o) for n, o in zip(names, out_names, strict=True)],
                        (F.col("rule.bin") + F.floor(rank / F.col("rule.per"))).cast("long").alias("sequence_id"),
                        (F.col("rule.off") + rank % F.col("rule.per") * F.col("rule.size")).cast("long").alias("offset"))


def packed_sequences(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, separator: int = SEPARATOR,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and its ``ids``, at most ``capacity`` of them, in the order of their offsets.

    Pieces are told apart by id, number and checksum; the ids of a sequence are all that one group holds.
    """
    how = {"capacity": capacity, "separator": separator, "id_col": id_col, "text_col": text_col}
    key, order = ["id", "piece", "ids_crc32"], Window.partitionBy("id", "piece", "ids_crc32", "length")
    places = pack_documents(docs, tokenizer_path, **how).withColumnRenamed(id_col, "id")
    pieces = token_pieces(docs, tokenizer_path, with_ids=True, **how).withColumnRenamed(id_col, "id")
    places = places.withColumn("copy", F.row_number().over(order.orderBy("sequence_id", "offset"))).drop("start", "length")
    pieces = pieces.withColumn("copy", F.row_number().over(order.orderBy("start"))).drop("start", "length")
    same = [places[k].eqNullSafe(pieces[k]) for k in [*key, "copy"]]
    joined = places.join(pieces, same).select("sequence_id", "offset", "ids")
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
