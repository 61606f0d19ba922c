"""Ranked lexical search with per-term geometric blocking.

1. The items' terms are the only ones that scores read.  One pass over the whole
   texts gives every document its number of terms and a sparse vector (term,
   occurrences) over them; a second over the vectors counts documents by term.
2. Every task cuts its vectors into shards of bounded size and builds an index
   of each: a posting list for each term, cut into blocks of documents that are alike
   (nearest of evenly spaced members of the list, by the cosine of random
   projections of the impact vectors), and for each block its summary, the largest impact
   of every term over the block's documents.
3. An item's score of a block's summary bounds the scores of all its documents.
   Blocks are scored exactly from the highest bound down; a block is skipped
   only when its bound is below the tenth best score so far, so results are exact.
4. The tasks' best rows by item are merged.

A block of items is sent to the tasks with its vocabulary: at most about ``ITEM_BYTES``
of item texts at a time; more items are worked off block by block.

Defined cases: null and empty texts have no terms and are never returned; an item without
known terms has no rows; repeated documents and items are ranked row by row; equal
scores rank by ascending id, null ids last; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import check_columns, col, text_slices

BEST = 10
#: Bytes of item texts whose vocabulary is sent to the tasks at once.
ITEM_BYTES = 4_000_000
#: Documents and vector entries of a shard; documents of a block; entries of the summary buffer.
SHARD_DOCS, SHARD_ENTRIES, BLOCK, BUFFER = 4096, 300_000, 64, 2_000_000
#: Vector entries expanded at once while summaries are built.
EXPAND = 1_000_000
DIMENSIONS = 32
#: Bytes of text split at once.
READ_BYTES = 4_000_000
#: A-Z lower-cased; ASCII characters that are no letter or digit separate terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str):
    """The terms of a text, in parts of bounded size."""
    data = text.encode().translate(FOLD)
    at = 0
    while at < len(data):
        end = min(at + READ_BYTES, len(data))
        while end < len(data) and data[end] != 32:
            end += 1
        yield data[at:end].split()
        at = end


def term_vectors(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the text), terms and tf (packed 32-bit integers, by ascending term) of every text with a term."""
    source = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema[0], T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()),
                           T.StructField("tf", T.BinaryType())])

    def run(batches):
        number = vocabulary.value.get
        for batch, texts in text_slices(batches, "text"):
            rows, size, ids, tfs = [], [], [], []
            for i, text in enumerate(texts):
                n, found = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    found.update(map(number, part))
                if n:
                    found.pop(None, None)
                    known = np.array(sorted(found.items()), np.int32).reshape(-1, 2)
                    rows.append(i)
                    size.append(n)
                    ids.append(known[:, 0].tobytes())
                    tfs.append(known[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(size, pa.int64()),
                                              pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def corpus_counts(vectors: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all of them, and documents by term of the vocabulary."""

    def run(batches):
        docs, total, df = 0, 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            docs += batch.num_rows
            total += pa.compute.sum(batch.column(0)).as_py() or 0
            for packed in batch.column(1).to_pylist():
                df[np.frombuffer(packed, np.int32)] += 1
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *there.tolist()], pa.int32()), pa.array([docs, total, *df[there].tolist()], pa.int64())],
                                         names=["term", "n"])

    rows = vectors.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(n_terms, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-2, 0), found.get(-1, 0), df


class Shard:
    """Index of some documents: vectors, posting lists in blocks, and the blocks' summaries.

    Terms are numbered as the shard has them (``local``); numbers and impacts are 32-bit.
    """

    def __init__(self, ids: pa.Array, first: np.ndarray, term: np.ndarray, impact: np.ndarray, weight: np.ndarray):
        self.ids, self.first, self.size = ids, first, np.diff(first)
        self.local, number = np.unique(term, return_inverse=True)
        self.term, self.impact = number.astype(np.int32), impact.astype(np.int32)
        # Rank of the ids, null last: ties in score go by it.
        self.id_rank = np.empty(len(ids), np.int64)
        self.id_rank[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        block = self.blocks(weight[self.local])
        self.summaries(block)

    def places(self, weight: np.ndarray) -> np.ndarray:
        """Random projections of the impact vectors, by the terms' numbers, as directions."""
        signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (len(self.local), DIMENSIONS))
        out, full = np.zeros((len(self.size), DIMENSIONS), np.float32), np.flatnonzero(self.size)
        for a in range(0, len(full), 256):
            docs = full[a:a + 256]
            lo, hi = self.first[docs[0]], self.first[docs[-1] + 1]
            value = (self.impact[lo:hi] * weight[self.term[lo:hi]]).astype(np.float32)
            out[docs] = np.add.reduceat(signs[self.term[lo:hi]] * value[:, None], self.first[docs] - lo, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def blocks(self, weight: np.ndarray) -> np.ndarray:
        """Cut every posting list: documents of block b are ``members`` from ``at[b]`` on; a term's blocks are ``of_term``."""
        place = self.places(weight)
        order = np.argsort(self.term, kind="stable")
        members = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[order]
        cut = np.searchsorted(self.term[order], np.arange(len(self.local) + 1))
        label, parts = np.zeros(len(members), np.int32), np.ones(len(self.local), np.int64)
        for t in np.flatnonzero(np.diff(cut) > BLOCK).tolist():  # shorter lists are one block
            a, b = cut[t], cut[t + 1]
            docs, n = members[a:b], -(-(b - a) // BLOCK)
            middle = place[docs[np.arange(n) * (b - a) // n]]
            own = np.unique((place[docs] @ middle.T).argmax(1), return_inverse=True)[1]
            by = np.argsort(own, kind="stable")
            members[a:b], label[a:b] = docs[by], own[by]
            parts[t] = own.max() + 1
        self.of_term = np.concatenate([[0], np.cumsum(parts)])
        block = np.repeat(self.of_term[:-1], np.diff(cut)) + label
        self.members, self.n_blocks = members, int(self.of_term[-1])
        self.at = np.searchsorted(block, np.arange(self.n_blocks + 1))
        return block

    def summaries(self, block: np.ndarray) -> None:
        """Largest impact of each term in each block, by term: ``sum_block`` and ``sum_most`` from ``sum_first[term]`` on."""
        width, out, b = max(1, len(self.local)), [], 0
        grows = np.concatenate([[0], np.cumsum(self.size[self.members])])
        while b < self.n_blocks:
            upto = min(self.n_blocks, b + max(1, BUFFER // width))
            upto = max(b + 1, min(upto, int(np.searchsorted(grows[self.at], grows[self.at[b]] + EXPAND, "right")) - 1))
            buffer = np.zeros((upto - b) * width, np.int32)
            a, end = self.at[b], self.at[upto]
            while a < end:  # a block may hold many documents
                z = min(end, max(a + 1, int(np.searchsorted(grows, grows[a] + EXPAND, "right")) - 1))
                docs = self.members[a:z]
                where = ragged(self.first[docs], self.size[docs])
                np.maximum.at(buffer, np.repeat((block[a:z] - b) * width, self.size[docs]) + self.term[where], self.impact[where])
                a = z
            there = np.flatnonzero(buffer)
            out.append(((there % width).astype(np.int32), (there // width + b).astype(np.int32), buffer[there]))
            b = upto
        term, block_, most = (np.concatenate(x) if out else np.zeros(0, np.int32) for x in (zip(*out, strict=True) if out else ([], [], [])))
        order = np.argsort(term, kind="stable")
        self.sum_block, self.sum_most = block_[order], most[order]
        self.sum_first = np.searchsorted(term[order], np.arange(len(self.local) + 1))

    def bounds(self, item_terms: np.ndarray, item_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks of the item's posting lists, bounds of their scores), highest bound first."""
        bound = np.zeros(self.n_blocks, np.int64)
        for t, w in zip(item_terms.tolist(), item_weights.tolist(), strict=True):
            lo, hi = self.sum_first[t], self.sum_first[t + 1]
            bound[self.sum_block[lo:hi]] += w * self.sum_most[lo:hi].astype(np.int64)
        own = ragged(self.of_term[item_terms], self.of_term[item_terms + 1] - self.of_term[item_terms])
        own = own[np.argsort(-bound[own], kind="stable")]
        return own, bound[own]

    def scores(self, docs: np.ndarray, by_term: np.ndarray) -> np.ndarray:
        where = ragged(self.first[docs], self.size[docs])
        value = by_term[self.term[where]] * self.impact[where]
        return np.add.reduceat(value, np.cumsum(self.size[docs]) - self.size[docs])

    def search(self, item_terms: np.ndarray, item_weights: np.ndarray, best: int, least: int) -> tuple[list[tuple], int]:
        """Up to ``best`` rows (-score, id is null, id) with a score of ``least`` at least, and the number of documents scored."""
        if not len(self.local):
            return [], 0
        local = np.minimum(np.searchsorted(self.local, item_terms), len(self.local) - 1)
        known = self.local[local] == item_terms
        item_terms, item_weights = local[known], item_weights[known]
        blocks, bound = self.bounds(item_terms, item_weights)
        by_term = np.zeros(len(self.local), np.int64)
        by_term[item_terms] = item_weights
        seen = np.zeros(len(self.size), bool)
        docs_, scores_, start, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 8
        # Bounds descend: the first one below the threshold ends the search.
        while start < len(blocks) and bound[start] >= least:
            stop = start + max(1, int(np.searchsorted(-bound[start:start + step], -least, "right")))
            docs = self.members[ragged(self.at[blocks[start:stop]], self.at[blocks[start:stop] + 1] - self.at[blocks[start:stop]])]
            docs = np.unique(docs[~seen[docs]])
            seen[docs] = True
            start, step = stop, step * 2
            if len(docs):
                scores = self.scores(docs, by_term)
                good = scores >= least
                docs_, scores_ = np.concatenate([docs_, docs[good]]), np.concatenate([scores_, scores[good]])
                if len(docs_) >= best:
                    first = np.lexsort((self.id_rank[docs_], -scores_))[:best]
                    docs_, scores_ = docs_[first], scores_[first]
                    least = max(least, int(scores_[-1]))
        return [(-s, self.ids[d].as_py() is None, self.ids[d].as_py()) for d, s in zip(docs_.tolist(), scores_.tolist(), strict=True)], int(seen.sum())


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... (size[i] of them) for every i, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _search_vectors(vectors: DataFrame, items, weights, best: int, id_type: T.DataType) -> DataFrame:
    """item (its number), score and id of the best rows of every task."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("id", id_type)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        (n_docs, total, weight), queries = weights.value, items.value
        top: list[list[tuple]] = [[] for _ in queries]

        def shard(parts):
            ids = pa.chunked_array([p[0] for p in parts]).combine_chunks()
            n = np.concatenate([p[1] for p in parts])
            packed = [x for p in parts for x in zip(p[2], p[3], strict=True)]
            size = np.array([len(t) // 4 for t, _ in packed], np.int64)
            term = np.frombuffer(b"".join(t for t, _ in packed), np.int32).astype(np.int64)
            tf = np.frombuffer(b"".join(f for _, f in packed), np.int32).astype(np.int64)
            length = np.array([25 + 75 * x * n_docs // total for x in n.tolist()], np.int64)  # exact whatever the size
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(length, size))
            index = Shard(ids, np.concatenate([[0], np.cumsum(size)]), term, impact, weight)
            for i, (item_terms, item_tf) in enumerate(queries):
                least = max(1, -top[i][-1][0]) if len(top[i]) == best else 1
                found, _ = index.search(item_terms, item_tf * weight[item_terms], best, least)
                if found:
                    top[i] = heapq.nsmallest(best, top[i] + found)

        held, docs, entries = [], 0, 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(2)).to_numpy() // 4
            start = 0
            while start < batch.num_rows:
                room = np.cumsum(sizes[start:]) <= SHARD_ENTRIES - entries
                stop = min(batch.num_rows, start + SHARD_DOCS - docs, start + max(int(room.sum()), 0 if docs else 1))
                part = batch.slice(start, stop - start)
                if part.num_rows:
                    held.append((part.column(0), part.column(1).to_numpy(), part.column(2).to_pylist(), part.column(3).to_pylist()))
                    docs, entries = docs + part.num_rows, entries + int(sizes[start:stop].sum())
                start = stop
                if docs and start < batch.num_rows:
                    shard(held)
                    held, docs, entries = [], 0, 0
        if held:
            shard(held)
        rows = [(i, -s, d) for i, found in enumerate(top) for s, _, d in found]
        kinds = [pa.int32(), pa.int64(), to_arrow_type(id_type)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, *, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, id, score of the ``best`` documents of every item, over all documents."""
    check_columns(docs, id_col, text_col)
    check_columns(items, item_col, item_text)
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    asked = items.select(col(item_col).alias("item"), F.coalesce(col(item_text).cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // ITEM_BYTES + 1
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    out = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()  # about ITEM_BYTES of text
        counted = [Counter(t for some in terms(r["text"]) for t in some) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        queries = [(np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counted]
        vectors = term_vectors(docs, sc.broadcast(vocabulary), id_col, text_col).checkpoint()
        n_docs, total, df = corpus_counts(vectors, len(vocabulary))
        sent = sc.broadcast((n_docs, total, term_weights(n_docs, df)))
        found = _search_vectors(vectors, sc.broadcast(queries), sent, best, id_type)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
        found = found.withColumn("rank", rank).where(F.col("rank") <= best)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], T.StructType([
            T.StructField("item", T.IntegerType()), T.StructField(item_col, item_type)]))
        found = found.join(names, "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
        out = found if out is None else out.union(found)
    return out
