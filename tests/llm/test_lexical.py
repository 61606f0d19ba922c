"""Ranked search against brute force; skipping loses nothing."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kappaflow.llm import lexical
from kappaflow.llm.lexical import ranked_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute(docs, items, best):
    def terms(text):
        return re.findall(TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, rows = Counter(terms(text)), []
        for d, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * n_docs // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m))
                        for t, q in asked.items() if b[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out, key=str)


def made(seed, n):
    rnd = random.Random(seed)
    words = ["the", "of", "And"] * 6 + [f"w{i}" for i in range(60)] + ["café", "ÉTÉ", "x1", "日本"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "_", "-"]) for _ in range(k))
    docs = [(i * 3, text(rnd.randrange(1, 40))) for i in range(n)]
    copy = text(30)
    docs += [(1000 + i, copy) for i in range(25)] + [(None, copy), (None, "w1 w2"), (7, copy), (7, copy), (8, None), (9, ""), (10, " .;\n")]
    docs.append((11, "w3 the " * 3000))
    rnd.shuffle(docs)
    items = [(i, text(12)) for i in range(12)] + [(50, copy), (51, None), (52, "unknown words"), (53, ""), (54, "the the the w1 w1"), (54, "w2"), (None, "w5")]
    return docs, items


@pytest.mark.parametrize("shard, block, entries", [(4096, 64, 1_000_000), (50, 4, 1_000_000), (7, 1, 40)])
def test_against_brute_force(spark, monkeypatch, shard, block, entries):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(lexical, "BUFFER", 500)
    monkeypatch.setattr(lexical, "READ_BYTES", 100)
    docs, items = made(shard, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS terms", "'x' AS tf").repartition(3)
    got = ranked_search(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items, 10)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    docs, items = made(3, 60)
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), best=4).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items, 4)


def test_empty(spark):
    docs, items = made(1, 5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search(d.limit(0), i).count() == 0 and ranked_search(d, i.limit(0)).count() == 0


def test_blocks_are_skipped():
    """Where groups of documents differ, most of them are never scored, and the best stay the best."""
    import pyarrow as pa
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(g * 50, g * 50 + 50, 20)) for g in range(20) for _ in range(100)]
    size = np.array([len(d) + 1 for d in docs])
    term = np.concatenate([[*d, 1000] for d in docs]).astype(np.int64)  # term 1000 is in every document
    impact = rng.integers(100_000, 900_000, len(term))
    weight = np.full(1001, 3000, np.int64)
    weight[1000] = 1
    index = lexical.Shard(pa.array(np.arange(2000)), np.concatenate([[0], np.cumsum(size)]), term, impact, weight)
    item = np.array([0, 3, 5, 8, 13, 21, 34, 1000])
    found, scored = index.search(item, weight[item], 10, 1)
    by = np.zeros(1001, np.int64)
    by[item] = weight[item]
    every = index.scores(np.arange(2000), by)
    assert [-s for s, _, _ in sorted(found)] == sorted(every.tolist(), reverse=True)[:10]
    assert scored < 500
