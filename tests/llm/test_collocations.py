"""Collocations against brute force; the summaries' guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kappaflow.llm import collocations
from kappaflow.llm.collocations import MisraGries, mine_collocations, pack, unpack


def brute(rows, least, first, most_words=3, percent=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    cand = {(lang, p): a for (lang, p), a in f.items() if a >= least and len(p) > 1}
    out = {}
    for (lang, p), a in cand.items():
        longer = [b for (other, q), b in cand.items() if other == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
                  for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1))


def made_rows(seed, n, words=9):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(words)] + ["New", "york", "É", "é", "x\x1cy", "\x00"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " - "]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(vocabulary) + rnd.choice(gaps) for _ in range(rnd.randrange(60)))
        rows.append((text, rnd.choice(["en", "en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), ("  \n", "fr"), ("New york city " * 30, "en"), ("a" * 5000, "xx")]


@pytest.mark.parametrize("least, run_words, read_bytes", [(4, 1_000_000, 4_000_000), (10, 50, 40), (25, 7, 13)])
def test_against_brute_force(spark, monkeypatch, least, run_words, read_bytes):
    monkeypatch.setattr(collocations, "RUN_WORDS", run_words)
    monkeypatch.setattr(collocations, "READ_BYTES", read_bytes)
    rows = made_rows(least, 120)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "1 AS n", "2 AS part", "'x' AS phrase")
    got = sorted(tuple(r) for r in mine_collocations(df.repartition(5), least=least, first=40).collect())
    assert got == brute(rows, least, 40)
    assert got


def test_four_words(spark):
    rows = made_rows(9, 60, words=4)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(tuple(r) for r in mine_collocations(df, least=5, most_words=4, first=10_000).collect())
    assert got == brute(rows, 5, 10_000, most_words=4)


def test_empty(spark):
    assert mine_collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 4])
def test_frequent_keys_survive(monkeypatch, capacity):
    """Whatever the order and the merges, no key of ``least`` occurrences is lost, and memory keeps to the capacity."""
    monkeypatch.setattr(collocations, "MERGE_ENTRIES", 50)
    rng, least = np.random.default_rng(capacity), 10
    keys = np.concatenate([rng.integers(0, 10**9, 3000), np.repeat(rng.integers(0, 10**9, 40), least), np.full(500, 7)]).astype(np.uint64)
    rng.shuffle(keys)
    summary = MisraGries(capacity * len(keys) // least + 1)
    for part in np.array_split(keys, 60):
        summary.add(*np.unique(part, return_counts=True))
    left = set(summary.survivors(least).tolist())
    true = Counter(keys.tolist())
    assert {k for k, n in true.items() if n >= least} <= left
    assert len(summary.keys) <= summary.capacity and summary.lost < least
    if capacity == 4:
        assert len(left) < 200


def test_packed_counts():
    low, counts = np.array([1, 5, (1 << 40) - 1], np.uint64), np.array([255, 256, 10**9])
    a, b = unpack(*pack(low, counts))
    assert a.tolist() == low.tolist() and b.tolist() == counts.tolist()
