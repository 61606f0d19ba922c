"""Best-fit packing against the tokenizers library, a sequential best fit and the rules of a packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kappaflow.llm import packing
from kappaflow.llm.packing import DOC, GAP, pack_documents, packed_sequences, sweep

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, capacity):
    """Every piece is there with its ids, sequences are gapless and within capacity; returns their number."""
    t = library()
    want = []
    for d, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want.append((d is None, d or 0, p, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    """Sequential best fit, longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


TEXTS = ["", None, "One", "it's  THE\t\nword here x", "café é ́x 12.5%", "<|endoftext|>a <|startoftext|>",
         "\x1c a\x85b ​", "İstanbul ΣΣ ǅ", "'s 's's 'LL x'll", "J\u030c I\u0307 \u00c9 E\u0301x", "<|ENDOFTEXT|> A", "END, now. é, ÉT). 3, (x),", "한국어 中文 \U0001f600\U0001f600"]


def test_ids_and_packing(spark):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "same id"), (3, "same id"), (50, "long " * 3000)]
    rng = np.random.default_rng(3)
    texts += [(100 + i, " ".join(["w"] * int(n))) for i, n in enumerate(rng.integers(0, 90, 150))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = pack_documents(df.selectExpr("doc_id", "text", "1 AS `PIECE`"), PATH, capacity=100).collect()
    used = check(rows, texts, 100)
    lengths = [r.length for r in rows]
    assert used <= max(best_fit(lengths, 100), -(-sum(lengths) // 100) + 2)


@pytest.mark.parametrize("kind", ["equal", "short", "wide"])
def test_number_of_sequences(spark, kind):
    rng = np.random.default_rng(5)
    n = {"equal": np.full(900, 29), "short": rng.integers(0, 4, 1500), "wide": rng.integers(0, 60, 800)}[kind]
    texts = [(i, "w " * int(k)) for i, k in enumerate(n)]
    rows = pack_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(6), PATH, capacity=64).collect()
    lengths = [r.length for r in rows]
    assert check(rows, texts, 64) <= 1.01 * max(best_fit(lengths, 64), 1)


def test_sweep_over_several_ranges(spark, monkeypatch):
    """Ranges and their tree of leftovers place as much as one sweep over all rows."""
    monkeypatch.setattr(packing, "SWEEP_ROWS", 6)
    monkeypatch.setattr(packing, "FAN", 2)
    rng = np.random.default_rng(7)
    rows = [(DOC, int(s), int(n), i, 0) for i, (s, n) in enumerate(zip(rng.integers(1, 50, 40), rng.integers(1, 9, 40), strict=True))]
    rows += [(GAP, int(s), int(n), 1000 * i, 0) for i, (s, n) in enumerate(zip(rng.integers(1, 90, 30), rng.integers(1, 9, 30), strict=True))]
    runs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], packing.RUNS)
    cuts = packing.range_cuts(runs, len(rows))
    assert len(cuts) > 4
    out = packing.sweep_round(runs, cuts).collect()
    rules = [r for r in out if r.kind == packing.RULE]
    assert sum(r.n for r in rules) == sum(r[1] for r in sweep(rows)[0])
    docs = sum(r[2] for r in rows if r[0] == DOC)
    assert sum(r.n for r in out if r.kind == DOC) + sum(r.n for r in rules) == docs
    taken = sorted((r.bin, -(-r.n // r.per)) for r in rules)
    assert all(a + n <= b for (a, n), (b, _) in zip(taken, taken[1:], strict=False))  # no gap is taken twice


def test_sequences_and_empty(spark):
    texts = [(1, "a b c"), (2, "d"), (2, "d"), (None, "e f"), (4, "g " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packed_sequences(df, PATH, capacity=16).collect()
    t = library()
    total = sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in texts)
    assert sum(len(r.ids) for r in rows) == total and max(len(r.ids) for r in rows) <= 16
    assert pack_documents(df.limit(0), PATH).count() == 0
