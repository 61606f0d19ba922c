import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kappaflow.llm import token_counts as TC
from kappaflow.llm.bpe import PrefixEncoder, RecentMap, bpe_round_trip, ids_digest, read_tokenizer, segments
from kappaflow.llm.queries import QUERIES, TOKENIZER
from pyspark.sql import functions as F

PATH = public_tokenizers.path(TOKENIZER)
PARTS = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "the", "é", "1", "23", "!", "#", "<|endoftext|>", "<|", "\x1c",
         "\x85", "\xa0", "​", "　", "中", "😀", "²", "Ⅷ", "-", "----", "A", "'S", "\r", "́", "\x00", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    return made + ["a" * 3000, "ab" * 2000, "=" * 3000, " " * 2000, "\n" * 999, "", "x'" * 60]


def test_encoder_and_counter_match_the_library(library, texts):
    encoder, counter = PrefixEncoder(read_tokenizer(PATH)), TC.TokenCounter(read_tokenizer(PATH))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode(t).tolist() for t in texts] == want
    assert counter.count(texts).tolist() == [len(w) for w in want]
    assert [encoder.decode(np.array(w, np.int32)) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_small_memories_change_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(TC, "KEEP_STATES", 50)
    counter = TC.TokenCounter(read_tokenizer(PATH))
    counter.known.size = 20
    assert counter.count(texts[:500]).tolist() == [len(e.ids) for e in library.encode_batch(texts[:500], add_special_tokens=False)]


def test_streams_of_any_length_count_alike(library, texts, monkeypatch):
    counter = TC.TokenCounter(read_tokenizer(PATH))
    long = [" ".join(texts[:200]), "", *texts[:50]]
    want = [len(e.ids) for e in library.encode_batch(long, add_special_tokens=False)]
    monkeypatch.setattr(TC, "SLICE_CHARS", 100)
    monkeypatch.setattr(TC.segments, "__defaults__", (64,))
    assert counter.count(long).tolist() == want


def test_chunk_size_does_not_matter(texts):
    stream = "".join(texts[:300])
    classes = TC.class_table()[np.frombuffer(stream.encode("utf-32-le"), np.uint32)]
    want = TC.piece_starts(classes, len(classes))
    for chunk in (1, 7, 64, 1000):
        assert np.array_equal(TC.piece_starts(classes, chunk), want)


def test_prefix_scan_is_composition():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, TC.STATES, (37, TC.STATES)).astype(np.uint8)
    state, scanned = np.arange(TC.STATES), TC.scan_maps(maps)
    for i, one in enumerate(maps):
        state = one[state]
        assert np.array_equal(scanned[i], state)


def test_long_texts_are_cut_where_the_tokenizer_splits(library):
    rng = random.Random(2)
    text = "".join(rng.choice(PARTS) for _ in range(5000)).replace("<|endoftext|>", "")
    parts = list(segments(text, 100))
    assert "".join(parts) == text and len(parts) > 10
    whole = library.encode(text, add_special_tokens=False).ids
    assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == whole


def test_recent_map_keeps_what_is_used():
    calls = []
    kept = RecentMap(lambda k: calls.append(k) or k * 2, 2)
    assert kept.all([1, 2, 3, 1]) == [2, 4, 6, 2]
    assert kept.all([1, 4]) == [2, 8] and calls == [1, 2, 3, 4]


def test_on_spark(odd_docs, no_docs, library):
    rows = bpe_round_trip(odd_docs, PATH, keep=("_key",)).select(
        "doc_id", "ids", "decoded", ids_digest(F.col("ids")).alias("digest"))
    want = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in odd_docs.collect()]
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(repr, [(r[0], list(r[1]), r[2], r[3]) for r in rows.collect()])) == sorted(repr((*w, digest(w[1]))) for w in want)
    counts = TC.count_tokens(odd_docs, PATH).collect()
    assert sorted(map(repr, map(tuple, counts))) == sorted(repr((i, len(t.encode()), len(ids))) for i, ids, t in want)
    assert bpe_round_trip(no_docs, PATH).count() == 0 and TC.count_tokens(no_docs, PATH).count() == 0


def test_queries_match_the_library_on_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op7_bpe"](spark, sf).collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    assert got == {i: (len(docs[i].encode()), len(x), len(x) > 1024) for i, x in ids.items()}


def made_tokenizer(seed, spread=1, shuffled=False):
    """A byte-level BPE of random merges: some tokens cannot be made of their own bytes."""
    import json

    from kappaflow.llm.bpe import byte_letters
    rng = random.Random(seed)
    letters = list(byte_letters())
    vocab = {c: i * spread for i, c in enumerate(letters)}
    pool, merges = list("abcd") * 3, []
    while len(merges) < 400:
        a, b = rng.choice(pool), rng.choice(pool)
        if a + b not in vocab and len(a + b) < 9:
            vocab[a + b] = len(vocab) * spread
            merges.append(f"{a} {b}")
            pool.append(a + b)
    if shuffled:
        rng.shuffle(merges)
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
             "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level,
                       "post_processor": None, "decoder": level, "model": model})


@pytest.mark.parametrize("seed, spread", [(1, 1), (2, 1), (3, 401)])
def test_unreachable_tokens_and_large_ids(seed, spread):
    spec = made_tokenizer(seed, spread)
    lib = Tokenizer.from_str(spec)
    rng = random.Random(seed + 100)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(2000)] + ["ab cd" * 50]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    encoder, counter = PrefixEncoder(spec), TC.TokenCounter(spec)
    every = sum(1 for b in encoder.vocab.bytes if b)
    assert len(encoder.vocab.ids) < every  # some are unreachable
    if spread > 1:
        assert max(map(max, want)) > 131_071
    assert [encoder.encode(t).tolist() for t in texts] == want
    assert counter.count(texts).tolist() == [len(w) for w in want]


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="before those that make its parts"):
        PrefixEncoder(made_tokenizer(1, shuffled=True))


def test_every_token_of_the_dealt_file_is_reachable():
    encoder = PrefixEncoder(read_tokenizer(PATH))
    assert len(encoder.vocab.ids) == sum(1 for b in encoder.vocab.bytes if b) - len(encoder.vocab.specials)


def test_words_of_any_length_take_bounded_memory(library, monkeypatch):
    """Pieces without white space: no table of them grows, and states are dropped inside a piece."""
    import tracemalloc
    rng = random.Random(9)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(150_000))
    want = library.encode(word, add_special_tokens=False).ids
    encoder, counter = PrefixEncoder(read_tokenizer(PATH)), TC.TokenCounter(read_tokenizer(PATH))
    assert encoder.encode(word).tolist() == want
    monkeypatch.setattr(TC, "KEEP_STATES", 5_000)
    assert counter.count([word]).tolist() == [len(want)] and len(counter.machine.states) <= 5_002
    encoder.known.clear()
    encoder.encode(" ".join([word[i:i + 200] for i in range(0, 20_000, 200)]))
    assert not encoder.known and all(len(k) <= 64 for k in counter.known)  # long pieces are not kept
    tracemalloc.start()
    encoder.encode("ab" * 500_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # 40 bytes a letter: five million letters stay below 200 MB
