import re
from collections import Counter

import numpy as np
import pytest

from kappaflow.llm import quality as Q
from kappaflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


ODD = ["", " \n\n", "a", "a\na\n a\na ", "x " * 40, "\r\na\r\na\n\x0b\x0cb", "é ü\n中文 😀#|", "# * $ % & | < >", "a b c d e f g h i\n" * 3,
       "a b c d e f g h " + "z " * 20 + "a b c d e f g h", " nbsp　wide\n nbsp　wide", "one two three four five six seven eight nine ten " * 5000]


def test_base_counts():
    got = Q.read_lines(ODD)
    for text, row in zip(ODD, got.base.tolist()):
        assert tuple(row) == brute_base(text)
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab c\nd #é"), 300)) for _ in range(300)]
    for text, row in zip(texts, Q.read_lines(texts).base.tolist()):
        assert tuple(row) == brute_base(text)


def test_repeat_words_verifies_equal_hashes(monkeypatch):
    """Windows whose mixed numbers collide are still compared exactly."""
    monkeypatch.setattr(Q, "_odd", np.zeros(Q.WINDOW, np.uint64))
    for n in (10, 50):
        assert Q.repeat_words(np.arange(n)) == 0
    assert Q.repeat_words(np.array([*range(8), *range(8)])) == 16


def brute_viterbi(field, scores):
    n, best = len(scores), None
    for code in range(1 << n):
        path = [code >> i & 1 for i in range(n)]
        value = sum(s for s, p in zip(scores, path) if p) + sum(field.change[a, b] for a, b in zip(path, path[1:]))
        if best is None or value > best[0] + 1e-12:
            best = value, path
    return best


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(60):
        field = Q.LineField(np.zeros(len(Q.FEATURES)), rng.normal(0, 1, (2, 2)))
        scores = rng.normal(0, 1, rng.integers(1, 9))
        path = field.viterbi(scores)
        value = sum(s for s, p in zip(scores, path) if p) + sum(field.change[int(a), int(b)] for a, b in zip(path, path[1:]))
        assert value == pytest.approx(brute_viterbi(field, scores)[0])


def test_training_learns_transitions_and_features():
    rng = np.random.default_rng(2)
    good, bad = [np.zeros((6, len(Q.FEATURES))) for _ in range(40)], [np.zeros((6, len(Q.FEATURES))) for _ in range(40)]
    for f in good + bad:
        f[:, 0] = 1
    for f in bad:
        f[:, 3] = rng.normal(1, 0.7, 6)
    field = Q.fit_field(good + bad, [0] * 40 + [1] * 40)
    assert field.weights[3] > 1 and field.change[1, 1] > field.change[1, 0]
    assert Q.fit_field(good, [0] * 40) is Q.NOTHING_LEARNT


@pytest.fixture(scope="module")
def field(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return Q.train_field(docs.where("doc_id % 2 = 0"), labels)


def test_held_out_labels(spark, field):
    """Fitted on even ids, held against the labels of odd ids."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_verdicts(docs.where("doc_id % 2 = 1"), field).join(labels, "doc_id").collect()
    clean = [r for r in out if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in out if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.99
    assert sum(not r["kept"] for r in junk) / len(junk) > 0.8


def test_odd_rows(odd_docs, no_docs, field):
    out = Q.quality_verdicts(odd_docs, field).collect()
    want = Counter((r["doc_id"], *brute_base(r["text"] or "")) for r in odd_docs.collect())
    assert Counter(tuple(r)[:6] for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = Q.keep_quality(odd_docs, field)
    assert kept.schema == odd_docs.schema and kept.count() == sum(r["kept"] for r in out)
    assert Q.quality_verdicts(no_docs, field).count() == 0 and Q.keep_quality(no_docs, field).count() == 0


def test_no_labels_leaves_the_base_rules(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train_field(odd_docs, labels) is Q.NOTHING_LEARNT
    assert [r for r in Q.quality_verdicts(odd_docs, Q.NOTHING_LEARNT).collect() if r["kept"] == r["base_failed"]] == []


def test_query_base(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, sf).collect()}
    assert len(out) == len(docs)
    for r in docs:
        assert tuple(out[r["doc_id"]])[1:6] == brute_base(r["text"])


def test_a_repeated_id_gives_one_training_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words here")] * 500 + [(2, "# $ # $")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, 1), (1, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit_field", lambda x, y: seen.append((len(x), y)) or Q.NOTHING_LEARNT)
    Q.train_field(docs, labels)
    assert seen[0][0] == 2 and sorted(seen[0][1]) == [0, 1]


def test_sample_is_bounded_in_lines(spark, monkeypatch):
    lines = Q.SAMPLE_LINES
    docs = spark.createDataFrame([(1, "some words here"), (2, "# $ # $"), (3, "x\n" * (lines - 1) + "x"), (4, "x\n" * lines + "x")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit_field", lambda x, y: seen.append(sorted(map(len, x))) or Q.NOTHING_LEARNT)
    Q.train_field(docs, labels)
    assert seen == [[1, 1, lines]]
