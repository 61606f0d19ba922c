"""Quality rules by line sequence labelling.

Every line of a text that has a word gets a small vector of features.  A
linear-chain conditional random field (two labels: content, boilerplate) is
trained in numpy from documents with a quality label, and Viterbi decoding
labels the lines of every whole text.  A text is kept when it passes the base
rules and its content lines hold at least ``MIN_CONTENT`` of its words.

The field is fitted on a bounded sample of labelled rows: at most
``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_CHARS`` characters and
``SAMPLE_LINES`` lines, the first by a hash of their ids; everything else covers all rows.

Defined cases: a null or empty text has no words and fails the base rules;
rows that repeat are judged alike, each for itself; ids and other columns may
be null or have any name; an empty table gives an empty result; without
labels of both kinds there is nothing to learn and the field calls every line
content, so the base rules decide alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_columns, col, fresh, text_slices

#: Bounds of the labelled sample.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
SAMPLE_LINES = 500
#: Base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Share of a text's words that must stand in content lines.
MIN_CONTENT = 0.5
#: Training: lines to a sequence, rounds, step, penalty.
SEQUENCE, ROUNDS, STEP, PENALTY = 32, 250, 0.15, 1e-3

SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "words", "word_chars", "symbols", "capitals", "digits", "shouts", "stops", "repeats", "again",
            "first", "last")
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_odd = np.random.default_rng(8).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _doubled(ids: np.ndarray) -> np.ndarray:
    """Ranks of the WINDOW-word windows of a text, exact: equal windows have equal ranks."""
    rank, width = ids, 1
    while width < WINDOW:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], width * 2
    return rank


def repeat_words(ids: np.ndarray) -> int:
    """Words that stand in a window of WINDOW words found twice or more in the text."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            mixed += ids[k:k + n].astype(np.uint64) * _odd[k]
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():  # equal windows have equal sums, so there are none
        return 0
    rank = _doubled(ids)
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    where = np.flatnonzero(twice)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass
class Lines:
    """Base counts of texts and the features of their lines with words, line after line."""

    base: np.ndarray      # texts x BASE
    features: np.ndarray  # lines x FEATURES
    words: np.ndarray     # words of each line
    owner: np.ndarray     # text of each line


def read_lines(texts: list[str]) -> Lines:
    raw = [t.encode() for t in texts]
    base = np.zeros((len(raw), len(BASE)), np.int64)
    lines, owner, again, words, kinds = [], [], [], [], []
    for i, data in enumerate(raw):
        seen, dup, ids, number = set(), 0, [], {}
        put = number.setdefault
        for line in data.split(b"\n"):
            parts = line.split()  # ASCII white space only: what the word pattern leaves out
            if parts:
                lines.append(line)
                owner.append(i)
                words.append(len(parts))
                kinds.append(len(set(parts)))
                if line in seen:
                    dup += 1
                    again.append(1.0)
                else:
                    seen.add(line)
                    again.append(0.0)
                ids += [put(w, len(number)) for w in parts]
        base[i, 0], base[i, 3], base[i, 4] = len(ids), dup, repeat_words(np.array(ids, np.int64))
    if not lines:
        return Lines(base, np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner = np.array(owner, np.int64)
    buf = np.frombuffer(b"\n".join(lines), np.uint8)
    size = np.array([len(x) for x in lines], np.int64)
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])

    def per_line(mask):
        return np.add.reduceat(mask, start, dtype=np.int64)

    letters = per_line(((buf & 0xC0) != 0x80) & ~_white[buf])  # code points in words
    symbols = per_line(_symbol[buf])
    capitals = per_line((buf >= 65) & (buf <= 90))
    digits = per_line((buf >= 48) & (buf <= 57))
    shouts = per_line(buf == 33)
    stops = per_line((buf == 46) | (buf == 44) | (buf == 63))
    words, kinds = np.array(words, np.int64), np.array(kinds, np.int64)
    for k, values in ((1, letters), (2, symbols)):
        base[:, k] = np.bincount(owner, values, len(raw)).astype(np.int64)
    edge = np.flatnonzero(np.diff(owner)) + 1
    first, last = np.zeros(len(lines)), np.zeros(len(lines))
    first[np.concatenate([[0], edge])] = 1
    last[np.concatenate([edge - 1, [len(lines) - 1]])] = 1
    some = np.maximum(letters, 1)
    features = np.stack([np.ones(len(lines)), np.log1p(words) / 4, letters / np.maximum(words, 1) / 8, symbols / some * 4,
                         capitals / some, digits / some, shouts / some * 4, stops / np.maximum(words, 1),
                         1 - kinds / np.maximum(words, 1), np.array(again), first, last], axis=1)
    return Lines(base, features, words, owner)


@dataclass
class LineField:
    """Weights of the chain: label scores per feature (boilerplate less content) and label changes."""

    weights: np.ndarray   # FEATURES
    change: np.ndarray    # 2 x 2, from label to label

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best label sequence (1: boilerplate) for the scores of one text's lines."""
        (cc, cb), (bc, bb) = self.change.tolist()
        c, b, back = 0.0, 0.0, []
        for i, s in enumerate(scores.tolist()):
            if i:
                to_c, to_b = b + bc > c + cc, b + bb > c + cb
                c, b = (b + bc if to_c else c + cc), (b + bb if to_b else c + cb)
                back.append((to_c, to_b))
            b += s
        label = b > c
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return np.array(out[::-1], bool)


NOTHING_LEARNT = LineField(np.array([-1.0] + [0.0] * (len(FEATURES) - 1)), np.zeros((2, 2)))


def fit_field(features: list[np.ndarray], labels: list[int]) -> LineField:
    """Maximum likelihood by forward-backward and Adam; every line has its document's label."""
    if len(set(labels)) < 2:
        return NOTHING_LEARNT
    cut = [(f[i:i + SEQUENCE], y) for f, y in zip(features, labels, strict=True) for i in range(0, len(f), SEQUENCE)]
    long = max(len(f) for f, _ in cut)
    x = np.zeros((len(cut), long, len(FEATURES)))
    here = np.zeros((len(cut), long), bool)
    y = np.array([v for _, v in cut])
    for k, (f, _) in enumerate(cut):
        x[k, :len(f)], here[k, :len(f)] = f, True
    w, change = np.zeros(len(FEATURES)), np.zeros((2, 2))
    moment = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    lines = here.sum()
    both = here[:, 1:] & here[:, :-1]
    for round_ in range(1, ROUNDS + 1):
        score = np.zeros((len(cut), long, 2))
        score[..., 1] = x @ w
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, long):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + change[0], ahead[:, t - 1, 1, None] + change[1]) + score[:, t]
            ahead[:, t] = np.where(here[:, t, None], step, ahead[:, t - 1])
        for t in range(long - 2, -1, -1):
            after = score[:, t + 1] + behind[:, t + 1]
            step = np.logaddexp(change[:, 0] + after[:, :1], change[:, 1] + after[:, 1:])
            behind[:, t] = np.where(here[:, t + 1, None], step, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        with np.errstate(over="ignore"):
            p_line = np.where(here, np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]), 0)
            pair = np.exp(ahead[:, :-1, :, None] + change + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
        grad_w = ((here * y[:, None] - p_line)[..., None] * x).sum((0, 1)) / lines
        want = np.zeros((2, 2))
        for v in (0, 1):
            want[v, v] = both[y == v].sum()
        grad_c = (want - np.where(both[..., None, None], pair, 0).sum((0, 1))) / lines
        grad = np.concatenate([grad_w - PENALTY * w, (grad_c - PENALTY * change).ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad ** 2
        move = STEP * (moment[0] / (1 - 0.9 ** round_)) / (np.sqrt(moment[1] / (1 - 0.99 ** round_)) + 1e-8)
        w, change = w + move[:len(w)], change + move[len(w):].reshape(2, 2)
    return LineField(w, change)


def train_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> LineField:
    """Fit on the bounded sample; at most SAMPLE_DOCS rows go to the tasks and their lines to the driver."""
    check_columns(labels, id_col, label_col)
    sample = (labels.where(col(id_col).isNotNull() & col(label_col).isin(0, 1))
              .groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS))
    breaks = F.length(col(text_col)) - F.length(F.translate(col(text_col), "\n", ""))
    texts = (docs.where((F.length(col(text_col)) <= SAMPLE_CHARS) & (breaks < SAMPLE_LINES))
             .select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
             .join(F.broadcast(sample), "id")  # SAMPLE_DOCS rows at most
             .groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # one row of an id that repeats
             .select("y", "text"))

    def features(batches):
        for batch, values in text_slices(batches, "text"):
            got = read_lines(values)
            cut = np.searchsorted(got.owner, np.arange(len(values) + 1))
            rows = [(int(y), got.features[a:b].ravel().tolist())
                    for y, a, b in zip(batch.column(0).to_pylist(), cut, cut[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["y", "x"])

    rows = texts.mapInArrow(features, "y int, x array<double>").collect()
    rows.sort()  # tasks end in any order; sums must not depend on it
    return fit_field([np.array(r["x"]).reshape(-1, len(FEATURES)) for r in rows], [1 - r["y"] for r in rows])


def judge(texts: list[str], field: LineField) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, content share and verdict of texts."""
    got = read_lines(texts)
    scores = got.features @ field.weights
    cut = np.searchsorted(got.owner, np.arange(len(texts) + 1))
    junk = np.concatenate([field.viterbi(scores[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a] or [np.zeros(0, bool)])
    content = np.bincount(got.owner, got.words * ~junk, len(texts))
    n_words = got.base[:, 0]
    share = content / np.maximum(n_words, 1)
    failed = (n_words < MIN_WORDS) | (100 * got.base[:, 4] > MAX_REPEAT_PERCENT * n_words)
    return got.base, failed, share, ~failed & (share >= MIN_CONTENT)


def quality_verdicts(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed, content_share and kept, for every row."""
    check_columns(docs, id_col, text_col)
    (text,) = fresh(docs, "text")
    source = docs.select(col(id_col), col(text_col).cast("string").alias(text))
    out_schema = T.StructType([source.schema[0], *[T.StructField(c, T.LongType()) for c in BASE],
                               T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()),
                               T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch, texts in text_slices(batches, text):
            base, failed, share, kept = judge(texts, field)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(base[:, k]) for k in range(len(BASE))], pa.array(failed), pa.array(share),
                 pa.array(kept)], names=[id_col, *BASE, "base_failed", "content_share", "kept"])

    return source.mapInArrow(run, out_schema)


def keep_quality(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns; nothing moves between tasks."""
    check_columns(docs, text_col)

    def run(batches):
        for batch, texts in text_slices(batches, text_col):
            yield batch.filter(pa.array(judge(texts, field)[3]))

    return docs.mapInArrow(run, docs.schema)


def content_lines(text: str, field: LineField) -> list[tuple[str, bool]]:
    """Lines with words and whether they are content; for reading and tests."""
    got = read_lines([text])
    junk = field.viterbi(got.features @ field.weights) if len(got.words) else []
    return list(zip([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], [not j for j in junk], strict=True))
