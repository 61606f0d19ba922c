import random
import re

import numpy as np
import pytest

from kappaflow.llm import pii as P
from kappaflow.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_patterns():
    rng = random.Random(1)
    parts = ["a", "B", "9", "12", "255", "256", "0007", ".", "@", "-", "_", " ", "+", "(", ")", "\n", "é", "4111111111111111", "x.y", "@b.c", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert P.base_spans(text) == brute(text), text


def test_base_time_is_linear():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" + "(" * 200_000, "1." * 100_000, "a.b" * 100_000 + "@"):
        P.base_spans(text)


def test_gradient_is_exact():
    tagger = P.Tagger.start(3)
    sample = P.labelled_windows(3, 9)
    x = P.encode_windows([t[:12] for t, _ in sample], 12)
    y = np.stack([P.tags_of([s for s in spans if s[2] <= 12], 12) for _, spans in sample])
    _, g = tagger.gradient(x, y)
    rng = np.random.default_rng(0)
    for name, w in tagger.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "embed":
                at = (int(x[0, 0]), at[1])
            keep, step = w[at], 1e-5
            w[at] = keep + step
            up = tagger.gradient(x, y)[0]
            w[at] = keep - step
            down = tagger.gradient(x, y)[0]
            w[at] = keep
            assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-6)


def test_viterbi_is_the_best_path():
    tagger = P.Tagger.start(5)
    tagger.w["change"] = np.random.default_rng(1).normal(0, 1, tagger.w["change"].shape)
    x = P.encode_windows(["a@1"], 3)
    score = tagger.scores(x)[1][0]
    n = len(P.TAGS)
    value = lambda p: sum(score[t, k] for t, k in enumerate(p)) + sum(tagger.w["change"][a, b] for a, b in zip(p, p[1:]))
    best = max(((a, b, c) for a in range(n) for b in range(n) for c in range(n)), key=value)
    assert value(tagger.viterbi(x)[0]) == pytest.approx(value(best))


def test_held_out_tags():
    """Tags of windows made from another seed."""
    sample = [(t, s) for t, s in P.labelled_windows(400, 1234) if len(t) == P.WINDOW]
    found = P.trained_tagger().viterbi(P.encode_windows([t for t, _ in sample]))
    gold = np.stack([P.tags_of(s, P.WINDOW) for _, s in sample])
    assert (found == gold).mean() > 0.95
    inside = gold > 0
    assert (found[inside] == gold[inside]).mean() > 0.85


def test_windows_are_reconciled_over_the_whole_text():
    """A span far from the start and across window edges is found once, base spans stay, clean text adds none."""
    tagger = P.trained_tagger()
    filler = "thinly the andre of ering with that was on "
    for pad in range(0, 70, 9):
        text = filler * 5 + "x" * pad + " call (212) 555-7788 or " + filler
        spans = P.added_spans([text], [P.base_spans(text)], tagger)[0]
        assert len(spans) <= 1
        assert all(k == "phone" and "555" in text[a:b] for k, a, b in spans)
    assert P.added_spans([filler * 20], [[]], tagger) == [[]]


def test_reconciliation_takes_the_deepest_window():
    text = "a" * 40 + "1" + "b" * 100 + "@" + "c" * 10 + "7"
    numbers = P.window_numbers(text)
    starts = [k * P.STRIDE for k in numbers.tolist()]
    assert starts == [a for a in range(0, len(text), P.STRIDE) if re.search("[0-9@]", text[a:a + P.WINDOW])]
    tags = np.random.default_rng(0).integers(0, len(P.TAGS), (len(numbers), P.WINDOW)).astype(np.uint8)
    got = P.reconcile(len(text), numbers, tags)
    for p in range(len(text)):
        cover = [(min(p - a, P.WINDOW - 1 - (p - a)), int(tags[i, p - a])) for i, a in enumerate(starts) if a <= p < a + P.WINDOW]
        assert got[p] in ({t for d, t in cover if d == max(cover)[0]} if cover else {0})
    assert P.tagged_spans(np.array([0, 1, 2, 2, 4, 3, 2, 5, 6, 0, 6, 7])) == [("email", 1, 4), ("ip", 5, 6), ("card", 7, 9), ("phone", 11, 12)]
    assert len(P.window_numbers("none")) == 0


def test_odd_rows(odd_docs, no_docs):
    rows = P.find_personal_data(odd_docs)
    got = sorted(repr((r["doc_id"], [tuple(s)[:3] for s in r["spans"] if s["base"]])) for r in rows.collect())
    assert got == sorted(repr((r["doc_id"], brute(r["text"] or ""))) for r in odd_docs.collect())
    assert P.find_personal_data(no_docs).count() == 0


def test_query(spark):
    import hashlib
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_personal_data"](spark, sf).collect():
        base = brute(docs[r["doc_id"]])
        assert tuple(r)[1:5] == tuple(sum(s[0] == k for s in base) for k in P.KINDS)
        text = ",".join("%s:%d:%d" % s for s in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert {"%s:%d:%d" % s for s in base} <= set(r["spans"].split(","))


def test_spelt_emails_without_digits():
    """Held-out emails with a spelt-out @ and no digit are found wherever they lie; prose with "at" adds none."""
    rng, tagger = random.Random(77), P.trained_tagger()
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 10)))
    for at in (" at ", "(at)"):
        texts, gold = [], []
        for _ in range(300):
            before = "".join(word() + " " for _ in range(rng.randint(0, 15)))
            email = word() + rng.choice(("", ".", "_")) + word() + at + word() + rng.choice((".example.com", ".org", ".co.uk", ".net"))
            texts.append(before + email + "".join(" " + word() for _ in range(8)))
            gold.append(("email", len(before), len(before) + len(email)))
        found = P.added_spans(texts, [[]] * len(texts), tagger)
        assert sum(g in f for f, g in zip(found, gold)) / len(gold) > 0.75
    text = "mail jane.doe(at)word.org"
    assert [text[a:b] for _, a, b in P.added_spans([text], [P.base_spans(text)], tagger)[0]] == ["jane.doe(at)word.org"]
    for text in ("We met at noon and looked at the river.", "She works at home. He is at the office today, at last."):
        assert P.added_spans([text], [[]], tagger) == [[]]


def test_spelt_gate_loses_no_window():
    """The tags around a spelt-out @ are those of all windows."""
    for pad in range(0, 100, 7):
        text = "x" * pad + " first.second(at)third.example.com " + "y" * 90
        every = np.arange((len(text) - 1) // P.STRIDE + 1)
        tags = np.random.default_rng(pad).integers(0, len(P.TAGS), (len(every), P.WINDOW)).astype(np.uint8)
        some = P.window_numbers(text)
        a, b = text.index("first"), text.index(".com") + 4
        assert (P.reconcile(len(text), some, tags[some])[a:b] == P.reconcile(len(text), every, tags)[a:b]).all()


def test_added_spans_leave_base_spans_alone():
    """Against all pairs, with base spans of several kinds that overlap each other."""
    rng, tagger = random.Random(5), P.trained_tagger()
    pieces = ["call (212) 555-7788 now ", "mail jane.doe(at)word.org ", "card 4111 1111 1111 1112 ", "plain words of a text ", "at 10.0.0.1 "]
    texts = ["".join(rng.choice(pieces) for _ in range(40)) for _ in range(8)]
    every = P.added_spans(texts, [[] for _ in texts], tagger)
    assert sum(map(len, every)) > 40
    base = [[(k, max(0, a + rng.randint(-30, 30)), b + rng.randint(-5, 40)) for k, a, b in spans for _ in range(2) if rng.random() < 0.3] for spans in every]
    base = [[s for s in spans if s[1] < s[2]] for spans in base]
    for spans in base:
        rng.shuffle(spans)
    want = [[s for s in spans if not any(x < s[2] and s[1] < y for _, x, y in b)] for spans, b in zip(every, base)]
    assert P.added_spans(texts, base, tagger) == want and want != every


def test_every_window_is_run():
    """Against all windows one by one, with a tagger whose tags go on where there is no digit and no @."""
    class Marks(P.Tagger):
        def viterbi(self, x):
            seen.append(len(x))
            long = np.isin(x, P.encode_windows(["abcdefgh@1"])[0, :10])
            start = long & ~np.pad(long, ((0, 0), (1, 0)))[:, :-1]
            return np.where(start, 1, np.where(long, 2, 0))  # emails: runs of these characters

    rng, seen = random.Random(8), []
    texts = ["zz " * 200, "", "zy" * 30 + "abcdefgh" * 7 + "@a1 zz", "x" * 50_000]
    texts += ["".join(rng.choice("zzzz abcdefgh@1") * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    got = P.added_spans(texts, [[] for _ in texts], Marks({}))
    assert sum(seen) == sum(-(-len(t) // P.STRIDE) for t in texts) and max(seen) <= P.RUN_WINDOWS
    for text, spans in zip(texts, got):
        every = np.arange(-(-len(text) // P.STRIDE))
        tags = [Marks({}).viterbi(P.encode_windows([text[k * P.STRIDE:k * P.STRIDE + P.WINDOW]]))[0] for k in every]
        want = P.tagged_spans(P.reconcile(len(text), every, np.array(tags, np.uint8).reshape(len(every), P.WINDOW)))
        assert spans == [s for s in want if P.LENGTHS[s[0]][0] <= s[2] - s[1] <= P.LENGTHS[s[0]][1] and P.of_learnt_form(s[0], text, *s[1:])]
    assert got[2] and len(got[2][0]) == 3


def test_decoding_by_columns_is_that_of_the_scores():
    tagger = P.trained_tagger()
    x = P.encode_windows([t for t, _ in P.labelled_windows(300, 4321)])
    score, change = tagger.scores(x)[1], tagger.w["change"]
    assert np.abs(tagger._columns(x).transpose(2, 0, 1) - score).max() < 1e-4
    best, back = score[:, 0], []
    for t in range(1, x.shape[1]):
        ways = best[:, :, None] + change
        back.append(ways.argmax(1))
        best = ways.max(1) + score[:, t]
    path = [best.argmax(1)]
    for b in reversed(back):
        path.append(b[np.arange(len(x)), path[-1]])
    assert (tagger.viterbi(x) == np.stack(path[::-1], 1)).mean() > 0.9999


def test_few_windows_are_decoded_for_nothing():
    """The bound leaves out no window with a tag, and most of the others."""
    tagger = P.trained_tagger()
    x = P.encode_windows([t for t, spans in P.labelled_windows(6000, 99) if not spans])
    suspected = tagger._bound(tagger._columns(x)) > -P.BOUND_MARGIN
    best, change = tagger._columns(x), tagger.w["change"]
    for t in range(1, len(best)):
        best[t] += (best[t - 1][:, None, :] + change[:, :, None]).max(0)
    score = tagger._columns(x)
    other = score[:, 0].sum(0) + change[0, 0] * (len(score) - 1)  # O throughout
    assert not (~suspected & (best[-1].max(0) > other + 1e-3)).any()
    tagged = tagger.viterbi(x).any(1)
    assert suspected[tagged].all() and suspected[~tagged].mean() < 0.2


def test_windows_of_any_number_and_length():
    """Blocks that are full, begun or single, of odd and even length, against the scores."""
    tagger = P.trained_tagger()
    rng = np.random.default_rng(2)
    for n, long in ((1, 1), (1, 64), (3, 2), (255, 5), (257, 3), (P.STATE_WINDOWS + 1, 4), (P.STATE_WINDOWS + P.PRODUCT_WINDOWS, 7)):
        x = rng.integers(0, P.SYMBOLS, (n, long))
        score = tagger.scores(x)[1]
        assert np.abs(tagger._columns(x).transpose(2, 0, 1) - score).max() < 1e-4
    assert tagger.viterbi(np.zeros((0, P.WINDOW), np.int64)).shape == (0, P.WINDOW)


def test_texts_together_are_texts_alone():
    """Empty texts between, spans at both ends of a text and tags that would run on into the next one."""
    rng, tagger = random.Random(6), P.trained_tagger()
    pieces = ["(212) 555-7788", "jane.doe(at)word.org", "4111 1111 1111 1112", "words ", "x" * 31, "", "at 10.0.0.1", "4", "555", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    base = [P.base_spans(t) for t in texts]
    alone = [P.added_spans([t], [b], tagger)[0] for t, b in zip(texts, base)]
    assert P.added_spans(texts, base, tagger) == alone and sum(map(len, alone)) > 20
    assert P.added_spans([], [], tagger) == [] and P.added_spans(["", ""], [[], []], tagger) == [[], []]
