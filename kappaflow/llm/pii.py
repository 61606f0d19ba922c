"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions.

The base finds emails, IP addresses, card numbers and phone numbers by their
patterns, each in time linear in the text.  The tagger reads characters: an
LSTM runs over a window in both directions, a linear layer scores the tags
(O, and B/I for each kind) and a conditional random field with learnt
transitions decodes them.  It is trained in numpy, with exact gradients, from
labelled spans that ``labelled_windows`` makes from a seed; the weights are a
few thousand numbers that go to the tasks with the function.

A text is covered by windows of ``WINDOW`` characters that start every
``STRIDE``.  Windows are decoded apart and reconciled globally: each character
takes its tag from the window in which it lies deepest, spans are read from
the tags of the whole text, and a span counts only if it holds what all learnt
forms of its kind hold (a digit or an ``@``, for emails also `` at `` or ``(at)``),
is of a length that its kind can have and overlaps no base span.  Every
window of every text is run.

Base spans always stay.  ``spans`` are (kind, start, end) in code points, end
exclusive, sorted by start and kind.

Defined cases: a null or empty text has no spans; rows that repeat are read
alike, each for itself; ids and other columns may be null or have any name;
an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_columns, col, fresh, text_slices

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 12, 12
#: Training: windows, rounds, windows a round, step, seed.
TRAIN_WINDOWS, TRAIN_ROUNDS, TRAIN_BATCH, TRAIN_STEP, TRAIN_SEED = 3000, 220, 128, 0.02, 11
#: Lengths that an added span may have, by kind.
LENGTHS = {"email": (6, 100), "ip": (7, 15), "card": (13, 30), "phone": (8, 24)}
#: Windows decoded at once; of these, windows whose states are computed side by side, so that the states stay in a
#: core's cache; of these, windows of one matrix product, which are quickest while small.
RUN_WINDOWS, STATE_WINDOWS, PRODUCT_WINDOWS = 4096, 1024, 256
#: Far above the rounding of a path's sum.
BOUND_MARGIN = 0.01

# ---- base patterns -----------------------------------------------------------

#: The base patterns.  Look-behinds and possessive runs change no match, only keep the time linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: around each @, the longest run of name characters not yet used and its domain."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            used = domain.end()
            yield "email", start, used
        else:
            used = at + 1  # no match runs across this @
        at = text.find("@", max(used, at + 1))


def base_spans(text: str) -> list[Span]:
    out = list(emails(text))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- characters and labelled windows -------------------------------------------

PAD, OTHER_CHAR = 0, 1


@lru_cache(maxsize=1)
def char_table() -> np.ndarray:
    """Input symbol of every code point: printable ASCII one by one, others by a few kinds."""
    table = np.full(0x110000, OTHER_CHAR, np.int16)
    table[0xC0:0x250] = 2   # Latin letters with marks
    table[[9, 10, 11, 12, 13]] = 3
    table[32:127] = np.arange(4, 99)
    return table


SYMBOLS = 99


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnoprstuvwyéüñ") for _ in range(rng.randint(1, 10)))


def _card(rng: random.Random) -> str:
    body = _number(rng, rng.choice((15, 15, 15, 14)))
    check = next(d for d in "0123456789" if luhn(body + d))
    sep = rng.choice(("", "", " ", "-", "."))
    return sep.join(re.findall("....?", body + check)) if sep else body + check


def _personal(rng: random.Random, kind: str) -> str:
    if kind == "email":
        name = _word(rng) + rng.choice(("", ".", "_")) + rng.choice((_word(rng), _number(rng, 2)))
        at = rng.choice(("@", "@", "@", " @ ", " at ", "(at)"))
        return name + at + _word(rng) + rng.choice((".example.com", ".org", ".co.uk", ".net"))
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return _card(rng)
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"))


def _harmless(rng: random.Random) -> str:
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return rng.choice((f'"{hexes}"', hexes, f"{rng.randint(0, 9)}.{rng.randint(0, 9)}", str(rng.randint(0, 3000)),
                       f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", _number(rng, rng.randint(5, 12)),
                       f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", "@" + _word(rng), f"{_number(rng, 2)}:{_number(rng, 2)}",
                       f"{_number(rng, 4)}-{_number(rng, 2)}-{_number(rng, 2)}", f"${_number(rng, 4)}.{_number(rng, 2)}", f"version {rng.randint(1, 9)}.",
                       _number(rng, 24)))


def labelled_windows(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Invented texts of one window with their labelled spans, the same for the same seed."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        text, spans = "", []
        while len(text) < WINDOW:
            draw = rng.random()
            if draw < 0.16:
                kind = rng.choice(KINDS)
                part = _personal(rng, kind)
                spans.append((kind, len(text), len(text) + len(part)))
            elif draw < 0.30:
                part = _harmless(rng)
            else:
                part = _word(rng)
                part = rng.choice((part, part, part.upper(), part.capitalize()))
            text += part + rng.choice((" ", " ", " ", ", ", ". ", "\n", " | ", "!! ", "### "))
        cut = rng.randint(0, max(0, len(text) - WINDOW))
        spans = [(k, max(a - cut, 0), min(b - cut, WINDOW)) for k, a, b in spans if b > cut and a < cut + WINDOW]
        out.append((text[cut:cut + WINDOW], spans))
    return out


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, a, b in spans:
        first = 1 + 2 * KINDS.index(kind)
        tags[a:b] = first + 1
        tags[a] = first
    return tags


# ---- the tagger ------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Bidirectional LSTM with a CRF; windows are rows of symbols, all of one length."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(seed: int) -> "Tagger":
        rng = np.random.default_rng(seed)
        norm = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else 1), shape)
        w = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": norm(2 * HIDDEN, len(TAGS)) * 0.5,
             "bias": np.zeros(len(TAGS)), "change": np.zeros((len(TAGS), len(TAGS)))}
        for d in ("f", "b"):
            w[f"in_{d}"], w[f"rec_{d}"] = norm(EMBED, 4 * HIDDEN), norm(HIDDEN, 4 * HIDDEN)
            w[f"gate_{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return Tagger(w)

    def _direction(self, x, d, trace):
        """Hidden states over time; gates are kept for the way back when ``trace`` is a list."""
        w, h = self.w, HIDDEN
        order = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        inputs = (w["embed"] @ w[f"in_{d}"] + w[f"gate_{d}"])[x]  # one table row per symbol
        out = np.zeros((*x.shape, h), inputs.dtype)
        hid, cell = np.zeros((len(x), h), inputs.dtype), np.zeros((len(x), h), inputs.dtype)
        for t in order:
            z = inputs[:, t] + hid @ w[f"rec_{d}"]
            gates = _sigmoid(z[:, :3 * h])  # in, keep, out
            new = np.tanh(z[:, 3 * h:])
            before, cell = cell, gates[:, h:2 * h] * cell + gates[:, :h] * new
            bent = np.tanh(cell)
            if trace is not None:
                trace.append((t, hid, before, gates, new, bent))
            hid = gates[:, 2 * h:] * bent
            out[:, t] = hid
        return out

    def scores(self, x, traces=(None, None)):
        both = np.concatenate([self._direction(x, "f", traces[0]), self._direction(x, "b", traces[1])], axis=2)
        return both, both @ self.w["out"] + self.w["bias"]

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """``scores`` with time first and windows last (time, tag, window).

        One product a step takes the states, the embedded symbols and a 1 to the gates of both directions and to what
        the states before add to the scores.  Sigmoids are written by tanh, halved arguments and states by the weights:
        powers of two, so no digit changes.
        """
        w, h, (n, long) = self.w, HIDDEN, x.shape
        kind = w["embed"].dtype.type
        one, half = kind(1), kind(0.5)
        step = np.zeros((2, 4 * h + len(TAGS), h + EMBED + 1), kind)
        for i, d in enumerate("fb"):
            gate = np.concatenate([w[f"rec_{d}"] * half, w[f"in_{d}"], w[f"gate_{d}"][None]])
            gate[:, :3 * h] *= half
            step[i, :4 * h], step[i, 4 * h:, :h] = gate.T, (w["out"][i * h:(i + 1) * h] * half).T
        step[0, 4 * h:, -1] = w["bias"]
        wide = max(1, min(n, PRODUCT_WINDOWS))
        blocks = -(-n // wide)
        at = np.full((long, blocks * wide), PAD, np.intp)
        at[:, :n] = x.T
        at = at.reshape(long, blocks, wide)
        score = np.zeros((long, len(TAGS), blocks * wide), kind)
        by_block = score.reshape(long, len(TAGS), blocks, wide).transpose(0, 2, 1, 3)
        for first in range(0, blocks, STATE_WINDOWS // PRODUCT_WINDOWS):
            here = slice(first, first + STATE_WINDOWS // PRODUCT_WINDOWS)
            symbols = np.take(w["embed"], at[:, here], axis=0, mode="clip").transpose(0, 1, 3, 2)
            into = by_block[:, here]
            now = into.shape[1]
            made = np.empty((now, *step.shape[:2], wide), kind)
            flat, smooth, shown = made[:, :, :4 * h], made[:, :, :3 * h], made[:, :, 4 * h:]
            put, keep, show, new = (made[:, :, i * h:(i + 1) * h] for i in range(4))
            fed = np.zeros((now, 2, h + EMBED + 1, wide), kind)
            hid, ahead, back = fed[:, :, :h], fed[:, 0, h:-1], fed[:, 1, h:-1]
            fed[:, :, -1] = 1
            cell, bent = np.zeros((2, now, 2, h, wide), kind)
            for t in range(long + 1):
                if t < long:
                    ahead[:], back[:] = symbols[t], symbols[long - 1 - t]
                np.matmul(step, fed, out=made)
                if t:
                    into[t - 1] += shown[:, 0]
                    into[long - t] += shown[:, 1]
                np.tanh(flat, out=flat)
                np.add(smooth, one, out=smooth)
                np.multiply(cell, keep, out=cell)
                np.multiply(put, new, out=bent)
                np.add(cell, bent, out=cell)
                np.multiply(cell, half, out=cell)
                np.multiply(show, np.tanh(cell, out=bent), out=hid)
        return score[:, :, :n]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best path of each window; of equal ways the first tag counts."""
        out = np.zeros(x.shape, np.int64)
        score, change = self._columns(x), self.w["change"]
        some = np.flatnonzero(self._bound(score) > -BOUND_MARGIN)  # elsewhere O throughout is the best path
        score = np.take(score, some, axis=2)
        best = np.empty_like(score)
        best[0] = score[0]
        ways = np.empty((*change.shape, len(some)), score.dtype)
        for t in range(1, len(score)):
            np.add(best[t - 1][:, None, :], change[:, :, None], out=ways)
            np.add(ways.max(0), score[t], out=best[t])
        best, into = np.ascontiguousarray(best.transpose(0, 2, 1)), np.ascontiguousarray(change.T)
        path = np.empty((len(score), len(some)), np.int64)
        path[-1] = best[-1].argmax(1)
        for t in range(len(score) - 1, 0, -1):
            path[t - 1] = (best[t - 1] + into[path[t]]).argmax(1)
        out[some] = path.T
        return out

    def _bound(self, score: np.ndarray) -> np.ndarray:
        """What a run of other tags can gain over O throughout, at most, by window: each place with its best B or I, each
        change with the best of its sort.  A path is O and such runs, so where no run gains, no path does."""
        change = self.w["change"] - self.w["change"][0, 0]
        sorts = slice(1, None, 2), slice(2, None, 2)  # B, I
        opening = np.array([[change[0, q].max()] for q in sorts])
        inside = np.array([[[change[p, q].max()] for q in sorts] for p in sorts])
        closing = np.array([[change[p, 0].max()] for p in sorts])
        gain = np.stack([score[:, q].max(1) for q in sorts], axis=1) - score[:, :1]
        run = gain[0]
        top = run + closing
        for now in gain[1:]:
            run = np.maximum((run[:, None] + inside).max(0), opening) + now
            np.maximum(top, run + closing, out=top)
        return np.maximum(top, run).max(0)  # the last may go on to the end

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        w, n, long, h = self.w, len(x), x.shape[1], HIDDEN
        traces: tuple[list, list] = ([], [])
        both, score = self.scores(x, traces)
        change, rows = w["change"], np.arange(n)

        def total(a, axis):
            top = a.max(axis, keepdims=True)
            return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)

        ahead, behind = [score[:, 0]], [np.zeros_like(score[:, 0])]
        for t in range(1, long):
            ahead.append(total(ahead[-1][:, :, None] + change, 1) + score[:, t])
        for t in range(long - 1, 0, -1):
            behind.append(total(change + (score[:, t] + behind[-1])[:, None, :], 2))
        behind.reverse()
        whole = total(ahead[-1], 1)
        gold = score[rows[:, None], np.arange(long), y].sum() + change[y[:, :-1], y[:, 1:]].sum()
        g_score = np.exp(np.stack(ahead, 1) + np.stack(behind, 1) - whole[:, None, None])
        g_change = np.zeros_like(change)
        for t in range(1, long):
            g_change += np.exp(ahead[t - 1][:, :, None] + change + (score[:, t] + behind[t])[:, None, :] - whole[:, None, None]).sum(0)
        np.subtract.at(g_score, (rows[:, None], np.arange(long), y), 1)
        np.subtract.at(g_change, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {"out": np.einsum("nth,ntk->hk", both, g_score), "bias": g_score.sum((0, 1)), "change": g_change,
             "embed": np.zeros_like(w["embed"])}
        g_both = g_score @ w["out"].T
        for d, trace, g_out in (("f", traces[0], g_both[..., :h]), ("b", traces[1], g_both[..., h:])):
            g_table, g_rec = np.zeros((SYMBOLS, 4 * h)), np.zeros_like(w[f"rec_{d}"])
            g_hid, g_cell = np.zeros((n, h)), np.zeros((n, h))
            for t, hid, before, gates, new, bent in reversed(trace):
                g_h = g_hid + g_out[:, t]
                i, keep, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                g_c = g_cell + g_h * o * (1 - bent ** 2)
                g_z = np.concatenate([g_c * new * i * (1 - i), g_c * before * keep * (1 - keep), g_h * bent * o * (1 - o),
                                      g_c * i * (1 - new ** 2)], axis=1)
                g_rec += hid.T @ g_z
                np.add.at(g_table, x[:, t], g_z)
                g_hid, g_cell = g_z @ w[f"rec_{d}"].T, g_c * keep
            g[f"rec_{d}"], g[f"gate_{d}"] = g_rec, g_table.sum(0)
            g[f"in_{d}"] = w["embed"].T @ g_table
            g["embed"] += g_table @ w[f"in_{d}"].T
        return float(whole.sum() - gold) / n, {k: v / n for k, v in g.items()}


def encode_windows(texts: list[str], width: int = WINDOW) -> np.ndarray:
    x = np.zeros((len(texts), width), np.int64)
    for i, t in enumerate(texts):
        x[i, :len(t)] = char_table()[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
    return x


@lru_cache(maxsize=1)
def trained_tagger() -> Tagger:
    """Adam on invented labelled windows; deterministic, a few seconds, once per driver process."""
    sample = labelled_windows(TRAIN_WINDOWS, TRAIN_SEED)
    x = encode_windows([t for t, _ in sample])
    y = np.stack([np.pad(tags_of(s, len(t)), (0, WINDOW - len(t))) for t, s in sample])
    tagger, rng = Tagger.start(TRAIN_SEED), np.random.default_rng(TRAIN_SEED)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v = {k: np.zeros_like(w) for k, w in tagger.w.items()}
    for step in range(1, TRAIN_ROUNDS + 1):
        pick = rng.choice(len(x), TRAIN_BATCH, replace=False)
        _, g = tagger.gradient(x[pick], y[pick])
        size = np.sqrt(sum((a ** 2).sum() for a in g.values()))
        rate = TRAIN_STEP * min(1, 2 * (1 - step / (TRAIN_ROUNDS + 1)))
        for k in g:
            a = g[k] * min(1, 5 / size)
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a ** 2
            tagger.w[k] = tagger.w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return Tagger({k: w.astype(np.float32) for k, w in tagger.w.items()})


# ---- texts -------------------------------------------------------------------------

_ANCHOR = re.compile("[0-9@]")
#: The learnt emails without an @.
_SPELT_AT = re.compile(r"\(at\)| at ")
#: Characters beside a spelt at that a learnt email reaches.
_SPELT_REACH = 32


def window_numbers(text: str) -> np.ndarray:
    """Numbers k of the windows [k * STRIDE, k * STRIDE + WINDOW) that hold a digit, an @ or a part of
    what a spelt-out @ reaches, in order.  Spans may go on beyond them: the operator runs every window."""
    held = [m.start() // STRIDE for m in _ANCHOR.finditer(text)]
    for m in _SPELT_AT.finditer(text):
        held.extend(range(max(0, m.start() - _SPELT_REACH) // STRIDE, min(len(text) - 1, m.end() + _SPELT_REACH) // STRIDE + 1))
    last = np.unique(np.array(held, np.int64))
    return np.unique(np.concatenate([last - i for i in range(WINDOW // STRIDE)]).clip(0)) if len(last) else last


def of_learnt_form(kind: str, text: str, start: int, end: int) -> bool:
    """All learnt forms hold a digit or an @, but for emails with a spelt-out @."""
    return bool(_ANCHOR.search(text, start, end) or kind == "email" and _SPELT_AT.search(text, start, end))


def reconcile(size: int, numbers: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One tag for each character of a text from the tags of its windows: that of the window in which
    it lies deepest.  Windows of equal parity do not overlap, so each parity fills an array of its own."""
    depth = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)).astype(np.int8)
    best, deep = np.zeros(size + WINDOW, np.uint8), np.full(size + WINDOW, -1, np.int8)
    for parity in range(WINDOW // STRIDE):
        own = numbers % (WINDOW // STRIDE) == parity
        places = (numbers[own, None] * STRIDE + np.arange(WINDOW)).ravel()
        inside = places < size + WINDOW
        places, got = places[inside], tags[own].ravel()[inside]
        here = np.tile(depth, int(own.sum()))[inside]
        better = here > deep[places]
        best[places[better]], deep[places[better]] = got[better], here[better]
    return best[:size]


def tagged_spans(tags: np.ndarray) -> list[Span]:
    """Spans of a tag sequence: a B and the I of its kind that follow."""
    tags = np.pad(tags, 1)
    here, before = tags[1:], tags[:-1]
    goes_on = (here > 0) & (here % 2 == 0) & ((before == here) | (before == here - 1))
    start = np.flatnonzero(here % 2)
    edges = np.flatnonzero((before > 0) & ~goes_on)
    end = edges[np.searchsorted(edges, start, side="right")]
    return [(KINDS[k], a, b) for k, a, b in zip((here[start] // 2).tolist(), start.tolist(), end.tolist(), strict=True)]


def symbol_windows(text: str, first: int, behind: int) -> np.ndarray:
    """Symbols of the windows ``first`` to ``behind`` - 1 of a text, padded at its end."""
    part = text[first * STRIDE:(behind - 1) * STRIDE + WINDOW]
    line = np.full((behind - first + WINDOW // STRIDE - 1) * STRIDE, PAD, np.int16)
    line[:len(part)] = char_table()[np.frombuffer(part.encode("utf-32-le"), np.uint32)]
    blocks = line.reshape(-1, STRIDE)
    return np.concatenate([blocks[i:i + behind - first] for i in range(WINDOW // STRIDE)], axis=1)


def tagged_windows(texts: list[str], tagger: Tagger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, tags) of the windows with any tag but O, in order; all windows of all texts are decoded."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WINDOW), np.uint8))]
    run: list[tuple[int, int, int]] = []
    held = 0

    def decode():
        tags = tagger.viterbi(np.concatenate([symbol_windows(texts[i], a, b) for i, a, b in run]))
        hit = np.flatnonzero(tags.any(1))
        owner = np.repeat([i for i, _, _ in run], [b - a for _, a, b in run])
        number = np.concatenate([np.arange(a, b) for _, a, b in run])
        out.append((owner[hit], number[hit], tags[hit].astype(np.uint8)))

    for i, text in enumerate(texts):
        first, count = 0, -(-len(text) // STRIDE)
        while first < count:
            behind = min(count, first + RUN_WINDOWS - held)
            run.append((i, first, behind))
            held, first = held + behind - first, behind
            if held == RUN_WINDOWS:
                decode()
                run, held = [], 0
    if run:
        decode()
    owner, number, tags = (np.concatenate(c) for c in zip(*out, strict=True))
    return owner, number, tags


def text_tags(sizes: np.ndarray, owner: np.ndarray, numbers: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``reconcile`` over all windows of texts, of which ``owner`` and ``numbers`` are those with any tag but O: the
    others count where they share characters with these.  The texts lie one behind the other, a window's length
    apart or more; their starts are returned, too."""
    counts = -(-sizes // STRIDE)
    first = np.concatenate([[0], np.cumsum(counts + WINDOW // STRIDE)])
    placed = first[owner] + numbers
    near = np.unique(np.concatenate([placed + i for i in range(1 - WINDOW // STRIDE, WINDOW // STRIDE)]))
    text = np.searchsorted(first, near, side="right") - 1
    near = near[(near >= 0) & (near - first[text] < np.append(counts, 0)[text])]
    every = np.zeros((len(near), WINDOW), np.uint8)
    every[np.searchsorted(near, placed)] = tags
    starts = first[:-1] * STRIDE
    line = reconcile(int(first[-1]) * STRIDE, near, every)
    at = np.flatnonzero(line)
    line[at[at - starts[text_of := np.searchsorted(starts, at, side="right") - 1] >= sizes[text_of]]] = 0
    return line, starts


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Spans that the tagger adds to the base spans of each text."""
    owner, number, tags = tagged_windows(texts, tagger)
    out: list[list[Span]] = [[] for _ in texts]
    if not len(owner):
        return out
    line, starts = text_tags(np.array([len(t) for t in texts]), owner, number, tags)
    spans = [s for s in tagged_spans(line) if LENGTHS[s[0]][0] <= s[2] - s[1] <= LENGTHS[s[0]][1]]
    whose = np.searchsorted(starts, [a for _, a, _ in spans], side="right") - 1
    last = -1
    for i, (kind, a, b) in zip(whose.tolist(), spans, strict=True):
        if i != last:
            # Both lists are in order: reach is the furthest end of the base spans that begin before b.
            last, held, k, reach = i, sorted((x, y) for _, x, y in base[i]), 0, 0
        a, b = a - int(starts[i]), b - int(starts[i])
        while k < len(held) and held[k][0] < b:
            k, reach = k + 1, max(reach, held[k][1])
        if reach <= a and of_learnt_form(kind, texts[i], a, b):
            out[i].append((kind, a, b))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans`` array<struct<kind, start, end, base>> of every whole text, base and added."""
    check_columns(docs, id_col, text_col)
    weights = trained_tagger().w
    (text,) = fresh(docs, "text")
    source = docs.select(col(id_col), col(text_col).cast("string").alias(text))
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]
    span_type = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                              T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    out_schema = T.StructType([source.schema[0], T.StructField("spans", T.ArrayType(span_type))])

    def run(batches):
        tagger = Tagger(weights)
        for batch, texts in text_slices(batches, text):
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, tagger)
            spans = [[dict(zip(("kind", "start", "end", "base"), (*s, own), strict=True))
                      for s, own in sorted([*[(s, True) for s in b], *[(s, False) for s in a]],
                                           key=lambda x: (x[0][1], KINDS.index(x[0][0])))]
                     for b, a in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct(fields)))],
                                             names=[id_col, "spans"])

    return source.mapInArrow(run, out_schema)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
