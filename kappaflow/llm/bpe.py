"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For a piece of text, the exact encoding of every prefix ends in one token
that is unique.  A suffix-link automaton over the vocabulary gives, at every
byte, all tokens that end there; the one that may follow the last token of
the shorter prefix (pair-compatibility test) is that prefix's last token.
Back-pointers from the end of the piece emit the ids.  Time is linear in the
text, whatever the merges; there is no merge loop and no heap.

Pieces repeat, so each worker keeps a bounded table of short pieces it has solved.
Texts are read in segments cut before white space that follows other text,
where the tokenizer always splits, so memory depends on the length of a text only by
the text itself and its ids; a piece without white space takes four bytes more for each of its own.

Tokens that their own merges cannot make are left out of the automaton: the library never
gives them.

The tokenizer file is read once by the driver (``path`` may be local to it)
and sent to the tasks; its size is that of the vocabulary.

Defined cases: a null text counts as empty and has no tokens; special strings
inside a text become their special token, as the library does by default; an
empty table gives an empty result; no column but id and text is read unless
asked for in ``keep``.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_columns, col, fresh, text_slices

#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Solved pieces (in each of two generations) and tested token pairs that a worker keeps.
KEEP_PIECES = 250_000
KEEP_PAIRS = 400_000
#: Longer pieces (characters) are solved each time they come, so the table of pieces is bounded in bytes too.
KEEP_LENGTH = 64
#: Pieces of more bytes are solved front to back with one number a byte.
LONG_PIECE = 20_000
#: Characters of a text that are split into pieces at once.
SEGMENT_CHARS = 1_000_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others get the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RecentMap(dict):
    """Results by key in two generations: when the young one is full it becomes the old one,
    so that what is asked for again stays and memory is bounded; long keys are not kept."""

    def __init__(self, solve, size: int):
        super().__init__()
        self.solve, self.size, self.old = solve, size, {}

    def all(self, keys: list) -> list:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        found = list(map(self.get, keys))
        if None in found:
            old, solve = self.old, self.solve
            for i, value in enumerate(found):
                if value is None:
                    key = keys[i]
                    value = self.get(key)  # solved a moment ago
                    if value is None:
                        value = old.get(key)
                        if value is None:
                            value = solve(key)
                        if not isinstance(key, str) or len(key) <= KEEP_LENGTH:
                            self[key] = value
                    found[i] = value
        return found


class Vocabulary:
    """Tokens, merge order and special tokens of a byte-level BPE file."""

    def __init__(self, spec_json: str):
        spec = json.loads(spec_json)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and not any(model.get(k) for k in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        if not plain:
            raise ValueError("only plain byte-level BPE without normalizer or prefix space")
        letters = byte_letters()
        self.specials = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"added token {t['content']!r} has matching rules that are not built")
            self.specials[t["content"]] = t["id"]
        self.split_specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.specials) + ")") if self.specials else None
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.rank = [NEVER] * len(self.bytes)       # token -> place of the merge that makes it
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}  # pair -> place of its merge
        for place, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[left + right]
            if made in self.parts:
                raise ValueError(f"two merges make token {made}")
            if any(len(self.bytes[vocab[p]]) > 1 and vocab[p] not in self.parts for p in (left, right)):
                raise ValueError(f"merge {place} comes before those that make its parts")
            self.parts[made] = vocab[left], vocab[right]
            self.rank[made] = place
            self.merge[vocab[left], vocab[right]] = place
        self.ids = {b: i for i, b in enumerate(self.bytes) if b and i not in self.specials.values()}
        made = self.reachable()
        self.ids = {b: i for b, i in self.ids.items() if i in made}
        self.pairs: dict[int, bool] = {}

    def reachable(self) -> set[int]:
        """Tokens that the merges make of their own bytes; any other one never stands in an encoding."""
        made = {i for b, i in self.ids.items() if len(b) == 1}
        for i in sorted(self.parts, key=lambda i: len(self.bytes[i])):
            a, b = self.parts[i]
            if a in made and b in made and self.meet(a, b)[1]:
                made.add(i)
        return made

    @lru_cache(maxsize=200_000)  # noqa: B019  one vocabulary per worker
    def edge(self, token: int, right: bool) -> tuple[int, ...]:
        """Tokens at one edge of a token, from its outermost byte up to itself."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][right])
        return tuple(reversed(out))

    def meet(self, a: int, b: int) -> tuple[bool, bool]:
        """Whether BPE merges across the boundary between a and b, and whether it does so with both whole.

        Both tokens grow in merge order.  At each moment one token touches the
        boundary from either side; they would merge if their pair's place is
        before the next merge on the left and not after the next one on the
        right (equal pairs merge from left to right).
        """
        xs, ys, i, j = self.edge(a, True), self.edge(b, False), 0, 0
        rank, merge = self.rank, self.merge
        while True:
            next_x = rank[xs[i + 1]] if i + 1 < len(xs) else NEVER
            next_y = rank[ys[j + 1]] if j + 1 < len(ys) else NEVER
            here = merge.get((xs[i], ys[j]), NEVER)
            if here < next_x and here <= next_y:
                return True, next_x == next_y == NEVER
            if next_x == next_y == NEVER:
                return False, False
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between a and b alone."""
        return not self.meet(a, b)[0]

    def follows(self, a: int, b: int) -> bool:
        """``compatible`` with a bounded memory."""
        key = a * len(self.bytes) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.compatible(a, b)
        return known


class PrefixEncoder:
    """Encodes pieces by the last token of each prefix."""

    def __init__(self, spec_json: str):
        self.vocab = Vocabulary(spec_json)
        self.width = [len(b) for b in self.vocab.bytes]
        self.matches = ahocorasick.Automaton()
        for data, i in self.vocab.ids.items():
            self.matches.add_word(data.decode("latin-1"), i)
        self.matches.make_automaton()
        self.known = RecentMap(self.encode_piece, KEEP_PIECES)
        self.find_pieces = regex.compile(PIECES).findall

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a piece as 32-bit integers.

        ``last[n]`` is the last token of the prefix of n bytes, filled in for the
        prefixes that the whole piece asks for.  Each match is looked at twice at
        most, so the time is linear in the piece.
        """
        data = piece.encode().decode("latin-1")
        size = len(data)
        if size > LONG_PIECE:
            return self.encode_long(data)
        tokens, first = [], [0] * (size + 1)  # tokens ending at n start at first[n], longest first
        before = -1
        for end, token in self.matches.iter(data):
            if end != before:
                before = end
                first[end + 1] = len(tokens)
            tokens.append(token)
        width, follows = self.width, self.vocab.follows
        last, want = [-1] * (size + 1), [size]
        while want:
            n = want[-1]
            token = tokens[first[n]]
            start = n - width[token]
            if start and last[start] < 0:
                want.append(start)
            elif start == 0 or follows(last[start], token):
                last[n] = token
                want.pop()
            else:
                first[n] += 1
        out, at = [], size
        while at:
            out.append(last[at])
            at -= width[last[at]]
        return np.array(out[::-1], np.int32).tobytes()

    def encode_long(self, data: str) -> bytes:
        """The same for a long piece: every prefix from the first on, four bytes for each."""
        last = np.full(len(data) + 1, -1, np.int32)
        width, follows, done = self.width, self.vocab.follows, -1
        for end, token in self.matches.iter(data):  # by end, longest first
            if end == done:
                continue
            start = end + 1 - width[token]
            if start == 0 or follows(int(last[start]), token):
                last[end + 1] = token
                done = end
        out, at = array("i"), len(data)
        while at:
            token = int(last[at])
            out.append(token)
            at -= width[token]
        out.reverse()
        return out.tobytes()

    def encode(self, text: str) -> np.ndarray:
        found = [np.zeros(0, np.int32)]
        special = self.vocab.specials
        for i, span in enumerate(self.vocab.split_specials.split(text) if special else [text]):
            if i % 2:
                found.append(np.array([special[span]], dtype=np.int32))
            else:
                for part in segments(span):
                    found.append(np.frombuffer(b"".join(self.known.all(self.find_pieces(part))), np.int32))
        return np.concatenate(found)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of a text, cut before white space that follows something else: the pre-tokenizer
    splits there whatever comes before or after."""
    at = 0
    while len(text) - at > limit:
        cut = regex.search(r"(?<=\S)\s", text, pos=at + limit)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(spec_json: str) -> PrefixEncoder:
    """The worker's encoder; it lives as long as the Python worker."""
    return PrefixEncoder(spec_json)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of every whole text, and the text that the ids decode to.

    Returns id, the columns named in ``keep``, ``ids`` array<int> and ``decoded`` string.
    """
    check_columns(docs, id_col, text_col, *keep)
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # the size of the vocabulary
    kept = [id_col, *[k for k in keep if k != id_col]]
    (text,) = fresh(docs, "text")
    source = docs.select(*[col(c) for c in kept], col(text_col).cast("string").alias(text))
    fields = [source.schema[c] for c in kept]
    out_schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                               T.StructField("decoded", T.StringType())])

    def run(batches):
        solver = encoder(spec.value)
        for batch, texts in text_slices(batches, text):
            found = [solver.encode(t) for t in texts]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            decoded = pa.array([solver.decode(x) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], ids, decoded],
                                             names=[*kept, "ids", "decoded"])

    return source.mapInArrow(run, out_schema)


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids, ",").cast("binary"), 256)
