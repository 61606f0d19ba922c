"""Token counts by compiled finite-state transducers.

Two deterministic machines count the tokens of a byte-level BPE:

* The *splitter* reads character classes and marks where pieces begin.  It is
  compiled from the pre-tokenizer's rules to a table of 12 states by 11
  classes whose transitions emit marks (before this character, before the
  one before).  A long stream of characters is cut into chunks; for each
  chunk the machine runs from every state at once, which gives the chunk's
  state map; the maps compose by a parallel prefix scan to the state in which
  each chunk really starts; a second pass emits the marks.  All chunks of a
  batch, of one long text or of many short ones, move in step inside numpy.
* The *counter* reads the bytes of a piece.  Its transitions are annotated
  with the change of the token count.  A state holds, for every suffix of the
  piece that a longer token could still start with, the last token and the
  count before that suffix: all that the exact encoding of any continuation
  depends on.  States and transitions are compiled when first needed, are
  shared by all pieces of a worker, and are dropped when there are too many,
  inside a long piece as well.

Defined cases: a null text has no tokens; special strings inside a text count
as one token each, as the library does by default; an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import RecentMap, Vocabulary, read_tokenizer, segments
from .common import SLICE_CHARS, check_columns, col, fresh, text_slices

#: Character classes of the splitter.
SP, WS, LETTER, NUMBER, OTHER, APOS, STMD, RV, E, ELL, END = range(11)
#: States: nothing read, in letters, in numbers, in other signs, one or more white characters (the last
#: one a space or not), after an apostrophe, after 'r or 'v, after 'l, after a whole contraction.
START, IN_L, IN_N, IN_O, ONE_SP, ONE_WS, MORE_SP, MORE_WS, AP, AP_RV, AP_L, DONE = range(12)
STATES, CLASSES = 12, 11
HERE, BEFORE = 1, 2  # marks: a piece begins at this character; at the one before
CHUNK = 256
KEEP_PIECES = 250_000
KEEP_STATES = 100_000


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks), both indexed by class * STATES + state."""
    step, marks = np.zeros(STATES * CLASSES, np.uint8), np.zeros(STATES * CLASSES, np.uint8)
    letters = {LETTER, STMD, RV, E, ELL}

    def fresh_piece(c):
        """State after a character that begins a piece."""
        return (START if c == END else ONE_SP if c == SP else ONE_WS if c == WS else IN_L if c in letters
                else IN_N if c == NUMBER else AP if c == APOS else IN_O)

    for state in range(STATES):
        for c in range(CLASSES):
            to, mark = fresh_piece(c), HERE  # a new piece, unless something goes on
            white, open_white = c in (SP, WS), state in (ONE_SP, ONE_WS, MORE_SP, MORE_WS)
            if state == IN_L and c in letters or state == IN_N and c == NUMBER:
                to, mark = state, 0
            elif state == IN_O and c in (OTHER, APOS) or state == AP and c in (OTHER, APOS):
                to, mark = IN_O, 0
            elif open_white and white:
                to, mark = (MORE_SP if c == SP else MORE_WS), 0
            elif open_white and c != END:
                # The last white character leaves a longer run; a space joins what follows.
                mark = BEFORE if state in (MORE_SP, MORE_WS) else 0
                if state in (ONE_SP, MORE_SP):
                    to = IN_O if c == APOS else to
                else:
                    mark |= HERE
            elif state == AP and c in (STMD, RV, ELL):
                to, mark = {STMD: DONE, RV: AP_RV, ELL: AP_L}[c], 0
            elif state == AP_RV and c == E or state == AP_L and c == ELL:
                to, mark = DONE, 0
            elif state in (AP_RV, AP_L):  # no contraction: the letter began a piece
                to, mark = (IN_L, BEFORE) if c in letters else (to, BEFORE | HERE)
            elif state == AP and c in letters:
                to, mark = IN_L, HERE
            step[c * STATES + state], marks[c * STATES + state] = to, mark
    return step, marks


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WS)):
        for m in regex.finditer(pattern, every):
            table[ord(m.group()[0]):ord(m.group()[-1]) + 1] = c
    for chars, c in ((" ", SP), ("'", APOS), ("stmd", STMD), ("rv", RV), ("e", E), ("l", ELL)):
        for ch in chars:
            table[ord(ch)] = c
    return table


STEP, MARKS = compile_splitter()


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """State maps of chunks (rows of ``symbols``): the exit state for every entry state."""
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(symbols), STATES)).copy()
    offset = symbols.astype(np.intp) * STATES
    for t in range(symbols.shape[1]):
        maps = STEP[offset[:, t, None] + maps]
    return maps


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps, in log2(n) parallel rounds."""
    out, gap = maps.copy(), 1
    while gap < len(out):
        # out[i] after out[i - gap]: first the earlier chunks, then this one.
        out[gap:] = np.take_along_axis(out[gap:], out[:-gap].astype(np.intp), axis=1)
        gap *= 2
    return out


def piece_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which pieces begin in a stream of classes (END marks a piece of its own)."""
    n = len(classes)
    rows = -(-n // chunk)
    symbols = np.full(rows * chunk, END, np.uint8)
    symbols[:n] = classes
    symbols = symbols.reshape(rows, chunk)
    state = np.full(rows, START, np.uint8)
    state[1:] = scan_maps(chunk_maps(symbols))[:-1, START]
    marks = np.zeros((rows, chunk), np.uint8)
    offset = symbols.astype(np.intp) * STATES
    for t in range(chunk):
        at = offset[:, t] + state
        marks[:, t] = MARKS[at]
        state = STEP[at]
    marks = marks.reshape(-1)
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins[:n])


class CountTransducer:
    """Counts the BPE tokens of a piece; transitions emit the change of the count."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.child: dict[int, int] = {}            # node << 8 | byte -> node
        self.token, self.depth, self.link = [-1], [0], [0]
        for data, token in vocab.ids.items():
            node = 0
            for b in data:
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.link.append(0)
                node = to
            self.token[node] = token
        for key, to in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            if self.depth[to] > 1:  # the links of shorter nodes are known by now
                self.link[to] = self.go(self.link[key >> 8], key & 255)
        self.open = {key >> 8 for key in self.child}  # nodes that a longer token goes through
        self.suffixes: dict[int, tuple[int, ...]] = {}
        self.plans: dict[int, tuple] = {}
        self.reset()

    def go(self, node: int, b: int) -> int:
        """Longest suffix of node's string and b that begins a token."""
        while True:
            to = self.child.get(node << 8 | b)
            if to is not None:
                return to
            if node == 0:
                return 0
            node = self.link[node]

    def open_suffixes(self, node: int) -> tuple[int, ...]:
        """Suffixes of a node, itself first, that a longer token could start with; the empty one is last."""
        found = self.suffixes.get(node)
        if found is None:
            chain = [node]
            while chain[-1]:
                chain.append(self.link[chain[-1]])
            found = self.suffixes[node] = tuple(n for n in chain if n in self.open)
        return found

    def plan(self, node: int, b: int) -> tuple:
        """What byte b does at a node: (next node, [(token ending here, place of its start in the
        past)], [place in the past of what the next state keeps])."""
        to = self.go(node, b)
        place = {self.depth[n]: i for i, n in enumerate(self.open_suffixes(node))}
        ends, chain = [], to
        while chain:
            if self.token[chain] >= 0:
                ends.append((self.token[chain], place[self.depth[chain] - 1]))
            chain = self.link[chain]
        keeps = [place[self.depth[n] - 1] for n in self.open_suffixes(to) if n]
        found = self.plans[node << 8 | b] = to, ends, keeps
        return found

    def reset(self) -> None:
        #: state -> (node, ((last token before a suffix, count there less the count now), ...)), by open suffix
        self.states = [(0, ((-1, 0),))]
        self.known = {self.states[0]: 0}
        self.moves: dict[int, int] = {}  # state << 8 | byte -> next state << 8 | change + 128

    def compile_move(self, state: int, b: int) -> int:
        node, past = self.states[state]
        to, ends, keeps = self.plans.get(node << 8 | b) or self.plan(node, b)
        for token, start in ends:
            before, count = past[start]
            if before < 0 or self.vocab.follows(before, token):
                break
        change = count + 1
        new = to, (*[(past[k][0], past[k][1] - change) for k in keeps], (token, 0))
        move = self.moves[state << 8 | b] = self.number_of(new) << 8 | change + 128
        return move

    def number_of(self, state: tuple) -> int:
        number = self.known.get(state)
        if number is None:
            number = self.known[state] = len(self.states)
            self.states.append(state)
        return number

    def count(self, piece: str) -> int:
        state = total = 0
        find = self.moves.get
        data = piece.encode()
        for b in data:
            move = find(state << 8 | b)
            if move is None:
                if len(self.states) > KEEP_STATES:  # inside a piece too: the state goes on under a new number
                    here = self.states[state]
                    self.reset()
                    state, find = self.number_of(here), self.moves.get
                move = self.compile_move(state, b)
            state = move >> 8
            total += move & 255
        return total - 128 * len(data)


class TokenCounter:
    def __init__(self, spec_json: str):
        self.vocab = Vocabulary(spec_json)
        self.machine = CountTransducer(self.vocab)
        self.known = RecentMap(self.machine.count, KEEP_PIECES)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the texts form streams of bounded length, with END between them."""
        totals, spans, owner, size = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            for k, span in enumerate(self.vocab.split_specials.split(text) if self.vocab.specials else [text]):
                if k % 2:
                    totals[i] += 1
                    continue
                for part in segments(span):
                    spans.append(part)
                    owner.append(i)
                    size += len(part)
                    if size > SLICE_CHARS:
                        np.add.at(totals, owner, self.count_spans(spans))
                        spans, owner, size = [], [], 0
        if spans:
            np.add.at(totals, owner, self.count_spans(spans))
        return totals

    def count_spans(self, spans: list[str]) -> np.ndarray:
        """Tokens of each span, in one stream."""
        # One END after each span: its position is known, so any character may stand for it.
        stream = "\n".join(spans) + "\n"
        ends = np.cumsum([len(s) + 1 for s in spans]) - 1
        classes = class_table()[np.frombuffer(stream.encode("utf-32-le"), np.uint32)]
        classes[ends] = END
        starts = piece_starts(classes)
        cuts = starts.tolist()
        pieces = [stream[a:b] for a, b in zip(cuts, [*cuts[1:], len(stream)], strict=True)]
        counts = np.array(self.known.all(pieces), np.int64)
        counts[classes[starts] == END] = 0
        return np.add.reduceat(counts, np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1])))


@lru_cache(maxsize=2)
def counter(spec_json: str) -> TokenCounter:
    """The worker's machines; they live as long as the Python worker."""
    return TokenCounter(spec_json)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every whole text."""
    check_columns(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # the size of the vocabulary
    (text,) = fresh(docs, "text")
    source = docs.select(col(id_col), col(text_col).cast("string").alias(text))
    out_schema = T.StructType([source.schema[0], T.StructField("n_bytes", T.LongType()),
                               T.StructField("n_tokens", T.LongType())])

    def run(batches):
        machines = counter(spec.value)
        for batch, texts in text_slices(batches, text):
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(machines.count(texts), pa.int64())],
                                             names=[id_col, "n_bytes", "n_tokens"])

    return source.mapInArrow(run, out_schema)

