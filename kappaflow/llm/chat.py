"""Chat formatting by a small template compiler.

A template is plain text with tags:

    {{ expr }}                              value of an expression
    {% for m in messages %} ... {% endfor %}
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   marks text that the model learns to write

Expressions are names (``messages``, the loop variable, ``loop.first``, ``loop.index``),
the message fields ``role`` and ``text``, string and integer literals, ``+``,
``==``, ``!=``, ``and``, ``or``, ``not``, parentheses and the filters ``escape``, ``escape_line``, ``trim``, ``upper``, ``lower``.
There is nothing else: no attributes of Python objects, no calls, no
imports, so a template can only arrange the messages.  The compiler parses the
template into a syntax tree, folds constants (literal expressions, branches
whose condition is known, neighbouring texts) and turns the tree into Python
closures.  A rendered conversation is a stream of (text, learnt) pieces, made
message by message, so memory depends on one message and not on the length
of a conversation.

``escape`` makes control strings inside texts harmless, reversibly: a
backslash is doubled and ``<|`` becomes ``<\\|``; no escaped text holds ``<|``.
``escape_line`` also writes a line break as a backslash and ``n``.

Formatted conversations come in parts of bounded size, in order; usually one.

Defined cases: a null text or role counts as empty; rows of a conversation
are ordered by turn (null first), then role, then text, so ties and repeated
rows give one defined order; rows with a null id form one conversation; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_columns, col

CHATML = ("{% for m in messages %}<|im_start|>{{ m.role | escape_line }}\n"
          "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
          "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}")
#: Characters of a formatted part; a single longer piece makes a longer part.
PART_CHARS = 1_000_000


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """``escape`` for a text that must stay on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}
FIELDS = ("role", "text")
LOOP_FIELDS = ("first", "index")

# ---- syntax tree -----------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str            # + == != and or not, or a filter's name
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Out:
    expr: object


@dataclass(frozen=True)
class For:
    var: str
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple         # (condition, body) pairs; the last condition may be Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+().|]))")


class _Expression:
    """Recursive descent over one expression; ``scope`` are the loop variables in reach."""

    def __init__(self, source: str, scope: tuple[str, ...]):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.scope, self.at = scope, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if wanted and token not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted)}, found {token!r}")
        self.at += 1
        return token

    def whole(self):
        tree = self.disjunction()
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def _left(self, below, *ops):
        tree = below()
        while self.peek() in ops:
            tree = Op(self.take(), (tree, below()))
        return tree

    def disjunction(self):
        return self._left(self.conjunction, "or")

    def conjunction(self):
        return self._left(self.negation, "and")

    def negation(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negation(),))
        return self._left(self.sum, "==", "!=")

    def sum(self):
        return self._left(self.filtered, "+")

    def filtered(self):
        tree = self.atom()
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            tree = Op(name, (tree,))
        return tree

    def atom(self):
        token = self.take()
        if token == "(":
            tree = self.disjunction()
            self.take(")")
            return tree
        if token[:1] in "'\"" and token:
            plain = {"n": "\n", "t": "\t"}
            return Const(re.sub(r"\\(.)", lambda m: plain.get(m[1], m[1]), token[1:-1], flags=re.S))
        if token.isdigit():
            return Const(int(token))
        if token == "loop" and self.scope:
            self.take(".")
            return Name(("loop", self.take(*LOOP_FIELDS)))
        if token in self.scope:
            self.take(".")
            return Name((token, self.take(*FIELDS)))
        raise TemplateError(f"unknown name {token!r}")


def parse(template: str) -> tuple:
    """Syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(template):
        pieces += [("text", template[at:m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces.append(("text", template[at:]))
    place = 0

    def block(scope: tuple[str, ...], ends: tuple[str, ...], inside: bool) -> tuple[tuple, str]:
        nonlocal place
        out = []
        while place < len(pieces):
            kind, body = pieces[place]
            place += 1
            if kind == "text":
                out.append(Text(body))
            elif kind == "out":
                out.append(Out(_Expression(body, scope).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return tuple(out), body
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                    if not m or scope:
                        raise TemplateError(f"only one loop over messages at a time: {body!r}")
                    out.append(For(m[1], block((m[1],), ("endfor",), inside)[0]))
                elif word == "if":
                    cases, condition = [], _Expression(rest, scope).whole()
                    while True:
                        inner, end = block(scope, ("elif", "else", "endif"), inside)
                        cases.append((condition, inner))
                        end, _, rest = end.partition(" ")
                        if end == "endif":
                            break
                        condition = Const(True) if end == "else" else _Expression(rest, scope).whole()
                    out.append(If(tuple(cases)))
                elif word == "generation" and not inside:
                    out.append(Generation(block(scope, ("endgeneration",), True)[0]))
                else:
                    raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(out), ""

    return block((), (), False)[0]


# ---- constant folding ------------------------------------------------------

OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else str(a) + str(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a,
    **{name: (lambda f: lambda a: f(str(a)))(f) for name, f in FILTERS.items()}}


def fold_expression(tree):
    if not isinstance(tree, Op):
        return tree
    args = tuple(map(fold_expression, tree.args))
    if tree.kind in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (tree.kind == "and") else args[0]
    elif all(isinstance(a, Const) for a in args):
        return Const(OPS[tree.kind](*[a.value for a in args]))
    return Op(tree.kind, args)


def fold(nodes: Iterable) -> tuple:
    """The same output from fewer nodes."""
    out: list = []

    def put(node):
        if isinstance(node, Text):
            if out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + node.value)
            elif node.value:
                out.append(node)
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Out):
            expr = fold_expression(node.expr)
            put(Text(str(expr.value)) if isinstance(expr, Const) else Out(expr))
        elif isinstance(node, If):
            cases = []
            for condition, body in node.cases:
                condition = fold_expression(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold(body)))
                if isinstance(condition, Const):
                    break
            if cases and isinstance(cases[0][0], Const):
                for inner in cases[0][1]:
                    put(inner)
            elif cases:
                put(If(tuple(cases)))
        elif isinstance(node, For):
            put(For(node.var, fold(node.body)))
        elif isinstance(node, Generation):
            put(Generation(fold(node.body)))
        else:
            put(node)
    return tuple(out)


# ---- closures --------------------------------------------------------------

Pieces = Iterator[tuple[str, bool]]


def _value(tree) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda env, v=tree.value: v
    if isinstance(tree, Name):
        owner, field = tree.path
        return lambda env: env[owner][field]
    args = [_value(a) for a in tree.args]
    if tree.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if tree.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    op = OPS[tree.kind]
    if len(args) == 1:
        return lambda env, a=args[0]: op(a(env))
    return lambda env, a=args[0], b=args[1]: op(a(env), b(env))


def _render(nodes: tuple, learnt: bool) -> Callable[[dict, Iterable[dict]], Pieces]:
    steps: list[Callable[[dict, Iterable[dict]], Pieces]] = []
    for node in nodes:
        if isinstance(node, Text):
            steps.append(lambda env, messages, piece=((node.value, learnt),): iter(piece))
        elif isinstance(node, Out):
            steps.append(lambda env, messages, f=_value(node.expr): iter(((str(f(env)), learnt),)))
        elif isinstance(node, Generation):
            steps.append(_render(node.body, True))
        elif isinstance(node, For):
            def loop(env, messages, var=node.var, body=_render(node.body, learnt)):
                for i, message in enumerate(messages):
                    yield from body({**env, var: message, "loop": {"first": i == 0, "index": i + 1}}, messages)
            steps.append(loop)
        else:
            def choose(env, messages, cases=tuple((_value(c), _render(b, learnt)) for c, b in node.cases)):
                for condition, body in cases:
                    if condition(env):
                        yield from body(env, messages)
                        return
            steps.append(choose)

    def run(env, messages):
        for step in steps:
            yield from step(env, messages)

    return run


def _loops(nodes: tuple) -> int:
    return sum(1 if isinstance(n, For) else sum(_loops(b) for _, b in n.cases) if isinstance(n, If)
               else _loops(n.body) if isinstance(n, Generation) else 0 for n in nodes)


def compile_template(template: str) -> Callable[[Iterable[dict]], Pieces]:
    """Function from messages (dicts with role and text, any iterable) to (text, learnt) pieces."""
    tree = fold(parse(template))
    if _loops(tree) > 1:
        raise TemplateError("messages are streamed, so a template loops over them once")
    run = _render(tree, False)
    return lambda messages: run({}, messages)


# ---- on Spark --------------------------------------------------------------


def format_conversations(conversations: DataFrame, template: str = CHATML, id_col: str = "conv_id",
                         part_chars: int = PART_CHARS) -> DataFrame:
    """Parts of formatted conversations: id, part, text, loss_spans (start, end in the part) and last.

    The parts of a conversation follow each other inside one partition, in order.
    """
    check_columns(conversations, id_col, "turn", "role", "text")
    compile_template(template)  # report errors here, not in the tasks
    rows = (conversations.select(col(id_col).alias("id"), col("turn").alias("turn"),
                                 F.coalesce(col("role").cast("string"), F.lit("")).alias("role"),
                                 F.coalesce(col("text").cast("string"), F.lit("")).alias("text"))
            .repartition("id").sortWithinPartitions("id", "turn", "role", "text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out_schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("part", T.LongType()),
                               T.StructField("text", T.StringType()), T.StructField("loss_spans", T.ArrayType(span)),
                               T.StructField("last", T.BooleanType())])

    def run(batches):
        render = compile_template(template)
        id_type = pa.null()

        def stream():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("id").type
                yield from zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(),
                               batch.column("text").to_pylist(), strict=True)

        rows_ = stream()
        row = next(rows_, None)
        out: list[tuple] = []

        def flush():
            got = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.int64()),
                 pa.array([r[2] for r in out], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in out],
                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([r[4] for r in out], pa.bool_())], names=[id_col, "part", "text", "loss_spans", "last"])
            out.clear()
            return got

        held = 0
        while row is not None:
            conv = row[0]

            def messages():
                nonlocal row
                while row is not None and row[0] == conv:
                    role, text = row[1], row[2]
                    row = next(rows_, None)
                    yield {"role": role, "text": text}

            number, texts, spans, size = 0, [], [], 0
            stream_of = messages()
            for piece, learnt in render(stream_of):
                if size and size + len(piece) > part_chars:
                    out.append((conv, number, "".join(texts), spans, False))
                    held += size
                    number, texts, spans, size = number + 1, [], [], 0
                    if held > part_chars:
                        yield flush()
                        held = 0
                if learnt and piece:
                    if spans and spans[-1][1] == size:
                        spans[-1] = (spans[-1][0], size + len(piece))
                    else:
                        spans.append((size, size + len(piece)))
                texts.append(piece)
                size += len(piece)
            for _ in stream_of:  # a template without a loop leaves the messages unread
                pass
            out.append((conv, number, "".join(texts), spans, True))
            held += size
            if held > part_chars:
                yield flush()
                held = 0
        if out:
            yield flush()

    return rows.mapInArrow(run, out_schema)


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(parts: DataFrame, id_col: str = "conv_id", in_order: bool = True) -> DataFrame:
    """What a reader of ChatML text finds in formatted conversations, from the parts alone.

    Returns id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    Reads the parts in the order in which ``format_conversations`` leaves them; a part that does not follow the
    one before it is an error.  Parts that were stored and read again have no such order: with ``in_order=False`` those
    of a conversation are brought together and sorted first.
    """
    out_schema = T.StructType([parts.schema[id_col], T.StructField("n_turns", T.LongType()),
                               T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                               T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    source = parts.select(col(id_col), "text", "loss_spans", "last", "part")
    if not in_order:
        source = source.repartition(col(id_col)).sortWithinPartitions(col(id_col), "part")

    def run(batches):
        open_conv, due = None, 0
        rest, turns, n_turns, loss, n_loss, n_chars, broken = "", hashlib.sha256(), 0, hashlib.sha256(), 0, 0, ""
        for batch in batches:
            out = []
            for conv, text, spans, last, part in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if part != due or due and conv != open_conv:
                    raise ValueError(f"part {part} of conversation {conv} where part {due} of {open_conv if due else 'another'} is due")
                open_conv, due = conv, 0 if last else part + 1
                n_chars += len(text)
                for span in spans:
                    # A part may end inside an escape; the next part of this span then goes on.
                    piece = broken + text[span["start"]:span["end"]]
                    odd = (len(piece) - len(piece.rstrip("\\"))) % 2
                    broken = piece[len(piece) - odd:]
                    piece = unescape(piece[:len(piece) - odd])
                    n_loss += len(piece)
                    loss.update(piece.encode())
                rest += text
                at = 0
                for m in _TURN.finditer(rest):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv}: unreadable text at {at}")
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n_turns, at = n_turns + 1, m.end()
                rest = rest[at:]
                if last:
                    if rest or broken:
                        raise ValueError(f"conversation {conv}: text after the last turn")
                    out.append((conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
                    rest, turns, n_turns, loss, n_loss, n_chars, broken = "", hashlib.sha256(), 0, hashlib.sha256(), 0, 0, ""
            if out:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)],
                                                 names=out_schema.names)
        if due:
            raise ValueError(f"conversation {open_conv} ends before its last part")

    return source.mapInArrow(run, out_schema)
