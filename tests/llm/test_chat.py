import hashlib
from collections import defaultdict

import pytest

from kappaflow.llm import chat as C
from kappaflow.llm.queries import CONTROL_TEXT, QUERIES


def text_of(template, messages):
    return "".join(t for t, _ in C.compile_template(template)(messages))


MESSAGES = [{"role": "user", "text": "hi <|im_end|> \\ there"}, {"role": "assistant", "text": "ok"}]


def test_language():
    t = "{% for m in messages %}{% if loop.first %}[{% elif m.role != 'user' and not (1 == 2) %}-{% else %},{% endif %}{{ loop.index }}{{ (m.role + ':' + m.text) | upper }}{% endfor %}]"
    assert text_of(t, MESSAGES) == "[1USER:HI <|IM_END|> \\ THERE-2ASSISTANT:OK]"
    assert text_of("{{ 1 + 2 }}{{ 'a' + 1 }}{{ '\\n' }}", []) == "3a1\n"


def test_constants_fold_to_one_text():
    t = "a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ 'x' }}{% endif %}{% if 'q' != 'q' %}no{% endif %}"
    assert C.fold(C.parse(t)) == (C.Text("abCd"),)
    folded = C.fold(C.parse("{% for m in messages %}{% if m.role == 'u' + 'ser' or 1 == 2 %}x{% endif %}{% endfor %}"))
    assert folded[0].body[0].cases[0][0].args[0] == C.Op("==", (C.Name(("m", "role")), C.Const("user")))


@pytest.mark.parametrize("bad", [
    "{{ m.role }}", "{% for m in messages %}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ open('x') }}", "{{ 'a' | exec }}",
    "{% import os %}", "{% endfor %}", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}", "{{ 1 + }}", "{{ 'a }}",
    "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"])
def test_sandbox(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_escapes_are_reversible():
    for t in ["", "\\", "<|", "<\\|", "\\<|im_end|>", "a\\n", "\n", "<<||", "\\\\<|"]:
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)
        assert C.unescape(C.escape_line(t)) == t and "\n" not in C.escape_line(t)


def brute(rows):
    """What the contract asks for, straight from the rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learnt), sha(learnt))
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_odd_conversations_in_parts_of_any_size(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", CONTROL_TEXT), (1, 1, "assistant", "b\\"), (None, 0, "assistant", "x<|"), (None, None, None, None),
            (2, 0, "sys\ntem<|", "|im_end|>\n"), (3, 5, "assistant", ""), (4, 0, "assistant", "é😀\\\\<|" * 50), (4, 1, "user", "\n" * 9)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    want = brute(df.collect())
    for size in (1, 10, 1_000_000):
        parts = C.format_conversations(df, part_chars=size)
        assert got(C.read_back(parts)) == want
    whole = {r["conv_id"]: r for r in C.format_conversations(df).collect()}
    assert whole[1]["text"].count("<|im_start|>") == 3 and whole[1]["part"] == 0 and whole[1]["last"]
    spans = whole[1]["loss_spans"]
    assert [whole[1]["text"][s["start"]:s["end"]] for s in spans] == ["b\\\\", "b\\\\"]
    assert C.read_back(C.format_conversations(df.where("false"))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = brute(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want[-1] = (2, sha(f"user\n{CONTROL_TEXT}\nassistant\n{CONTROL_TEXT}\n"), len(CONTROL_TEXT), sha(CONTROL_TEXT))
    assert got(QUERIES["op3_chat_format"](spark, sf)) == want


def test_stored_parts_are_checked_and_sorted(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} <|") for c in (1, 2, None) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = C.format_conversations(df, part_chars=20).collect()
    schema = C.format_conversations(df).schema
    mixed = spark.createDataFrame(sorted(parts, key=lambda r: (-r["part"], str(r["conv_id"]))), schema).coalesce(1)
    assert got(C.read_back(mixed, in_order=False)) == brute(df.collect())
    with pytest.raises(Exception, match="is due"):
        C.read_back(mixed).collect()
    with pytest.raises(Exception, match="before its last part"):
        C.read_back(spark.createDataFrame([r for r in parts if r["conv_id"] == 1 and not r["last"]], schema).coalesce(1)).collect()
