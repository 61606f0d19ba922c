"""Offline annotation and rule grading (M1, M2, M4).

The grading instructions describe, in prose, how a reader turns a report
into mentions; these operators apply those rules directly:

* ``annotate_mentions``  dictionary terms with their offsets and what the
  cues in their scope say: negation / uncertainty / temporal / placement.
* ``diagnosis_cues``      overall diagnoses from cue phrases that no negation covers.
* ``rule_grade``          max grade of the rule phrases that the report
  affirms; 1 when none.

A report is tokenised once; phrase automata over the tokens give matches with offsets, and the
scope tagger of ``scopes`` says what is negated.  This is per-report work
without a shuffle, run on Arrow batches.  A dictionary of up to ``MAX_TERMS``
terms goes to the tasks as one automaton; a larger one stays a table, sharded by the
terms' first words: a narrow row per word meets the lengths of the terms that
begin with it, then the terms of those lengths.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scopes import Phrases, items_of, negated, plain, scope_of, split_sentences, term_words, word_forms

# --- FIXED VALUES: cue phrases (from the grading instructions) -------------
UNCERTAIN_CUES = ["possibly", "possible", "may represent", "could be", "cannot be excluded"]
CERTAIN_CUES = ["probably", "suggestive of", "likely"]
# a stable infection or growth of these kinds is graded lower
STABLE_CUES = ["stable", "unchanged", "no change", "no interval change"]
STABLE_GRADE = (3, ["tuberculosis", "mycobacterial", "tumour", "tumor", "malignancy", "neoplasm"])
# a small effusion is graded lower
SMALL_GRADE = (3, ["pleural effusion"], ["small", "tiny", "trace", "minimal"])
# lines and tubes count by their presence
DEVICE_RULES = {4: ["endotracheal tube", "tracheostomy tube", "central venous catheter", "central line", "chest drain",
                    "chest tube", "pacemaker", "dialysis catheter"],
                3: ["nasogastric tube", "feeding tube"]}
# temporal code -> cue words (0 new, 1 better, 2 worse, 3 stable; none -> 4)
TEMPORAL_CUES = {0: ["new"], 1: ["better", "improved", "improving", "resolving"],
                 2: ["worse", "worsening", "increased", "progressed"], 3: ["stable", "unchanged"]}
# placement code -> cue words (2 malpositioned, 1 suboptimal, 0 satisfactory; none -> 3)
PLACEMENT_CUES = {2: ["malpositioned", "malposition", "misplaced"], 1: ["suboptimal"],
                  0: ["satisfactory"]}
# overall diagnoses raised by cue phrases ("cannot be excluded", "possible" count)
DIAGNOSIS_CUES = [
    ("Pneumonia", ["pneumonia", "infection", "infective"]),
    ("Tuberculosis", ["tuberculosis", "mycobacterial"]),
    ("Lung cancer", ["malignancy", "tumour", "tumor", "neoplasm", "ct thorax"]),
    ("P1 finding", ["p1", "was informed"]),
]
# rule grader: grade -> phrases (max over what a report affirms)
DEFAULT_RULES = {
    5: ["pneumothorax", "aortic dissection", "mediastinal emphysema", "pneumomediastinum", "pneumoperitoneum",
        "portal venous air", "dilated bowel loops", "malpositioned", "misplaced", "p1", "was informed"],
    4: ["consolidation", "pleural effusion", "infection", "pneumonia", "infective", "tuberculosis",
        "mycobacterial", "malignancy", "tumour", "tumor", "neoplasm", "mass", "fluid overload",
        "pulmonary congestion", "airspace opacity", "patchy opacity", "patchy airspace opacity", "hazy opacity"],
    3: ["atelectasis", "cardiomegaly", "fibrosis", "pleural thickening", "nodule", "granuloma",
        "pleural plaque", "scarring", "calcified adenopathy", "pulmonary calcification"],
    2: ["unfolded aorta", "unfolded thoracic aorta", "vascular calcification", "rotated", "patient rotation", "suboptimal effort",
        "suboptimal technique", "suboptimal inspiration", "degenerative", "not accurately assessed"],
}
# --- end fixed values -------------------------------------------------------
#: Words between "small" and what is small.
SIDES = {"left", "right", "sided", "bilateral", "basal", "and"}
#: Terms of a dictionary that is sent to the tasks.
MAX_TERMS = 20_000
#: Rows that a task hands back at once.
OUT_ROWS = 10_000

CERTAIN, UNCERTAIN, STABLE = plain(CERTAIN_CUES), plain(UNCERTAIN_CUES), plain(STABLE_CUES)
TEMPORAL = [(code, plain(cues)) for code, cues in TEMPORAL_CUES.items()]
PLACEMENT = [(code, plain(cues)) for code, cues in PLACEMENT_CUES.items()]


def _first_code(cues, words, skip, none):
    return next((code for code, phrases in cues if phrases.any(words, skip)), none)


class Sentence:
    """Tokens, items and negations of a sentence; the last two are found when first asked for."""

    def __init__(self, number, tokens):
        self.number, self.tokens, self.words = number, tokens, [t.word for t in tokens]
        self.items = self.covered = None

    def negates(self, a: int, b: int) -> bool:
        if self.items is None:
            self.items = items_of(self.words)
            self.covered = negated(self.words, self.items)
        return all(self.covered[a:b])

    def scope(self, places: list[tuple[int, int]], a: int, b: int) -> tuple[list[str], tuple[int, int]]:
        """The words whose cues speak of the phrase at tokens a to b, and its place among them."""
        held = [any(item.first <= x < item.behind for x, _ in places) for item in self.items]
        lo, hi = scope_of(self.items, held, a)
        hi = max(hi, b)
        return self.words[lo:hi], (a - lo, b - lo)

    def place(self, a: int, b: int) -> tuple[int, int]:
        return self.tokens[a].start, self.tokens[b - 1].end


def sentences_of(text: str | None, among: Set[str] | None = None) -> Iterator[Sentence]:
    return (Sentence(n, tokens) for n, tokens in split_sentences(text or "", among))


def _by_report(df: DataFrame, key: str, text_col: str, fields: list[tuple[str, str]], rows_of) -> DataFrame:
    """A row per result of ``rows_of(text, *rest)`` with the report's key; ``df`` is (key, text, rest...)."""
    schema = T.StructType([df.schema[key], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields]])
    names = [f.name for f in schema]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(schema)
        for batch in batches:
            keys, out, where = batch.column(0), [], []
            for i in range(batch.num_rows):
                for row in rows_of(*(batch.column(c)[i].as_py() for c in range(1, batch.num_columns))):
                    where.append(i)
                    out.append(row)
                if out and (len(out) >= OUT_ROWS or i + 1 == batch.num_rows):
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(where, pa.int32())), *[
                        pa.array(c, kinds.field(n).type) for c, n in zip(columns, names[1:], strict=True)]], names=names)
                    out, where = [], []
            if out:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(where, pa.int32())), *[
                    pa.array(c, kinds.field(n).type) for c, n in zip(zip(*out, strict=True), names[1:], strict=True)]], names=names)

    return df.mapInArrow(run, schema)


MENTION = [("sent_no", "int"), ("idx", "int"), ("term", "string"), ("start", "int"), ("end", "int"), ("negated", "boolean"),
           ("uncertainty", "int"), ("temporal", "int"), ("placement", "int")]


def _mention_rows(sentence: Sentence, found: list[tuple[int, int, list]]) -> Iterator[tuple]:
    """Result rows of the matches (first token, token behind, [(idx, term)]) of a sentence."""
    places = [(a, b) for a, b, _ in found]
    for a, b, entries in found:
        no = sentence.negates(a, b)
        words, own = sentence.scope(places, a, b)
        unsure = int(not CERTAIN.any(words, own) and UNCERTAIN.any(words, own))
        cues = _first_code(TEMPORAL, words, own, 4), _first_code(PLACEMENT, words, own, 3)
        for idx, term in entries:
            yield (sentence.number, idx, term, *sentence.place(a, b), no, unsure, *cues)


def annotate_mentions(df: DataFrame, lexicon: DataFrame, text_col: str = "TEXT_REPORT",
                      key: str = "report_id", strategy: str = "auto") -> DataFrame:
    """M1: one row per dictionary term found in a report, with its place and its cues.

    Output: key, sent_no, idx, term, start, end (characters of the text, end
    exclusive), negated, uncertainty (0/1), temporal (0..4), placement (0..3).
    Matches are leftmost and longest and do not overlap; terms that are spelt alike give a row
    each.  ``strategy``: 'automaton' sends the dictionary to the tasks (up to ``MAX_TERMS`` terms, checked),
    'join' leaves it a table of any size; 'auto' looks at the number of terms.
    """
    terms = lexicon.select(F.col("idx").cast("int").alias("idx"), "term").where(F.col("term").isNotNull())
    if strategy != "join":
        some = [tuple(r) for r in terms.limit(MAX_TERMS + 1).collect()]
        if len(some) <= MAX_TERMS:
            return _annotate_by_automaton(df, sorted(some), text_col, key)
        if strategy == "automaton":
            raise ValueError(f"the dictionary has more than {MAX_TERMS} terms; use strategy='join'")
    return _annotate_by_join(df, terms, text_col, key)


def _annotate_by_automaton(df: DataFrame, terms: list[tuple[int, str]], text_col: str, key: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(Phrases([(t, (i, t)) for i, t in terms]))

    def rows_of(text):
        for s in sentences_of(text, sent.value.heads):
            found = list(sent.value.find(s.words))
            if found:
                yield from _mention_rows(s, found)

    return _by_report(df.select(key, F.col(text_col).cast("string").alias("text")), key, text_col, MENTION, rows_of)


def _annotate_by_join(df: DataFrame, terms: DataFrame, text_col: str, key: str) -> DataFrame:
    """Words meet the terms by equi-joins: first word -> lengths of the terms, then words -> terms."""
    reports = df.select(F.col(key).alias("k"), F.col(text_col).cast("string").alias("text"))
    reports = reports.select("k", F.xxhash64("text").alias("h"), "text")  # rows of one key are told apart by their text

    def forms_of(idx, term):
        words = term_words(term)
        for rank, form in enumerate(word_forms(words) if words else []):
            yield form[0], len(words), " ".join(form), min(rank, 1), idx, term

    forms = _by_report(terms.select(F.lit(0).alias("k"), "idx", "term"), "k", "term", [
        ("first", "string"), ("n", "int"), ("gram", "string"), ("rank", "int"), ("idx", "int"), ("term", "string")], forms_of).drop("k")
    forms = forms.groupBy("first", "n", "gram").agg(F.array_sort(F.collect_set(F.struct("rank", "idx", "term"))).alias("e"))
    forms = forms.select("first", "n", "gram", F.filter("e", lambda x: x["rank"] == F.col("e")[0]["rank"]).alias("e")).checkpoint()
    heads = forms.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    most = heads.select(F.max(F.array_max("lengths"))).first()[0] or 0

    def words_of(h, text):
        for s in sentences_of(text):
            for i, w in enumerate(s.words):
                yield h, s.number, i, w, s.words[i:i + most]

    words = _by_report(reports.select("k", "h", "text"), "k", "text", [("h", "long"), ("sent_no", "int"), ("i", "int"), ("first", "string"),
                                                             ("next", "array<string>")], words_of)
    grams = words.join(heads, "first").select("k", "h", "sent_no", "i", "next", F.explode("lengths").alias("n"))
    grams = grams.where(F.size("next") >= F.col("n")).withColumn("gram", F.array_join(F.slice("next", 1, F.col("n")), " ")).drop("next")
    hits = grams.join(forms.select("gram", "n", "e"), ["gram", "n"]).groupBy("k", "h").agg(
        F.collect_set(F.struct("sent_no", "i", "n", "e")).alias("hits")).withColumnsRenamed({"k": "hk", "h": "hh"})
    joined = reports.join(hits, F.col("k").eqNullSafe(F.col("hk")) & (F.col("h") == F.col("hh"))).select(F.col("k").alias(key), "text", "hits")

    def rows_of(text, hits):
        by = {}
        for h in hits:
            by.setdefault(h["sent_no"], {}).setdefault(h["i"], []).append((h["n"], [(e["idx"], e["term"]) for e in h["e"]]))
        for s in sentences_of(text):
            at, found = 0, []
            for i in sorted(by.get(s.number, ())):
                if i >= at:  # leftmost, longest
                    n, entries = max(by[s.number][i], key=lambda x: x[0])
                    found.append((i, i + n, entries))
                    at = i + n
            if found:
                yield from _mention_rows(s, found)

    return _by_report(joined, key, "text", MENTION, rows_of)


def diagnosis_cues(df: DataFrame, text_col: str = "TEXT_REPORT", key: str = "report_id") -> DataFrame:
    """M4: (key, sent_no, diagnosis, start, end) raised by cue phrases that no negation covers, once by sentence."""
    cues = Phrases([(p, name) for name, phrases in DIAGNOSIS_CUES for p in phrases])

    def rows_of(text):
        for s in sentences_of(text, cues.heads):
            seen = set()
            for a, b, names in cues.find(s.words):
                if names[0] not in seen and not s.negates(a, b):
                    seen.add(names[0])
                    yield (s.number, names[0], *s.place(a, b))

    return _by_report(df.select(key, F.col(text_col).cast("string").alias("text")), key, text_col, [
        ("sent_no", "int"), ("diagnosis", "string"), ("start", "int"), ("end", "int")], rows_of)


def rule_grade(df: DataFrame, text_col: str = "TEXT_REPORT", rules: dict[int, list[str]] | None = None,
               key: str = "report_id") -> DataFrame:
    """M2: (key, grade): max rule grade over what the report affirms, 1 if none.

    Phrases count in the singular and the plural, unless negated.  With the engine's own
    rules, a tuberculosis or tumour that its scope calls stable is graded 3, a small effusion
    3, and lines and tubes count by their presence, malpositioned ones 5.
    Rows of one key are graded together.
    """
    own = rules is None
    rules = rules or {gr: [*DEFAULT_RULES.get(gr, []), *DEVICE_RULES.get(gr, [])] for gr in {*DEFAULT_RULES, *DEVICE_RULES}}
    phrases = Phrases([(p, (gr, p)) for gr, ps in rules.items() for p in ps])
    (low, lasting), (less, sized, sizes) = STABLE_GRADE, SMALL_GRADE

    def worth(s, places, a, b, grade, phrase):
        if own and phrase in lasting and STABLE.any(*s.scope(places, a, b)):
            return low
        if own and phrase in sized:
            before = a - 1
            while before >= 0 and s.words[before] in SIDES:
                before -= 1
            if before >= 0 and s.words[before] in sizes:
                return less
        return grade

    def rows_of(text):
        best = 1
        for s in sentences_of(text, phrases.heads):
            found = list(phrases.find(s.words))
            places = [(a, b) for a, b, _ in found]
            for a, b, values in found:
                if max(gr for gr, _ in values) > best and not s.negates(a, b):
                    best = max(best, *(worth(s, places, a, b, gr, p) for gr, p in values))
        yield (best,)

    graded = _by_report(df.select(key, F.col(text_col).cast("string").alias("text")), key, text_col, [("grade", "int")], rows_of)
    return graded.groupBy(key).agg(F.max("grade").alias("grade"))
