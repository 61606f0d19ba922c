"""Tokens with offsets, phrase automata over tokens, and the scopes of cues in a sentence.

A sentence is a list of tokens (words, and the marks that end or list things).
Phrases are found by a trie over tokens: leftmost, longest, without overlaps,
the last word also in its plural.  ``negated`` is a finite-state pass over the
sentence's *items* (the stretches between commas, and/or/nor, with, but, ;):

* a cue before ("no", "without") negates what follows it in its item;
* "or" and "nor" carry the negation on; "and" and a comma do so only for a bare
  item (nothing in it that states something, such as "large", "is", "on the left"), a comma also
  inside a list that an "or" closes;
* "but", "however", ";", "with" and the end of the sentence end it;
* a cue after ("is excluded", "has resolved") negates what stands before it in
  its item and the bare items listed before that, unless "cannot" or "not" precedes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Set
from typing import NamedTuple

TOKEN = re.compile(r"[^\W_]+|[;:,()]")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n")

# --- FIXED VALUES: cue phrases (from the grading instructions) -------------
NEGATION_CUES = ["no", "without", "negative for", "free of"]
# "no change" says nothing about what is there
NOT_NEGATING = ["change", "interval change", "significant change", "significant interval change", "longer", "increase", "decrease"]
NEGATION_ENDS = ["but", "however", "although", "though", "except", "apart from"]
# --- end fixed values -------------------------------------------------------
MORE_CUES = ["absence of", "does not show", "do not show", "did not show", "rather than"]
CUES_AFTER = ["excluded", "ruled out", "absent", "resolved", "not seen", "not identified", "not present", "not demonstrated", "not evident",
              "not visualised", "not visualized", "no longer seen", "no longer present", "no longer visible", "no longer evident"]
DOUBLE = {"cannot", "not", "never", "t"}
MARKS = {";", ":", "(", ")"}
VERBS = {"is", "are", "was", "were", "has", "have", "had", "there", "shows", "show", "remains", "remain", "appears", "appear", "seen", "noted"}
STATING = VERBS | {"new", "large", "small", "tiny", "trace", "moderate", "severe", "mild", "massive", "extensive", "increased", "increasing",
                   "worse", "worsening", "stable", "unchanged", "persistent", "known", "right", "left", "bilateral", "on", "in", "at",
                   "present", "likely", "probably", "possibly", "possible"}
STRENGTH = {",": 0, "and": 1, "or": 2, "nor": 2, "with": 3, "end": 4, "start": 5}


class Token(NamedTuple):
    word: str
    start: int
    end: int


def split_sentences(text: str, among: Set[str] | None = None) -> Iterator[tuple[int, list[Token]]]:
    """(number, tokens with offsets in the whole text) of every sentence that has a token; of those that hold a
    word of ``among`` where that is given."""
    def worth(start, stop):
        return among is None or not among.isdisjoint(map(str.lower, TOKEN.findall(text, start, stop)))

    number = at = 0
    for stop in [*((m.start(), m.end()) for m in SENTENCE_END.finditer(text)), (len(text), len(text))]:
        tokens = ([Token(m.group().lower(), m.start(), m.end()) for m in TOKEN.finditer(text, at, stop[0])]
                  if worth(at, stop[0]) else None)
        if tokens:
            yield number, tokens
        number, at = number + 1, stop[1]


def term_words(term: str) -> tuple[str, ...]:
    """The words of a dictionary term: letters and digits; other characters separate them."""
    return tuple(w.lower() for w in re.findall(r"[^\W_]+", term or ""))


def word_forms(words: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The words themselves, then their plurals, and the singular where the last word is a plural."""
    last = words[-1]
    plurals = [last + "s", last + "es"]
    if last.endswith("ies"):
        plurals.append(last[:-3] + "y")
    elif last.endswith("s") and not last.endswith(("ss", "is", "us")):
        plurals.append(last[:-1])
    if last.endswith("y"):
        plurals.append(last[:-1] + "ies")
    if last.endswith("is"):
        plurals.append(last[:-2] + "es")
    return [words, *[(*words[:-1], p) for p in plurals]]


class Phrases:
    """Automaton over tokens: a trie in which every phrase ends with its values."""

    def __init__(self, phrases: Iterable[tuple[str, object]], plural: bool = True):
        self.root: dict = {}
        for phrase, value in phrases:
            words = term_words(phrase)
            for rank, form in enumerate(word_forms(words)[:None if plural else 1] if words else []):
                node = self.root
                for w in form:
                    node = node.setdefault(w, {})
                plain, values = node.get(None, (2, []))
                if min(rank, 1) < plain:  # a term itself wins over the plural of another
                    node[None] = (min(rank, 1), [value])
                elif min(rank, 1) == plain:
                    values.append(value)

    @property
    def heads(self) -> Set[str]:
        """The words with which a phrase can begin."""
        return self.root.keys()

    def at(self, words: list[str], i: int) -> tuple[int, list]:
        """Length and values of the longest phrase that begins at token i; (0, []) without one."""
        node, found, n = self.root, (0, []), 0
        while i + n < len(words):
            node = node.get(words[i + n])
            if node is None:
                break
            n += 1
            if None in node:
                found = n, node[None][1]
        return found

    def find(self, words: list[str]) -> Iterator[tuple[int, int, list]]:
        """(first token, token behind, values), leftmost and longest, without overlaps."""
        i, root = 0, self.root
        while i < len(words):
            n, values = self.at(words, i) if words[i] in root else (0, [])
            if n:
                yield i, i + n, values
            i += n or 1

    def any(self, words: list[str], skip: tuple[int, int] = (0, 0)) -> bool:
        """Whether a phrase stands in the words, outside of the tokens to be skipped."""
        a, b = skip
        return any(True for _ in self.find([*words[:a], *["\0"] * (b - a), *words[b:]]))


def plain(phrases: list[str]) -> Phrases:
    return Phrases([(p, p) for p in phrases], plural=False)


BEFORE, NEUTRAL, ENDS, AFTER = plain(NEGATION_CUES + MORE_CUES), plain(NOT_NEGATING), plain(NEGATION_ENDS), plain(CUES_AFTER)


class Item(NamedTuple):
    sep: str
    first: int
    behind: int


def items_of(words: list[str]) -> list[Item]:
    """The stretches of a sentence between separators, with the separator before each (the strongest of several)."""
    out, sep, first, i = [], "start", 0, 0
    while i < len(words):
        w = words[i]
        n = 1 if w in MARKS else ENDS.at(words, i)[0]
        kind = "end" if n else w if w in (",", "and", "or", "nor", "with") else None
        if not kind:
            i += 1
            continue
        if i > first:
            out.append(Item(sep, first, i))
            sep = kind
        elif STRENGTH[kind] > STRENGTH[sep]:
            sep = kind
        i += n or 1
        first = i
    if len(words) > first:
        out.append(Item(sep, first, len(words)))
    return out


def negated(words: list[str], items: list[Item]) -> list[bool]:
    """For every token whether a negation covers it."""
    out, state = [False] * len(words), False

    def bare(item, among=STATING):
        return not any(w in among for w in words[item.first:item.behind])

    def listed(k):
        """Whether an 'or' closes the list that item k stands in."""
        for item in items[k + 1:]:
            if item.sep in ("or", "nor"):
                return True
            if item.sep != "," or not bare(item, VERBS):
                return False
        return False

    for k, item in enumerate(items):
        if item.sep in ("start", "end", "with"):
            state = False
        elif item.sep == ",":
            state = state and bare(item, VERBS) and (listed(k) or bare(item))
        elif item.sep == "and":
            state = state and bare(item)
        p = item.first
        while p < item.behind:
            n = BEFORE.at(words, p)[0]
            if n and not NEUTRAL.at(words, p + n)[0]:
                state = True
                p += n
                continue
            after = AFTER.at(words, p)[0]
            if after and not any(w in DOUBLE for w in words[max(item.first, p - 3):p]):
                back = k
                out[item.first:p] = [True] * (p - item.first)
                while back and items[back].sep in (",", "and", "or", "nor") and bare(items[back - 1]):
                    back -= 1
                    out[items[back].first:items[back].behind] = [True] * (items[back].behind - items[back].first)
            if after:  # "no longer seen" negates what stands before it, "not seen" likewise
                p += after
                continue
            out[p] = state
            p += 1
    return out


def scope_of(items: list[Item], held: list[bool], first: int) -> tuple[int, int]:
    """Tokens whose cues speak of a phrase that begins at token ``first``: its item, and the items without
    phrases (``held`` is false) after it, and before it if none comes earlier; "but" and ";" end it."""
    k = next(i for i, item in enumerate(items) if item.first <= first < item.behind)
    a = b = k
    while b + 1 < len(items) and not held[b + 1] and items[b + 1].sep != "end":
        b += 1
    while a and not held[a - 1] and items[a].sep != "end":
        a -= 1
    if any(held[:a]) and a < k:  # what stands between two phrases belongs to the first
        a = k
    return items[a].first, items[b].behind
