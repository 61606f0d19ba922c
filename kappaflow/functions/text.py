"""String column functions: cleaning, templates, labels, size."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CHOICE_LABELS, CLASS_NAMES

# FIXED VALUES: report clean-up patterns (header, accession number).
HEADER_PATTERN = r"CHEST\sof\s\d+-\S{3}-\d{4}:"
ACCESSION_PATTERN = r"Accession\sNo:\S+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """remove leading and trailing white space (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def clean_text(x) -> Column:
    """Drop the header and accession number, collapse blank lines, strip."""
    t = F.regexp_replace(_c(x), HEADER_PATTERN, "")
    t = F.regexp_replace(t, ACCESSION_PATTERN, "")
    t = F.regexp_replace(t, r"\n+", "\n")
    return strip_ws(t)


def fill_template(template: str, holes: dict[str, Column]) -> Column:
    """one-pass ``${name}`` substitution.

    The template is cut at its holes when the plan is built and the parts are
    joined, so a ``${...}`` spelled inside a value stays as it is.  Holes
    without a value stay as text; NULL values become '' (a NULL would null
    the whole prompt).
    """
    parts = re.split(r"\$\{(\w+)\}", template)
    out = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            out.append(F.lit(part))
        elif part in holes:
            out.append(F.coalesce(holes[part].cast("string"), F.lit("")))
        else:
            out.append(F.lit("${" + part + "}"))
    return F.concat(*out)


def word_count(x) -> Column:
    """F9 (re-aimed): white-space separated words of the stripped text; '' -> 0."""
    s = strip_ws(x)
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.size(F.split(s, r"\s+")))


def _label(code, labels: list[str]) -> Column:
    # Range-guarded: an unknown code (say a model's choice 7) gives NULL;
    # under ANSI mode an out-of-range element_at would fail the whole job.
    c = _c(code)
    return F.when(c.between(0, len(labels) - 1),
                  F.element_at(F.array(*[F.lit(s) for s in labels]), c.cast("int") + 1))


def choice_label(code) -> Column:
    """judge choice code 0..3 -> text (NULL for other codes)."""
    return _label(code, CHOICE_LABELS)


def class_name(code) -> Column:
    """grouped class 0..2 -> Normal / Actionable / Critical (NULL for other codes)."""
    return _label(code, CLASS_NAMES)


def debug_label(code, term, raw) -> Column:
    """'(idx) term' for a matched term, '!raw!' otherwise."""
    return F.when(_c(code).isNotNull(), F.concat(F.lit("("), _c(code).cast("string"), F.lit(") "), _c(term))) \
        .otherwise(F.concat(F.lit("!"), _c(raw), F.lit("!")))
