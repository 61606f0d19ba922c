"""Decoding of model responses and stored list cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])


#: Values that a coded field may have (grades 1..5, judge's choices as labelled).
RANGES = {"grade": (1, 5), "choice": (0, 3)}


def decode_response(text, schema: T.StructType, required: list[str] | None = None,
                    ranges: dict[str, tuple[int, int]] | None = None) -> Column:
    """Response text -> STRUCT(<schema fields>, status).

    Tiers: the JSON object found in the text (the whole text when it is
    one; the outermost ``{...}`` otherwise), parsed against ``schema``.
    Status: 'ok', 'no_response' (NULL text), 'no_json' (no object),
    'malformed' (parse error or wrong type), 'missing_field' (a required
    field NULL), 'out_of_range' (Q24: a field outside ``ranges``).  ``required``
    defaults to the first field; an empty list requires none.  A failed
    decode leaves every field NULL, so the caller's defaults (P11) apply.  ``from_json`` never falls through on its own:
    malformed text gives a struct of NULLs, hence the corrupt-record column.
    """
    t = F.col(text) if isinstance(text, str) else text
    required = [schema.fields[0].name] if required is None else required
    ranges = {k: v for k, v in (RANGES if ranges is None else ranges).items() if k in schema.names}
    obj = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    parsed = F.from_json(obj, _with_corrupt(schema), {"mode": "PERMISSIVE",
                                                      "columnNameOfCorruptRecord": CORRUPT})
    missing = F.lit(False)
    for r in required:
        missing = missing | parsed[r].isNull()
    outside = F.lit(False)
    for name, (low, high) in ranges.items():
        outside = outside | F.coalesce(~parsed[name].between(low, high), F.lit(False))
    status = (F.when(t.isNull(), F.lit("no_response"))
              .when(obj == "", F.lit("no_json"))
              .when(parsed.isNull() | parsed[CORRUPT].isNotNull(), F.lit("malformed"))
              .when(missing, F.lit("missing_field"))
              .when(outside, F.lit("out_of_range"))
              .otherwise(F.lit("ok")))
    ok = status == "ok"
    return F.struct(*[F.when(ok, parsed[f.name]).alias(f.name) for f in schema.fields],
                    status.alias("status"))


#: A quoted text, a run without quotes, or a quote that never closes.
QUOTED_OR_NOT = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""


def _json_words(part: Column) -> Column:
    plain = part
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        plain = F.regexp_replace(plain, rf"\b{word}\b", json_word)
    return F.when(part.rlike("""^['"]"""), part).otherwise(plain)


def parse_list_cell(text, element: T.StructType) -> Column:
    """Stored list cell -> ARRAY<element>; 'None', NULL and garbage -> [].

    Python-literal text is read by the JSON parser with single quotes
    allowed, after None, True and False outside quoted texts became null, true
    and false: the cell is cut into quoted and other parts first.  A text in a
    typed field becomes NULL in that field only, so read coded fields as STRING.
    """
    t = F.col(text) if isinstance(text, str) else text
    fixed = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(QUOTED_OR_NOT), F.lit(0)), _json_words), "")
    arr = F.from_json(fixed, T.ArrayType(element), {
        "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"})
    return F.when(t.isNull() | (F.trim(t) == "None"), F.array().cast(T.ArrayType(element))) \
        .otherwise(F.coalesce(arr, F.array().cast(T.ArrayType(element))))
