"""What a model answers: JSON taken out of fences and mended, its action made to agree with its classification, severities compared."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import text as t
from logsieve.sources.tables import apart

# The action that each classification asks for; others ask for an alert.
ACTIONS = {"safe": "allow", "noise": "suppress", "recon_failed": "suppress", "recon_success": "alert", "suspicious": "alert", "malicious": "malicious"}
# How severe each classification is.
SEVERITY = {"safe": 0, "noise": 0, "recon_failed": 1, "recon_success": 3, "suspicious": 4, "malicious": 5}
# Letters that follow a backslash in JSON, and those that follow one in regular expressions.
JSON_ESCAPES, REGEX_ESCAPES = '"\\/bfnrtu', "dwsSDW"
_FIELDS = {"classification": "string", "action": "string", "confidence": "double", "reason": "string", "pattern_type": "string", "pattern": "string"}


def _map(values: dict) -> Column:
    return F.create_map(*map(F.lit, chain(*values.items())))


def action(classification: Column) -> Column:
    """The action that a classification asks for, whatever the model said; an unknown classification is an alert."""
    return F.coalesce(_map(ACTIONS)[classification], F.lit("alert"))


def downgrades(before: Column, after: Column) -> Column:
    """Whether ``after`` is less severe than ``before``; an unknown classification never is."""
    return F.coalesce(_map(SEVERITY)[after] < _map(SEVERITY)[before], F.lit(False))


def escalates(before: Column, after: Column) -> Column:
    return F.coalesce(_map(SEVERITY)[after] > _map(SEVERITY)[before], F.lit(False))


def without_fence(content: Column) -> Column:
    """Without the fence of a code block around it."""
    return t.trim(F.regexp_replace(F.regexp_replace(t.trim(content), "^```(?:json)?", ""), "```\\z", ""))


def mended(content: Column) -> Column:
    """With escapes that JSON lacks mended: those of regular expressions get a second backslash, others lose theirs."""
    pieces = F.regexp_extract_all(content, F.lit(r"\\[\s\S]|[^\\]+|\\"), F.lit(0))
    next_ = lambda x: F.substring(x, 2, 1)
    one = lambda x: (
        F.when(~x.startswith("\\") | (F.length(x) == 1) | next_(x).isin(*JSON_ESCAPES), x).when(next_(x).isin(*REGEX_ESCAPES), F.concat(F.lit("\\"), x)).otherwise(next_(x))
    )
    return F.array_join(F.transform(pieces, one), "")


def _read(content: Column, bare: Column) -> Column:
    """The content as a variant: as it is, without its fence, or mended; null where it is none of these. What does not begin like an object is none, and is not parsed, as a parse that fails is slow."""
    tried = lambda x, begin: F.try_parse_json(F.when(x.rlike(begin), x))
    return F.coalesce(tried(content, r"^[ \t\r\n]*\{"), tried(bare, r"^\{"), F.try_parse_json(F.when(bare.rlike(r"^\\?\{"), mended(bare))))


def _answer(value: Column) -> Column:
    value = F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)
    field = {k: F.coalesce(F.try_variant_get(value, f"$.{k}", kind), F.lit(0.0 if kind == "double" else "")) for k, kind in _FIELDS.items()}
    readable = value.isNotNull()
    act = F.when(readable, action(field["classification"])).otherwise("")
    quiet = ~act.isin("malicious", "alert")
    return F.struct(
        readable.alias("readable"), field["classification"].alias("classification"), act.alias("action"), field["confidence"].alias("confidence"), field["reason"].alias("reason"),
        *[F.when(quiet, field[k]).otherwise("").alias(k) for k in ("pattern_type", "pattern")],
    )


def parsed(content: Column) -> Column:
    """An answer as a struct: readable, classification, action (as it must be), confidence, reason, pattern_type and pattern (none for alert and malicious).

    The content is read as it is, else without its fence, else mended; one that is none of these, or no object,
    is not readable and has empty fields.
    """
    return _answer(_read(content, without_fence(content)))


def with_parsed(df: DataFrame, content: str, into: str) -> DataFrame:
    """``df`` with ``parsed`` of the column ``content`` as the struct ``into``, parsed once a row."""
    df = apart(df.withColumn("_bare", without_fence(F.col(content))))
    df = apart(df.withColumn("_value", _read(F.col(content), F.col("_bare"))))
    return apart(df.withColumn(into, _answer(F.col("_value")))).drop("_bare", "_value")


# ---- the same in DuckDB SQL ----


def sql_action(c: str) -> str:
    return f"CASE {c} {' '.join(f'WHEN {t.q(k)} THEN {t.q(v)}' for k, v in ACTIONS.items())} ELSE 'alert' END"


def sql_severity(c: str) -> str:
    return f"CASE {c} {' '.join(f'WHEN {t.q(k)} THEN {v}' for k, v in SEVERITY.items())} END"


def sql_bare(c: str) -> str:
    return t.sql_trim(f"regexp_replace(regexp_replace({t.sql_trim(c)}, '^```(?:json)?', ''), '```$', '')")


def sql_mended(c: str) -> str:
    valid, regex = (", ".join(t.q(x) for x in s) for s in (JSON_ESCAPES, REGEX_ESCAPES))
    one = f"CASE WHEN x[1] <> chr(92) OR length(x) = 1 OR x[2] IN ({valid}) THEN x WHEN x[2] IN ({regex}) THEN chr(92) || x ELSE x[2] END"
    return f"array_to_string(list_transform(regexp_extract_all({c}, {t.q(chr(92) * 2 + '(?s:.)|[^' + chr(92) * 2 + ']+|' + chr(92) * 2)}), lambda x: {one}), '')"
