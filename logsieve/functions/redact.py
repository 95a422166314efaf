"""Formats of response bodies, and previews of them without secrets."""

from __future__ import annotations

import decimal
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from logsieve.functions import text as t

# Parts of JSON keys whose values are secret.
SECRET_KEYS = [
    "password", "passwd", "secret", "token", "key", "auth",
    "credential", "session", "cookie", "authorization",
    "api_key", "apikey", "private", "access_token",
    "refresh_token", "jwt", "bearer", "hash", "salt",
    "ssn", "credit_card", "card_number",
]
#: Most bytes of a preview.
PREVIEW = 2048
DEPTH = 10
_REDACTED = StructType().add("preview", StringType()).add("redactions", IntegerType())
_PASSWD = r"^[^:\n]*:[^:\n]*:\d+:\d+:[^:\n]*:[^:\n]*:[^\n]*$"
_ENV = r"^(?:export )?[A-Z0-9_]+="


def _lines(body: Column, first: int | None = None) -> Column:
    lines = F.split(body, "\n")
    return F.transform(F.slice(lines, 1, first) if first else lines, t.trim)


def looks_like_passwd(body: Column) -> Column:
    """Whether one of the first three lines is an entry of an account file."""
    return F.exists(_lines(body, 3), lambda x: t.matches(x, _PASSWD))


def looks_like_dotenv(body: Column) -> Column:
    """Whether at least two of the first five lines set a variable."""
    return F.size(F.filter(_lines(body, 5), lambda x: t.matches(x, _ENV))) >= 2


def detect_format(body: Column, content_type: Column) -> Column:
    """format and confidence of a body (text): by content type, else by its shape."""
    kind = F.lower(t.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    body = F.coalesce(body, F.lit(""))
    start = t.trim(body)
    head = F.lower(F.substring(start, 1, 100))
    say = lambda f, c: F.struct(F.lit(f).alias("format"), F.lit(c).alias("confidence"))
    return (
        F.when(kind.isin("application/json", "text/json"), say("json", "high")).when(kind.isin("text/html", "application/xhtml+xml"), say("html", "high"))
        .when(body == "", say("unknown", "none")).when(F.contains(F.substring(body, 1, 64), F.lit("\x00")), say("binary", "high"))
        .when(looks_like_passwd(start), say("passwd", "high")).when(looks_like_dotenv(start), say("dotenv", "high"))
        .when(F.substring(start, 1, 1).isin("{", "["), F.when(F.get_json_object(start, "$").isNotNull(), say("json", "high")).otherwise(say("json", "low")))
        .when(F.startswith(head, F.lit("<!doctype")) | F.startswith(head, F.lit("<html")), say("html", "high")).when(F.startswith(head, F.lit("<")), say("html", "low"))
        .otherwise(say("unknown", "none"))
    )


def redact_dotenv(body: Column) -> Column:
    """preview and redactions of a file of variables: every value goes."""

    def one(raw: Column) -> Column:
        x = t.trim(raw)
        named = ~F.startswith(x, F.lit("#")) & x.rlike("^(?:export )?[^=]+=")
        return F.struct(F.when(named, F.concat(F.regexp_extract(x, "^(?:export )?[^=]+", 0), F.lit("=[REDACTED]"))).otherwise(raw).alias("l"), named.cast("int").alias("n"))

    return _joined(F.transform(F.split(body, "\n"), one))


def redact_passwd(body: Column) -> Column:
    """preview and redactions of an account file: names, numeric ids and shells stay."""
    gone = F.lit("[REDACTED]")

    def one(raw: Column) -> Column:
        x = t.trim(raw)
        f = F.split(x, ":")
        account = F.concat_ws(":", F.get(f, 0), gone, F.get(f, 2), F.get(f, 3), gone, gone, F.get(f, 6))
        shadow = F.concat(F.get(f, 0), F.repeat(F.lit(":[REDACTED]"), F.size(f) - 1))
        is_account, is_shadow = F.size(f) >= 7, (F.size(f) >= 2) & F.contains(F.get(f, 1), F.lit("$"))
        line = F.when(x == "", "").when(is_account, account).when(is_shadow, shadow).otherwise(gone)
        return F.struct(line.alias("l"), F.when(x == "", 0).when(is_account, 3).when(is_shadow, F.size(f) - 1).otherwise(1).alias("n"))

    return _joined(F.transform(F.split(body, "\n"), one))


def _joined(lines: Column) -> Column:
    return F.struct(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("preview"), F.aggregate(lines, F.lit(0), lambda a, x: a + x["n"]).alias("redactions"))


def looks_like_base64(c: Column) -> Column:
    """Whether a string of at least 20 bytes, without white space, is nearly all letters of base64."""
    kept = F.octet_length(F.regexp_replace(c, "[^A-Za-z0-9+/=]", ""))
    return (F.octet_length(c) >= 20) & ~c.rlike("[ \\t\\n\\r\\x0B\\f]") & (kept / F.octet_length(c) > 0.95)


def _redacted(value, key: str, depth: int, found: list[int]):
    if depth > DEPTH:
        return "[MAX_DEPTH]"
    if isinstance(value, dict):
        return {k: _redacted(v, k, depth + 1, found) for k, v in value.items()}
    if isinstance(value, list):
        return [_redacted(v, key, depth + 1, found) for v in value]
    if not isinstance(value, str):
        return value
    size = len(value.encode())
    letters = sum(c.isascii() and (c.isalnum() or c in "+/=") for c in value)
    marks = [
        (any(s in key.lower() for s in SECRET_KEYS), "[REDACTED]"), (size > 50, "[REDACTED:long_string]"), ("@" in value and "." in value, "[REDACTED:email]"),
        (size >= 20 and not any(c in " \t\n\r\v\f" for c in value) and letters / size > 0.95, "[REDACTED:encoded]"),
    ]
    mark = next((m for hit, m in marks if hit), None)
    found[0] += mark is not None
    return value if mark is None else mark


def _number(x: float) -> str:
    """A number as JSON writers of double precision print it: plainly between 1e-6 and 1e21, else with an exponent of at least one digit."""
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        return format(decimal.Decimal(repr(x)), "f").removesuffix(".0")
    mantissa, exponent = repr(x).split("e")
    return f"{mantissa.removesuffix('.0')}e{'-' if exponent.startswith('-') else '+'}{exponent.lstrip('+-0')}"


#: Characters that are written as escapes inside strings, beside quotes, backslashes and control characters.
_ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def _string(x: str) -> str:
    return "".join(_ESCAPED.get(c, c) for c in json.dumps(x, ensure_ascii=False))


def _indented(value, pad: str = "") -> str:
    """A value in indented form, keys in the order of their bytes."""
    inner = pad + "  "
    if isinstance(value, dict) and value:
        rows = [f"{inner}{_string(k)}: {_indented(value[k], inner)}" for k in sorted(value, key=str.encode)]
        return "{\n" + ",\n".join(rows) + f"\n{pad}}}"
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(inner + _indented(v, inner) for v in value) + f"\n{pad}]"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, bool) or value is None or value in ({}, []):
        return json.dumps(value)
    return _number(value)


def _no_constant(name: str):
    raise ValueError(name)


def _json(body: str) -> tuple[str, int]:
    """Preview and redactions of a JSON body; an empty preview where it does not parse."""
    found = [0]
    try:
        value = json.loads(body, parse_int=float, parse_constant=_no_constant)
        out = _indented(_redacted(value, "", 0, found))
    except (TypeError, ValueError, RecursionError, OverflowError):
        return "", 0
    return _capped(out, "\n...[TRUNCATED]"), found[0]


def _capped(text: str, mark: str) -> str:
    raw = text.encode()
    return text if len(raw) <= PREVIEW else raw[:PREVIEW].decode(errors="ignore") + mark


# Attributes of tags whose values go whatever they are named, and parts of names of attributes whose values go in any tag.
TAG_ATTRIBUTES = {
    "input": "value", "textarea": "value", "meta": "content", "form": "action", "a": "href", "link": "href", "area": "href", "base": "href",
    "img": "src", "iframe": "src", "source": "src", "embed": "src", "track": "src", "audio": "src", "video": "src", "button": "formaction",
}
SECRET_ATTRIBUTES = ["token", "secret", "key", "auth", "password", "passwd", "credential", "session", "bearer", "csrf", "apikey"]
_BLANK = " \\t\\n\\r\\f"
#: A stretch of HTML: text, a script or style with its body, or a tag; the last may be unfinished.
_STRETCH = re.compile(r"[^<]+|<(?P<kind>script|style)[^>]*>(?:.*?</(?P=kind)>|.*)|<[^>]*>|<.*", re.I | re.S)
_TAG_NAME = re.compile(rf"<[^{_BLANK}>/]*")
#: An attribute: what precedes its value, then a quoted value, one whose quote never closes, or a bare one.
_ATTRIBUTE = re.compile(rf"""(?P<head>[{_BLANK}]*(?P<name>[^={_BLANK}>/]*)[{_BLANK}]*)(?:(?P<equals>=[{_BLANK}]*)(?:(?P<closed>"[^"]*"|'[^']*')|(?P<open>["'].*)|(?P<bare>[^>{_BLANK}]*)))?""", re.S)


def _tag(tag: str) -> tuple[str, int]:
    """A tag with the values of its secret attributes gone; from a slash outside of values on, it is left as it is."""
    if tag[1:2] in ("/", "!", ""):
        return tag, 0
    head = _TAG_NAME.match(tag)[0]
    named = TAG_ATTRIBUTES.get(head[1:].lower())
    out, at, gone = [head], len(head), 0
    while at < len(tag):
        m = _ATTRIBUTE.match(tag, at)
        rest = tag[at:].lstrip(" \t\n\r\f")
        if not rest or rest[0] in ">/":
            break
        name = m["name"].lower()
        secret = m["equals"] is not None and m.end("equals") < len(tag) and (name == named or any(s in name for s in SECRET_ATTRIBUTES))
        value = (m["closed"] or m["open"] or m["bare"] or "") if m["equals"] is not None else ""
        out += [m["head"], m["equals"] or "", '"[REDACTED]"' if secret else value]
        gone += secret
        at = len(tag) if m["open"] is not None else m.end()
        if m["open"] is not None:
            return "".join(out), gone
    return "".join(out) + tag[at:], gone


def _html(body: str) -> tuple[str, int]:
    """Preview and redactions of HTML: bodies of scripts and styles and values of secret attributes go."""
    out, gone = [], 0
    for m in _STRETCH.finditer(body):
        piece = m[0]
        if m["kind"]:
            kind = m["kind"].lower()
            out.append(f"<{kind}>[STRIPPED]</{kind}>")
        elif piece.startswith("<") and piece.endswith(">"):
            piece, n = _tag(piece)
            out.append(piece)
            gone += n
        else:
            out.append(piece)
    return _capped("".join(out), "...[TRUNCATED]"), gone


@F.pandas_udf(_REDACTED)
def redact_json(bodies: pd.Series) -> pd.DataFrame:
    """preview (indented, keys in order) and redactions of a JSON body; an empty preview where it does not parse."""
    return pd.DataFrame([_json(b) for b in bodies], columns=["preview", "redactions"])


@F.pandas_udf(_REDACTED)
def redact_html(bodies: pd.Series) -> pd.DataFrame:
    """preview and redactions of an HTML body; scripts and styles do not count."""
    return pd.DataFrame([_html(b or "") for b in bodies], columns=["preview", "redactions"])


# What a body of each format discloses, by its format alone.
SUMMARIES = {
    "dotenv": "DOTENV/CONFIG STRUCTURE DETECTED", "passwd": "PASSWD FILE STRUCTURE DETECTED", "json": "JSON STRUCTURE DETECTED", "html": "HTML CONTENT DETECTED",
    "binary": "BINARY CONTENT DETECTED — METADATA ONLY", "unknown": "UNKNOWN FORMAT — METADATA ONLY",
}
NO_BODY = "NO RESPONSE BODY CAPTURED"


def with_disclosure(df: DataFrame, body: str, content_type: str, into: str = "disclosure") -> DataFrame:
    """``df`` with ``into``: format, confidence, redactions, summary and preview of a captured body.

    Fails closed: a body of unknown or binary format, or none, has no preview and no confidence.
    """
    df = df.withColumn("_found", detect_format(F.col(body), F.col(content_type)))
    kind = F.col("_found.format")
    none = F.coalesce(F.col(body), F.lit("")) == ""
    only = lambda f: F.when(~none & (kind == f), F.col(body))
    # each redactor sees the bodies of its format alone; the others are null to it
    df = df.withColumns({"_json": redact_json(only("json")), "_html": redact_html(only("html"))})
    said = F.when(kind == "dotenv", redact_dotenv(F.col(body))).when(kind == "passwd", redact_passwd(F.col(body))).when(kind == "json", F.col("_json")).when(kind == "html", F.col("_html"))
    df = df.withColumn("_said", F.when(~none, said))
    shown = F.col("_said").isNotNull()
    summary = F.when(none, NO_BODY).otherwise(F.coalesce(*[F.when(kind == k, v) for k, v in SUMMARIES.items()]))
    out = F.struct(
        F.when(none, "unknown").otherwise(kind).alias("format"), F.when(shown, F.col("_found.confidence")).otherwise("none").alias("confidence"),
        F.coalesce("_said.redactions", F.lit(0)).alias("redactions"), summary.alias("summary"), F.coalesce("_said.preview", F.lit("")).alias("preview"),
    )
    return df.withColumn(into, out).drop("_found", "_json", "_html", "_said")


def without_scripts(html: Column) -> Column:
    """HTML without the bodies of scripts and styles."""
    return F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", "")
