"""Text helpers with RE2's meaning of regular expressions, whatever the engine's own dialect.

Patterns are written once in RE2 form. ``java`` gives the equivalent for Spark, where white space, word
boundaries, the dot, the dollar sign and case folding differ; DuckDB runs the RE2 form as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as trimming and splitting into fields take it.
BLANKS = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: The same characters one by one.
BLANK_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: What surely begins, or ends, with a letter of a word: a boundary next to it is one look to the other side.
_WORD_FOLLOWS = re.compile(r"(?:\(\?:)*(?:\\d|\[0-9a-fA-F\]|[0-9A-Za-z])(?![?*]|\{0)")
_WORD_PRECEDES = re.compile(r"(?:\\d|(?<!\\)[0-9A-Za-z])(?:\+|\{[1-9][0-9,]*\})?(?:\(\?:\\\.\\d\+\)\?|\)*)\Z")


def java(pattern: str) -> str:
    """An RE2 pattern as a Java one of the same meaning."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            space = "\\t\\n\\f\\r "
            if two == "\\s":
                out.append(space if inside else f"[{space}]")
            elif two == "\\S":
                out.append(f"[^{space}]")
            elif two == "\\b" and not inside:
                follows, precedes = _WORD_FOLLOWS.match(pattern, i + 2), _WORD_PRECEDES.search(pattern[:i])
                out.append(f"(?<!{_WORD})" if follows else f"(?!{_WORD})" if precedes else _EDGE)
            else:
                out.append(two)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside and out[-1] not in ("[", "^"):
            inside = False
        if c == "." and not inside:
            out.append("[^\\n]")
        elif c == "$" and not inside:
            out.append("\\z")
        elif pattern.startswith("(?i)", i) and not inside:
            out.append("(?iu)")
            i += 4
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def replace(c: Column, pattern: str, by: str) -> Column:
    """Every match of an RE2 pattern replaced; groups in ``by`` are written $1."""
    return F.regexp_replace(c, java(pattern), by)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def extract(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match; the empty string where there is none."""
    return F.regexp_extract(c, java(pattern), group)


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def collapse(c: Column) -> Column:
    """Fields joined by single spaces."""
    return trim(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def contains_any(c: Column, parts: list[str]) -> Column:
    """Whether any of the parts occurs; null for null."""
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found


def has_any(c: Column, parts: list[str]) -> Column:
    """Like ``contains_any``, for an expression that is to be computed once."""
    return c.rlike("|".join(re.sub(r"([^0-9A-Za-z _/<>:%])", r"\\\1", p) for p in parts))


def url_decode(c: Column) -> Column:
    """Percent escapes decoded, plus signs made spaces, malformed escapes left as they are."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` bytes (whole characters), with an ellipsis if anything was cut."""
    chars = F.substring(c, 1, most)
    ascii_cut = F.when(F.octet_length(chars) <= most, chars).otherwise(F.decode(F.substring(F.encode(c, "UTF-8"), 1, most), "UTF-8"))
    return F.when(F.octet_length(c) > most, F.concat(ascii_cut, F.lit("..."))).otherwise(c)


def mask_phone(c: Column) -> Column:
    """The last four characters of a number hidden; one of at most four stays."""
    return F.when(F.length(c) <= 4, c).otherwise(F.concat(F.substring(c, F.lit(1), F.length(c) - 4), F.lit("****")))


def short_url(c: Column) -> Column:
    """At most 50 bytes of an address."""
    return F.when(F.octet_length(c) <= 50, c).otherwise(F.concat(F.substring(c, 1, 47), F.lit("...")))


def log_unescape(c: Column) -> Column:
    r"""A path out of an access log with its \xHH escapes decoded in one pass, so that what one of them gives is not read again."""
    pieces = F.regexp_extract_all(c, F.lit(r"\\x[0-9A-Fa-f]{2}|[^\\]+|\\"), F.lit(0))
    one = lambda x: F.when(x.rlike(r"^\\x[0-9A-Fa-f]{2}\z"), F.upper(F.substring(x, 3, 2))).otherwise(F.hex(x))
    return F.when(c.contains("\\x"), F.unhex(F.array_join(F.transform(pieces, one), "")).cast("string")).otherwise(c)


def html_escape(c: Column) -> Column:
    """With the five characters that mean something in HTML as references."""
    for char, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(by))
    return c


def header_map(c: Column) -> Column:
    """``Key=Value,Key=Value`` as a map; parts without an equals sign go, and of one key the last counts."""
    parts = F.transform(F.filter(F.split(c, ","), lambda x: x.contains("=")), lambda x: F.struct(trim(F.substring_index(x, "=", 1)).alias("k"), trim(F.substring(x, F.instr(x, "=") + 1, F.lit(2**31 - 1))).alias("v")))
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def csv_set(c: Column) -> Column:
    """Names of a comma-separated list in lower case, trimmed, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.lower(trim(x))), lambda x: x != ""))


# ---- the same in DuckDB SQL, for oracles ----


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_replace(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^[{BLANKS}]+|[{BLANKS}]+$')}, '', 'g')"


def sql_collapse(c: str) -> str:
    return sql_trim(f"regexp_replace({c}, {q(f'[{BLANKS}]+')}, ' ', 'g')")


def sql_contains_any(c: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(p)})" for p in parts) + ")"
