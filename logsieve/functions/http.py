"""HTTP facts in log lines: request identity, status, bytes, hosts and correlation keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import text as t
from logsieve.sources.tables import apart

# The four shapes of a request in a log line, in the order in which they are tried, with the
# groups of method, path, host and status.
_METHODS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE"
HOSTED = (rf"^(\S+)\s+({_METHODS})\s+(\S+)\s+HTTP/\S+\s+(\d{{3}})", {"method": 2, "path": 3, "host": 1, "status": 4})
QUOTED = (rf'"({_METHODS})\s+(\S+)\s+HTTP/\S+"\s+(\d{{3}})', {"method": 1, "path": 2, "status": 3})
BARE = (rf"^({_METHODS})\s+(\S+)\s+HTTP/\S+\s+(\d{{3}})", {"method": 1, "path": 2, "status": 3})
MORGAN = (rf"^({_METHODS})\s+(\S+)\s+(\d{{3}})\s+\d+(?:\.\d+)?\s+ms\s+-\s+(\d+|-)", {"method": 1, "path": 2, "status": 3})
NORMALIZED_SHAPES = [HOSTED, QUOTED, BARE, MORGAN]
RAW_SHAPES = [QUOTED, BARE, MORGAN]
QUOTED_BYTES = r'HTTP/\S+"\s+\d{3}\s+(\d+)'
MORGAN_BYTES = r"\d{3}\s+\d+(?:\.\d+)?\s+ms\s+-\s+(\d+)"
LONG_NUMBER = r"\b\d{4,}\b"
#: Status codes by which a server turned an attack away; 400 is not among them.
REJECTING = [403, 404, 405, 410]
#: Status codes of a probe that found nothing; 401 is not among them.
FAILED = ["400", "403", "404", "405", "410"]
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


#: Where the parts of a shape stand among the words of its match (from 1); the first word of a quoted request has a quote before it.
_WORDS = {
    "hosted": {"host": 1, "method": 2, "path": 3, "status": 5},
    "quoted": {"method": 1, "path": 2, "status": 4},
    "bare": {"method": 1, "path": 2, "status": 4},
    "morgan": {"method": 1, "path": 2, "status": 3},
}


def words(line: Column, shapes: list = NORMALIZED_SHAPES) -> Column:
    """The words of the request by the first shape that the line has, after the shape's name; null where there is none.

    No part of a request holds white space, so one search for each shape gives all parts.
    """
    found = []
    for shape in shapes:
        name = next(n for n, s in zip(_WORDS, NORMALIZED_SHAPES, strict=True) if s is shape)
        match = F.get(F.regexp_extract_all(line, F.lit(t.java(shape[0])), F.lit(0)), F.lit(0))
        found.append(F.when(line.contains("ms" if name == "morgan" else "HTTP/"), F.concat(F.lit(f"{name} "), match)))
    return F.split(F.coalesce(*found), "[\\t\\n\\f\\r ]+")


def part_of(words: Column, name: str) -> Column:
    """One part of a request from its words; empty where there is none."""
    kind, out = F.get(words, F.lit(0)), None
    for shape, places in _WORDS.items():
        if name in places:
            value = F.get(words, F.lit(places[name]))
            value = F.substring(value, 2, 2**31 - 1) if (shape, name) == ("quoted", "method") else value
            out = F.when(kind == shape, value) if out is None else out.when(kind == shape, value)
    return F.coalesce(out, F.lit(""))


def part(line: Column, shapes: list, name: str) -> Column:
    """One part of the request by the first shape that the line has; empty where there is none."""
    return part_of(words(line, shapes), name)


def _struct(found: Column) -> Column:
    status = part_of(found, "status")
    status = F.coalesce(F.when(status != "", status).try_cast("int"), F.lit(0))  # a cast that fails is slow
    return F.struct(*[part_of(found, n).alias(n) for n in ("method", "path", "host")], status.alias("status"))


def identity(line: Column, shapes: list = NORMALIZED_SHAPES) -> Column:
    """Method, path, host and status (0 where unknown) of a line as a struct."""
    return _struct(words(line, shapes))


def with_identity(df: DataFrame, line: str, into: str, shapes: list = NORMALIZED_SHAPES) -> DataFrame:
    """``df`` with ``identity`` of the column ``line`` as the struct ``into``, its shape searched for once a row."""
    found = apart(df.withColumn(f"_{into}", words(F.col(line), shapes)))
    return apart(found.withColumn(into, _struct(F.col(f"_{into}")))).drop(f"_{into}")


def response_bytes(line: Column) -> Column:
    """Bytes of the response in a raw line; 0 where unknown or out of range."""
    first = [F.when(t.matches(line, p), t.extract(line, p, 1)).try_cast("bigint") for p in (QUOTED_BYTES, MORGAN_BYTES)]
    return F.coalesce(*first, F.lit(0))


def canonical_path(path: Column) -> Column:
    return t.replace(path, LONG_NUMBER, "<NUM>")


def method_path(method: Column, path: Column) -> Column:
    """Method in upper case and path without its query."""
    return F.struct(F.upper(method).alias("method"), F.substring_index(path, "?", 1).alias("path"))


def correlation_key(host: Column, method: Column, path: Column, status: Column) -> Column:
    """What joins the events of one request: host, method, canonical path and status."""
    host = F.when(F.coalesce(host, F.lit("")) == "", "<unknown-host>").otherwise(host)
    return F.concat_ws("|", host, method, canonical_path(path), status.cast("string"))


def rejects(status: Column) -> Column:
    return status.isin(REJECTING)


def bare_ip(host: Column) -> Column:
    """Whether a host is an address, with or without a port; a bracketed IPv6 address needs its port."""
    v4 = t.matches(F.regexp_replace(host, r"^([^:]*):[^:]*\z", "$1"), IPV4)
    bracketed = F.regexp_extract(host, r"^\[(.*)\]:[^:\[\]]*\z", 1)
    bare = F.when(host.contains("["), bracketed).otherwise(host)
    return F.coalesce(v4 | ipv6(bare), F.lit(False))


def ipv6(text: Column) -> Column:
    """Whether a text is an IPv6 address (with an IPv4 tail or without)."""
    tail = r":(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"
    x = F.regexp_replace(text, tail, ":0:0")
    groups = F.filter(F.split(x, ":"), lambda g: g != "")
    plain = x.rlike(r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}\z")
    short = x.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?\z") & (F.size(groups) <= 7)
    return plain | short


# ---- the same in DuckDB SQL ----


def sql_part(line: str, shapes: list, name: str) -> str:
    cases = [f"WHEN regexp_matches({line}, {t.q(p)}) THEN {f'regexp_extract({line}, {t.q(p)}, {g[name]})' if name in g else t.q('')}" for p, g in shapes]
    return f"CASE {' '.join(cases)} ELSE '' END"


def sql_status(line: str, shapes: list) -> str:
    return f"coalesce(nullif({sql_part(line, shapes, 'status')}, '')::INT, 0)"


def sql_bytes(line: str) -> str:
    one = [f"CASE WHEN regexp_matches({line}, {t.q(p)}) THEN TRY_CAST(regexp_extract({line}, {t.q(p)}, 1) AS BIGINT) END" for p in (QUOTED_BYTES, MORGAN_BYTES)]
    return f"coalesce({one[0]}, {one[1]}, 0)"


def sql_canonical(path: str) -> str:
    return t.sql_replace(path, LONG_NUMBER, "<NUM>")
