"""Log lines without what varies: one normaliser for each source family, and the hash of the result.

Each normaliser is a list of (pattern, replacement) steps in a fixed order; the lists below are fixed values,
as stored patterns and hashes depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import text as t
from logsieve.sources.tables import apart

# Patterns (RE2) and placeholders of the normalisers, in the order in which they apply.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
_BRACKET_TIME = r"\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s[+\-]\d{4}\]"
GENERIC = [
    (r"\x1b\[[0-9;]*m", ""),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[\.\d]*[Z\+\-][\d:]*", "<TS>"),
    (_BRACKET_TIME, "<TS>"),
    (_MONTH + _CLOCK, "<TS>"),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<TS>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"\b\d+[\.\d]*(?:ns|µs|us|μs|ms|s|m|h)\b", "<DUR>"),
    (r"\b\d{4,}\b", "<NUM>"),
]
NGINX_ERROR = [
    (r"^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+", ""),
    (r"\d+#\d+:", "<PID>:"),
    (r"\*\d+", "*<CONN>"),
    (r"client:\s+\S+,", "client: <CLIENT>,"),
    (r"process \d+", "process <NUM>"),
]
SSHD = [
    (rf"^{_MONTH}{_CLOCK}\s+\S+\s+sshd\[\d+\]:\s*", ""),
    (r"^sshd\[\d+\]:\s*", ""),
    (r"(?i)PAM \d+ more authentication failures?", "PAM <N> more authentication failures"),
    (r"from\s+\S+\s+port\s+\d+", "from <IP> port <PORT>"),
    (r"by\s+\S+\s+port\s+\d+", "by <IP> port <PORT>"),
    (r"\(uid=\d+\)", "(uid=<UID>)"),
    (r"session\s+\d+", "session <SID>"),
    (r"(?i)(invalid user )\S+", "$1<USER>"),
    (r"SHA256:\S+", "SHA256:<FP>"),
    (r"rhost=\S+", "rhost=<IP>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){2,}[0-9a-fA-F]{0,4}\b", "<IP>"),
    (r"\bport \d+\b", "port <PORT>"),
    (r"\[\d+\]", "[<PID>]"),
]
SYSLOG_PREFIXES = [
    rf"^{_MONTH}{_CLOCK}\s+\S+\s+\S+\[\d+\]:\s*",
    rf"^{_MONTH}{_CLOCK}\s+\S+\s+\S+:\s*",
    rf"^{_MONTH}{_CLOCK}\s+",
]
POSTGRES_HEAD = [(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[\.\d]*\s+\w+\s+", ""), (r"\[\d+\]\s*", "")]
POSTGRES_LEVELS = [" LOG:", " ERROR:", " WARNING:"]
# Greater-than comes first: the placeholders of the others end in that sign.
POSTGRES_BODY = [
    (r"duration:\s+[\d\.]+\s+ms", "duration: <DUR> ms"),
    (r">\s*\d+", "> <N>"),
    (r"<\s*\d+", "< <N>"),
    (r"=\s*\d+", "= <N>"),
    (r"LIMIT\s*\d+", "LIMIT <N>"),
    (r"limit\s*\d+", "limit <N>"),
    (r"OFFSET\s*\d+", "OFFSET <N>"),
    (r"offset\s*\d+", "offset <N>"),
    (r"(?i)(?:LIMIT|OFFSET|IN\s*\()\s*\d+", "<N>"),
    (r"'[^']*'", "'<STR>'"),
    (r"\b\d+\s+(buffers|bytes|files|segments|records)", "<N> $1"),
]
NGINX_PREFIX = r"^\S+\s+-\s+\S+\s+"
REQUEST = r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|CONNECT|TRACE)\s+\S+\s+HTTP/\d(?:\.\d)?$"
STATUS = r"^\s*(\d{3})\s+\d+"
UNIT_SUFFIX = r"\.(service|socket|timer|scope|slice)$"

#: Families that have a normaliser, in the order in which a source name is searched for them.
FAMILIES = ["nginx", "sshd", "postgres", "syslog", "docker"]


def _steps(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = t.replace(c, pattern, by)
    return c


def _byte(c: Column, i: int) -> Column:
    return F.substring(c, i, 1)


def _without_header(line: Column) -> Column:
    return F.when((F.octet_length(line) > 8) & F.substring(line, 1, 1).isin("\x01", "\x02"), F.substring(line, 9, 2**31 - 1)).otherwise(line)


def strip_framing(line: Column) -> Column:
    """A line without the collector's stream header and timestamp."""
    return t.trim(drop_timestamp(_without_header(t.trim(line)), 20))


def drop_timestamp(line: Column, longer: int) -> Column:
    """Without what precedes the first space, if the line begins like an ISO timestamp and that space is near."""
    return F.when(F.octet_length(line) > longer, F.regexp_replace(line, r"^(?=[\s\S]{4}-[\s\S]{2}-[\s\S]{2}T)[^ ]{1,39} ", "")).otherwise(line)


def generic(line: Column) -> Column:
    """Times, ids, addresses, durations and long numbers replaced; white space collapsed."""
    x = t.trim(line)
    # the first step has nothing to do where no escape character is
    x = F.when(x.contains("\x1b"), t.replace(x, *GENERIC[0])).otherwise(x)
    return t.collapse(_steps(x, GENERIC[1:]))


def nginx_error(line: Column) -> Column:
    return t.collapse(_steps(t.trim(line), NGINX_ERROR))


def _quoted(line: Column) -> Column:
    """An access line without address and time; what is left is the quoted fields and what stands between them."""
    return t.trim(t.replace(t.replace(t.trim(line), NGINX_PREFIX, ""), _BRACKET_TIME, ""))


def _with_access(df: DataFrame, line: Column, into: str) -> DataFrame:
    """``df`` with the access normaliser's result for ``line`` (null for null)."""
    df = apart(df.withColumn("_x", _quoted(line)))
    df = df.withColumn("_fields", F.regexp_extract_all("_x", F.lit('"([^"]*)"'), F.lit(1)))
    df = df.withColumn("_at", F.array_position(F.transform("_fields", lambda f: t.matches(f, REQUEST)), True))
    request, host = F.get("_fields", (F.col("_at") - 1).cast("int")), F.when(F.col("_at") > 1, F.get("_fields", (F.col("_at") - 2).cast("int")))
    df = apart(df.withColumns({"_request": request, "_host": F.nullif(host, F.lit(""))}))
    quoted = F.concat(F.lit('"'), "_request", F.lit('"'))
    rest = t.trim(F.substring(F.col("_x"), F.instr("_x", quoted) + F.length("_request") + 2, F.lit(2**31 - 1)))
    df = df.withColumn("_status", F.coalesce(F.get(F.regexp_extract_all(rest, F.lit(t.java(STATUS)), F.lit(1)), F.lit(0)), F.lit("000")))
    return apart(df).withColumn(into, F.when(F.col("_at") > 0, F.concat_ws(" ", "_host", "_request", "_status")).otherwise(t.collapse(F.col("_x")))).drop("_x", "_fields", "_at", "_request", "_host", "_status")


def with_nginx_access(df: DataFrame, line: str, into: str = "normalized") -> DataFrame:
    """``df`` with ``into``: host (a quoted field right before the request), request line and status of an access line; the collapsed line where no quoted field is a request."""
    return _with_access(df, F.col(line), into)


def sshd(line: Column) -> Column:
    return t.collapse(_steps(t.trim(line), SSHD))


def syslog(line: Column) -> Column:
    """The first kind of prefix that the line has goes, the rest is generic."""
    return generic(F.regexp_replace(t.trim(line), "|".join(f"(?:{t.java(p)})" for p in SYSLOG_PREFIXES), ""))


def postgres(line: Column) -> Column:
    """Without time, process and session; durations, numbers and strings replaced."""
    x = _steps(t.trim(line), POSTGRES_HEAD)
    for level in POSTGRES_LEVELS:
        # what precedes the first level and its space goes, if it is short and names a user and database
        other = rf"(?!{level})"
        x = F.regexp_replace(x, rf"^(?=(?:{other}[\s\S]){{1,49}}{level})(?:{other}[^@])*@(?:{other}[\s\S])* (?={level.strip()})", "")
    return t.collapse(_steps(x, POSTGRES_BODY))


def family(source_type: Column, source_name: Column) -> Column:
    """Which normaliser a source takes: its own name, a family that its name contains (other than its type), its type, or generic."""
    out = F.when(source_name.isin(FAMILIES), source_name)
    for f in FAMILIES:
        # lower() is slow, so that it is for names that are not in lower case
        out = out.when((source_type != f) & (source_name.contains(f) | (source_name.rlike(f"(?iu){f}") & F.lower(source_name).contains(f))), f)
    return out.when(source_type.isin(FAMILIES), source_type).otherwise("generic")


def with_normalized(df: DataFrame, into: str = "normalized", source_type: str = "source_type", source_name: str = "source_name", line: str = "line") -> DataFrame:
    """``df`` with ``into``: the line as its source's normaliser makes it, without collector framing.

    Each step is a column of its own, so that nothing is computed twice and only the steps of a line's family run.
    Families are compiled apart: together they exceed by far the 8000 bytes up to which the JVM compiles a method.
    """
    f, x = F.col("_family"), F.col("_framed")
    df = apart(df.withColumns({"_family": family(F.col(source_type), F.col(source_name)), "_framed": strip_framing(F.col(line))}))
    error = (F.octet_length(x) > 4) & (_byte(x, 5) == "/")
    df = df.withColumn("_access", F.when((f == "nginx") & ~error, x))
    df = apart(_with_access(df, F.col("_access"), "_access"))
    own = {"nginx": nginx_error, "sshd": sshd, "syslog": syslog, "postgres": postgres}
    for name, steps in own.items():
        df = apart(df.withColumn("_access", F.when(F.col("_access").isNull() & (f == name), steps(x)).otherwise(F.col("_access"))))
    return apart(df.withColumn(into, F.coalesce("_access", F.when(~f.isin(*own), generic(x))))).drop("_family", "_framed", "_access")


def line_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def unit_base(unit: Column) -> Column:
    """A systemd unit's name without suffix and instance, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(unit, r"\.[^.]*\z", ""), r"(?s)@.*\z", ""))


def unit_stem(unit: Column) -> Column:
    """A unit's name without one of the five known suffixes."""
    return t.replace(unit, UNIT_SUFFIX, "")


def container_base(name: Column) -> Column:
    """A container's name without its leading slash, up to the first dot."""
    return F.substring_index(F.regexp_replace(name, "^/", ""), ".", 1)


def short_id(id_: Column) -> Column:
    return F.substring(id_, 1, 12)


# ---- the same in DuckDB SQL ----


def _sql_steps(c: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        c = t.sql_replace(c, pattern, by)
    return c


def sql_drop_timestamp(c: str, longer: int) -> str:
    return f"CASE WHEN strlen({c}) > {longer} AND substr({c}, 5, 1) = '-' AND substr({c}, 8, 1) = '-' AND substr({c}, 11, 1) = 'T' AND instr({c}, ' ') BETWEEN 2 AND 40 THEN substr({c}, instr({c}, ' ') + 1) ELSE {c} END"


def sql_generic(c: str) -> str:
    return t.sql_collapse(_sql_steps(t.sql_trim(c), GENERIC))


def sql_nginx_error(c: str) -> str:
    return t.sql_collapse(_sql_steps(t.sql_trim(c), NGINX_ERROR))


def sql_sshd(c: str) -> str:
    return t.sql_collapse(_sql_steps(t.sql_trim(c), SSHD))


def sql_syslog(c: str) -> str:
    x = t.sql_trim(c)
    cut = f"CASE {' '.join(f'WHEN regexp_matches({x}, {t.q(p)}) THEN {t.sql_replace(x, p, str())}' for p in SYSLOG_PREFIXES)} ELSE {x} END"
    return sql_generic(f"({cut})")


def sql_family(source_type: str, source_name: str) -> str:
    names = ", ".join(t.q(f) for f in FAMILIES)
    within = " ".join(f"WHEN {source_type} <> {t.q(f)} AND contains(lower({source_name}), {t.q(f)}) THEN {t.q(f)}" for f in FAMILIES)
    return f"CASE WHEN {source_name} IN ({names}) THEN {source_name} {within} WHEN {source_type} IN ({names}) THEN {source_type} ELSE 'generic' END"


def _sql_level(c: str, level: str) -> str:
    at = f"instr({c}, {t.q(level)})"
    before = f"substr({c}, 1, {at} - 1)"
    return f"CASE WHEN {at} > 1 AND strlen({before}) < 50 AND contains({before}, '@') THEN substr({c}, {at} + 1) ELSE {c} END"


def sql_normalized(source: str) -> str:
    """Common table expressions that end in ``norm``: the rows of ``source`` with framed, family and normalized."""
    fields = "regexp_extract_all(x, '\"([^\"]*)\"', 1)"
    prep = t.sql_trim(t.sql_replace(t.sql_replace(t.sql_trim("framed"), NGINX_PREFIX, ""), _BRACKET_TIME, ""))
    rest = t.sql_trim("substr(x, instr(x, '\"' || req || '\"') + length(req) + 2)")
    return f"""
n0 AS (SELECT *, {t.sql_trim("line")} AS l0 FROM ({source})),
n1 AS (SELECT *, CASE WHEN strlen(l0) > 8 AND substr(l0, 1, 1) IN (chr(1), chr(2)) THEN substr(l0, 9) ELSE l0 END AS l1 FROM n0),
n2 AS (SELECT *, {sql_drop_timestamp("l1", 20)} AS l2 FROM n1),
n3 AS (SELECT *, {t.sql_trim("l2")} AS framed, {sql_family("source_type", "source_name")} AS family FROM n2),
n4 AS (SELECT *, {prep} AS x, {_sql_steps(t.sql_trim("framed"), POSTGRES_HEAD)} AS p0 FROM n3),
n5 AS (SELECT *, {fields} AS f, list_position(list_transform({fields}, lambda e: regexp_matches(e, {t.q(REQUEST)})), true) AS at_, {_sql_level("p0", POSTGRES_LEVELS[0])} AS p1 FROM n4),
n6 AS (SELECT *, CASE WHEN at_ > 0 THEN f[at_] END AS req, CASE WHEN at_ > 1 THEN f[at_ - 1] END AS host_, {_sql_level("p1", POSTGRES_LEVELS[1])} AS p2 FROM n5),
n7 AS (SELECT *, coalesce(nullif(regexp_extract({rest}, {t.q(STATUS)}, 1), ''), '000') AS code_, {_sql_level("p2", POSTGRES_LEVELS[2])} AS p3 FROM n6),
norm AS (SELECT *, CASE family
  WHEN 'nginx' THEN CASE WHEN strlen(framed) > 4 AND substr(framed, 5, 1) = '/' THEN {sql_nginx_error("framed")}
    WHEN req IS NULL THEN {t.sql_collapse("x")} ELSE concat_ws(' ', nullif(host_, ''), req, code_) END
  WHEN 'sshd' THEN {sql_sshd("framed")}
  WHEN 'syslog' THEN {sql_syslog("framed")}
  WHEN 'postgres' THEN {t.sql_collapse(_sql_steps("p3", POSTGRES_BODY))}
  ELSE {sql_generic("framed")} END AS normalized FROM n7)"""
