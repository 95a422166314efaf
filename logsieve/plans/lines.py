"""Queries on log lines: normalising, parsing and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import filters, http
from logsieve.functions import normalize as n
from logsieve.functions import text as t
from logsieve.sources import log_lines as source
from logsieve.sources.tables import spread

LINES = source.sql()
#: Documents that one task works on.
TASK_TEXTS = 2000


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with their normalised form."""
    return n.with_normalized(source.log_lines(spark, sf_dir))


def _columns(spark: SparkSession, sf_dir: str, on: str = "line", **columns: Column) -> DataFrame:
    rows = normalized(spark, sf_dir) if on == "normalized" else source.log_lines(spark, sf_dir)
    return rows.select("event_id", *[c.alias(k) for k, c in columns.items()])


def strip_framing(spark, sf_dir):
    framed = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".411683956Z "), F.col("line"))
    return _columns(spark, sf_dir, stripped=n.strip_framing(framed), plain=n.strip_framing(F.col("line")))


def normalize_generic(spark, sf_dir):
    return _columns(spark, sf_dir, normalized=n.generic(F.col("line")))


def normalize_generic_texts(spark, sf_dir):
    """The generic normaliser over all documents, whose letters are not all ASCII."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", TASK_TEXTS)
    return docs.select("doc_id", n.line_hash(n.generic(F.col("text"))).alias("hash"))


def normalize_nginx_access(spark, sf_dir):
    vhost = F.regexp_replace(F.col("line"), '"(GET|POST)', '"shop.example.com" "$1')
    rows = source.log_lines(spark, sf_dir).withColumn("vhost", vhost)
    return n.with_nginx_access(n.with_nginx_access(rows, "line", "plain"), "vhost", "hosted").select("event_id", "plain", "hosted")


def normalize_nginx_error(spark, sf_dir):
    return _columns(spark, sf_dir, normalized=n.nginx_error(F.col("line")))


def normalize_sshd(spark, sf_dir):
    return _columns(spark, sf_dir, normalized=n.sshd(F.concat(F.lit("Mar  7 15:10:04 host sshd[123]: "), F.col("line"))))


def normalize_syslog(spark, sf_dir):
    return _columns(spark, sf_dir, normalized=n.syslog(F.concat(F.lit("Mar 17 15:10:04 host app: "), F.col("line"))))


def normalize_lines(spark, sf_dir):
    """Every line by its source's normaliser, postgres among them, with its hash."""
    rows = normalized(spark, sf_dir)
    return rows.select("event_id", n.family(F.col("source_type"), F.col("source_name")).alias("family"), "normalized", n.line_hash(F.col("normalized")).alias("hash"))


def line_hash(spark, sf_dir):
    return _columns(spark, sf_dir, hash=n.line_hash(F.col("line")))


def unit_base(spark, sf_dir):
    odd = F.concat(F.lit("Sshd@"), F.col("ip"), F.lit("-22.service"))
    return _columns(spark, sf_dir, base=n.unit_base(F.col("unit")), instance=n.unit_base(odd), stem=n.unit_stem(odd), container=n.container_base(F.concat(F.lit("/"), F.col("source_name"), F.lit(".1.x"))))


def parse_http(spark, sf_dir):
    rows = http.with_identity(http.with_identity(normalized(spark, sf_dir), "normalized", "a"), "line", "b", http.RAW_SHAPES)
    return rows.select("event_id", *[F.col(f"{x}.{c}").alias(f"{p}_{c}") for x, p in (("a", "norm"), ("b", "raw")) for c in ("method", "path", "host", "status")])


def response_bytes(spark, sf_dir):
    return _columns(spark, sf_dir, bytes=http.response_bytes(F.col("line")))


def canonical_path(spark, sf_dir):
    return _columns(spark, sf_dir, canonical=http.canonical_path(F.col("path")), method_path=http.method_path(F.lower("method"), F.col("path"))["path"], upper=http.method_path(F.lower("method"), F.col("path"))["method"])


def correlation_key(spark, sf_dir):
    host = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "shop.example.com")
    return _columns(spark, sf_dir, key=http.correlation_key(host, F.col("method"), F.col("path"), F.col("status")))


def bare_ip(spark, sf_dir):
    host = F.when(F.col("event_id") % 4 == 0, F.col("ip")).when(F.col("event_id") % 4 == 1, F.concat("ip", F.lit(":8080"))).when(F.col("event_id") % 4 == 2, "shop.example.com:80").otherwise(F.concat(F.lit("256."), "ip"))
    return _columns(spark, sf_dir, host=host, bare=http.bare_ip(host))


def failed_probe(spark, sf_dir):
    return filters.with_failed_probe(normalized(spark, sf_dir), "normalized", "reason").select("event_id", "reason")


def op_noise(spark, sf_dir):
    framed = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".411683956Z "), F.col("line"))
    return _columns(spark, sf_dir, noise=filters.operational_noise(F.col("line")), framed=filters.operational_noise(framed))


def disclosure(spark, sf_dir):
    return _columns(spark, sf_dir, disclosure=filters.disclosure(F.col("line")))


_REQUEST = ("path", "concat(path, '%2e%2e%2Fx')", "concat(path, '?q=%253Cscript%253E&z=%zz')")


def attack_indicators(spark, sf_dir):
    a, b, c = (F.col("path"), F.concat("path", F.lit("%2e%2e%2Fx")), F.concat("path", F.lit("?q=%253Cscript%253E&z=%zz")))
    return _columns(spark, sf_dir, plain=filters.attack_marks(a), once=filters.attack_marks(b), twice=filters.attack_marks(c))


def sensitive_path(spark, sf_dir):
    return _columns(spark, sf_dir, sensitive=filters.sensitive_path(F.upper("path")))


def url_decode_forgiving(spark, sf_dir):
    return _columns(spark, sf_dir, decoded=t.url_decode(F.concat("path", F.lit("&x=%41%zz+%2"))))


def noise_units(spark, sf_dir):
    unit = F.when(F.col("event_id") % 3 == 0, "Cron.service").when(F.col("event_id") % 3 == 1, "").otherwise(F.col("unit"))
    return _columns(spark, sf_dir, noise=filters.noise_unit(unit, ["SSH"]))


QUERIES = {f.__name__: f for f in (
    strip_framing, normalize_generic, normalize_generic_texts, normalize_nginx_access, normalize_nginx_error, normalize_sshd, normalize_syslog, normalize_lines,
    line_hash, unit_base, parse_http, response_bytes, canonical_path, correlation_key, bare_ip, failed_probe, op_noise, disclosure, attack_indicators,
    sensitive_path, url_decode_forgiving, noise_units,
)}


def _from(expressions: str) -> str:
    return f"SELECT event_id, {expressions} FROM ({LINES}) s"


def with_norm(rest: str) -> str:
    return f"WITH {n.sql_normalized(LINES)} {rest}"



_STAMPED = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.411683956Z ' || line"
_HOST4 = "CASE event_id % 4 WHEN 0 THEN ip WHEN 1 THEN ip || ':8080' WHEN 2 THEN 'shop.example.com:80' ELSE '256.' || ip END"
_MARKS = ", ".join(t.q(a.upper()) for a in filters.ATTACK)


def _sql_marks(e: str) -> str:
    once = f"url_decode(replace({e}, '+', ' '))"
    twice = f"url_decode(replace({once}, '+', ' '))"
    return f"len(list_filter([{_MARKS}], lambda m: contains(upper({e}), m) OR contains(upper({once}), m) OR contains(upper({twice}), m))) > 0"



def _access_sql(line: str) -> str:
    """The access normaliser on every line, whatever its shape."""
    norm = n.sql_normalized(f"SELECT event_id, 'docker' AS source_type, 'nginx' AS source_name, {line} AS line FROM ({LINES}) s")
    return f"(WITH {norm} SELECT event_id, CASE WHEN req IS NULL THEN {t.sql_collapse('x')} ELSE concat_ws(' ', nullif(host_, ''), req, code_) END AS v FROM norm)"


SQL = {
    "strip_framing": f"WITH a AS (SELECT event_id, {t.sql_trim(_STAMPED)} AS s, {t.sql_trim('line')} AS p FROM ({LINES}) q) SELECT event_id, {t.sql_trim('(' + n.sql_drop_timestamp('s', 20) + ')')} AS stripped, {t.sql_trim('(' + n.sql_drop_timestamp('p', 20) + ')')} AS plain FROM a",
    "normalize_generic": _from(f"{n.sql_generic('line')} AS normalized"),
    "normalize_generic_texts": f"SELECT doc_id, sha256({n.sql_generic('text')}) AS hash FROM documents",
    "normalize_nginx_access": f"SELECT a.event_id, a.v AS plain, b.v AS hosted FROM {_access_sql('line')} a JOIN " + _access_sql("regexp_replace(line, '\"(GET|POST)', '\"shop.example.com\" \"\\1', 'g')") + " b USING (event_id)",
    "normalize_nginx_error": _from(f"{n.sql_nginx_error('line')} AS normalized"),
    "normalize_sshd": _from(f"{n.sql_sshd(chr(40) + t.q('Mar  7 15:10:04 host sshd[123]: ') + ' || line)')} AS normalized"),
    "normalize_syslog": _from(f"{n.sql_syslog(chr(40) + t.q('Mar 17 15:10:04 host app: ') + ' || line)')} AS normalized"),
    "normalize_lines": with_norm("SELECT event_id, family, normalized, sha256(normalized) AS hash FROM norm"),
    "line_hash": _from("sha256(line) AS hash"),
    "unit_base": _from("lower(regexp_replace(regexp_replace(unit, '\\.[^.]*$', ''), '@.*$', '')) AS base, 'sshd' AS instance, 'Sshd@' || ip || '-22' AS stem, source_name AS container"),
    "parse_http": with_norm("SELECT event_id, " + ", ".join(f"{http.sql_part('normalized', http.NORMALIZED_SHAPES, c)} AS norm_{c}, {http.sql_part('line', http.RAW_SHAPES, c)} AS raw_{c}" for c in ("method", "path", "host")) + f", {http.sql_status('normalized', http.NORMALIZED_SHAPES)} AS norm_status, {http.sql_status('line', http.RAW_SHAPES)} AS raw_status FROM norm"),
    "response_bytes": _from(f"{http.sql_bytes('line')} AS bytes"),
    "canonical_path": _from(f"{http.sql_canonical('path')} AS canonical, split_part(path, '?', 1) AS method_path, method AS upper"),
    "correlation_key": _from(f"concat_ws('|', CASE event_id % 3 WHEN 1 THEN 'shop.example.com' ELSE '<unknown-host>' END, method, {http.sql_canonical('path')}, status::VARCHAR) AS key"),
    "bare_ip": _from(f"{_HOST4} AS host, event_id % 4 IN (0, 1) AS bare"),
    "failed_probe": with_norm(f"SELECT event_id, {filters.sql_failed_probe('normalized')} AS reason FROM norm"),
    "op_noise": f"WITH a AS (SELECT event_id, line, {_STAMPED} AS s FROM ({LINES}) q) SELECT event_id, {filters.sql_noise('line')} AS noise, {filters.sql_noise('s')} AS framed FROM a",
    "disclosure": _from(f"{filters.sql_disclosure('line')} AS disclosure"),
    "attack_indicators": _from(", ".join(f"{_sql_marks(e)} AS {k}" for e, k in zip(_REQUEST, ("plain", "once", "twice"), strict=True))),
    "sensitive_path": _from(f"{t.sql_contains_any('lower(upper(path))', filters.SENSITIVE)} AS sensitive"),
    "url_decode_forgiving": _from("url_decode(replace(path || '&x=%41%zz+%2', '+', ' ')) AS decoded"),
    "noise_units": _from("event_id % 3 = 0 OR (event_id % 3 = 2 AND unit = 'ssh.service') AS noise"),
}
