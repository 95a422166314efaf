"""Log lines out of journal exports, container streams and inventories."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.functions import filters
from logsieve.functions import text as t
from logsieve.operators.patterns import small

# The fields of a journal entry, all text.
FIELDS = ["MESSAGE", "SYSLOG_IDENTIFIER", "_SYSTEMD_UNIT", "PRIORITY", "_PID", "_UID", "__REALTIME_TIMESTAMP", "_TRANSPORT", "_COMM", "_EXE", "_CMDLINE", "_HOSTNAME"]
#: Most bytes of a line of an export.
LINE_BYTES = 256 * 1024
# A container stream's frame is a header of eight bytes (kind, three zeros, big-endian size) and a payload; a larger frame ends the stream.
FRAME_BYTES = 1 << 20
FRAMES = "path string, n long, stream string, line string"
#: Shape of an inventory of containers.
CONTAINERS = "id string, names array<string>, ports array<struct<ip: string, private: int, public: int, type: string, publish_mode: string>>"


def entries(exports: DataFrame, own_unit: str = "", noise: list[str] | None = None) -> DataFrame:
    """Log lines of journal exports (``value``: one JSON object a line): source_type, source_name, unit, stream, line, ts, metadata.

    Works on a table and on a stream. Lines that are no object (cut ones too), are too long, or of which a field is
    there but neither text nor null (as a message in bytes is), and entries without a message, of the unit
    ``own_unit`` or of a noisy unit go. ts is null where the entry has none.
    """
    rows = exports.where((F.octet_length("value") <= LINE_BYTES) & F.startswith(t.trim(F.col("value")), F.lit("{"))).select(F.try_parse_json("value").alias("v"))
    kinds = [F.coalesce(F.schema_of_variant(F.variant_get("v", f"$.{c}", "variant")), F.lit("VOID")).isin("STRING", "VOID") for c in FIELDS]
    # fields are read as text only where they are
    rows = rows.where(F.col("v").isNotNull() & functools.reduce(Column.__and__, kinds)).select(F.struct(*[F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in FIELDS]).alias("e"))
    some = lambda c: F.nullif(F.col(f"e.{c}"), F.lit(""))
    unit = F.coalesce("e._SYSTEMD_UNIT", F.lit(""))
    rows = rows.where(some("MESSAGE").isNotNull() & ((F.lit(own_unit) == "") | (unit != own_unit)) & ~filters.noise_unit(unit, noise))
    meta = {"unit": "_SYSTEMD_UNIT", "priority": "PRIORITY", "pid": "_PID", "uid": "_UID", "hostname": "_HOSTNAME"}
    return rows.select(
        F.lit("journal").alias("source_type"), F.coalesce(some("SYSLOG_IDENTIFIER"), some("_COMM"), F.lit("unknown")).alias("source_name"), unit.alias("unit"),
        F.coalesce(some("_TRANSPORT"), F.lit("journal")).alias("stream"), F.col("e.MESSAGE").alias("line"), F.timestamp_micros(F.col("e.__REALTIME_TIMESTAMP").try_cast("bigint")).alias("ts"),
        F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), F.coalesce(f"e.{v}", F.lit("")))]).alias("metadata"),
    )


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            data, at, n = memoryview(content.as_buffer()) if content.is_valid else memoryview(b""), 0, 0
            while at + 8 <= len(data):
                size = int.from_bytes(data[at + 4 : at + 8], "big")
                if size > FRAME_BYTES or at + 8 + size > len(data):
                    break
                rows.append((path, n, "stderr" if data[at] == 2 else "stdout", bytes(data[at + 8 : at + 8 + size]).decode("utf-8", "replace")))
                at, n = at + 8 + size, n + 1
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "n", "stream", "line"])


def container_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of captured container streams under ``path``: path, n (place in the stream), stream, line, ts. A stream is a file of bounded size and read in one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_time(files.select("path", "content").mapInArrow(_frames, FRAMES))


def with_time(frames: DataFrame) -> DataFrame:
    """``frames`` (line, ...) with ``line`` trimmed and ``ts``, the time at the line's head, which goes; blank lines go. ts is null where there is none."""
    rows = frames.withColumn("line", t.trim(F.col("line"))).where("line <> ''")
    head = F.substring_index("line", " ", 1)
    at = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"), F.try_to_timestamp(head))
    rows = rows.withColumn("ts", at)
    return rows.withColumn("line", F.when(F.col("ts").isNotNull(), F.ltrim(F.substring(F.col("line"), F.length(F.substring_index("line", " ", 1)) + 1, F.lit(2**31 - 1)))).otherwise(F.col("line")))


def container_name(names: Column) -> Column:
    """A container's first name without its slash, up to the first dot."""
    return F.substring_index(F.regexp_replace(F.coalesce(F.get(names, F.lit(0)), F.lit("")), "^/", ""), ".", 1)


def discovered(containers: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """``containers`` (as CONTAINERS) with name, class (public, excluded or skipped) and reason: a container is public if it publishes a TCP port on more than the loopback address. ``excluded`` names count like a container's own, whatever their case."""
    tcp = F.filter("ports", lambda p: (F.coalesce(p["public"], F.lit(0)) > 0) & (F.lower(F.coalesce(p["type"], F.lit(""))) == "tcp"))
    out = containers.withColumns({"name": container_name(F.col("names")), "_tcp": F.coalesce(tcp, F.array().cast(containers.schema["ports"].dataType))})
    names = {x.removeprefix("/").split(".")[0].lower() for x in excluded or []} - {""}
    public = F.exists("_tcp", lambda p: ~F.coalesce(p["ip"], F.lit("")).isin("127.0.0.1", "::1"))
    kind = F.when(public & F.lower("name").isin(sorted(names)), "excluded").when(public, "public").otherwise("skipped")
    why = F.when(public, "").when(F.size("_tcp") > 0, "loopback-only publish").otherwise("no published TCP ports")
    return out.withColumns({"class": kind, "reason": why}).drop("_tcp")


def covered(found: DataFrame, most: int = 16) -> DataFrame:
    """``found`` (id, name, class, as of ``discovered``, and host) as far as it is watched: of a host's public containers the first ``most`` by name and id, the others are of class dropped_by_cap.

    Containers that are listed twice count once. The first of a host are taken in two steps, so that a large host is spread.
    """
    key = found.where(F.col("class") == "public").select("host", "name", "id").distinct().withColumn("_part", F.pmod(F.xxhash64("name", "id"), F.lit(64)))
    for part in (["host", "_part"], ["host"]):
        key = key.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy("name", "id"))).where(F.col("_at") <= most)
    kept = key.select(F.col("host").alias("_host"), F.col("name").alias("_name"), F.col("id").alias("_id"), F.lit(True).alias("_kept"))
    out = found.join(kept, F.col("host").eqNullSafe(F.col("_host")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("class") == "public"), "left")
    return out.withColumn("class", F.when((F.col("class") == "public") & F.col("_kept").isNull(), "dropped_by_cap").otherwise(F.col("class"))).drop("_host", "_name", "_id", "_kept")


def stored_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of a saved store (JSON: scope to bucket to a list of patterns with type, value, source, reason, revoked): scope, bucket, tier, value, source, reason, revoked, ord."""
    pattern = "struct<type: string, value: string, source: string, reason: string, revoked: boolean>"
    text = spark.read.text(path, wholetext=True)
    scopes = text.select(F.explode(F.from_json("value", f"map<string, map<string, array<{pattern}>>>")).alias("scope", "buckets"))
    rows = scopes.select("scope", F.explode("buckets").alias("bucket", "list")).select("scope", "bucket", F.posexplode("list").alias("ord", "p"))
    return rows.select("scope", "bucket", F.col("p.type").alias("tier"), "p.value", F.coalesce("p.source", F.lit("llm")).alias("source"), F.coalesce("p.reason", F.lit("")).alias("reason"), F.coalesce("p.revoked", F.lit(False)).alias("revoked"), F.col("ord").cast("long").alias("ord"))


def without_containers(lines: DataFrame, excluded: list[str]) -> DataFrame:
    """``lines`` (source_name, ...) of containers whose exact name is not ``excluded``."""
    return lines.where(~F.col("source_name").isin(excluded)) if excluded else lines


# How the token of a check of our own begins (32 hexadecimal digits follow), the seconds for which it lives, and how many live at a time.
TOKEN_HEAD, TOKEN_SECONDS, TOKENS_ALIVE = "OV-", 10, 50


def _evicted(tokens: pd.DataFrame) -> pd.DataFrame:
    """Tokens of a bin of time that gave way: TOKENS_ALIVE - 1 newer ones, untaken, were alive beside them when one more was minted."""
    tokens = tokens.sort_values(["minted", "token"])
    minted, taken = tokens["minted"].to_numpy(float), tokens["taken"].fillna(np.inf).to_numpy(float)
    gone = []
    for i in np.flatnonzero((tokens["own"] == tokens["bin"]).to_numpy()):
        end = np.searchsorted(minted, min(minted[i] + TOKEN_SECONDS, taken[i]), "right")
        after, until = minted[i + 1 : end], taken[i + 1 : end]
        if any((until[:j] >= after[j]).sum() >= TOKENS_ALIVE - 1 for j in range(TOKENS_ALIVE - 1, len(after))):
            gone.append(tokens["token"].iat[i])
    return pd.DataFrame({"token": pd.Series(gone, dtype=object)})


def without_own_checks(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """``lines`` (line, ts) without those that our own checks have caused. ``tokens``: token, minted.

    A line in which a token stands, alone or within other text, is taken by it if the token is then at most
    TOKEN_SECONDS old; it takes one line only, the first in time (of equal times, in the order of the table). Of more
    than TOKENS_ALIVE tokens alive and untaken at a time the oldest give way and take no line; this is told within
    bins of TOKEN_SECONDS, each with the bin after it. A token that is listed twice counts from the first time.
    """
    held = F.regexp_extract_all("line", F.lit(f"{TOKEN_HEAD}[0-9a-f]{{32}}"), F.lit(0))
    marked = lines.withColumn("_row", F.monotonically_increasing_id() if "event_id" not in lines.columns else F.col("event_id"))
    minted = tokens.groupBy("token").agg(F.min("minted").cast("double").alias("minted"))
    held = marked.where(F.contains("line", F.lit(TOKEN_HEAD))).select("_row", F.col("ts").cast("double").alias("at"), F.explode(F.array_distinct(held)).alias("token")).join(small(minted), "token")
    taken = held.where((F.col("at") - F.col("minted")).between(0, TOKEN_SECONDS)).groupBy("token").agg(F.min(F.struct("at", "_row")).alias("first"))
    known = minted.join(taken, "token", "left").select("token", "minted", F.col("first.at").alias("taken"), F.col("first._row").alias("_row"), F.floor(F.col("minted") / TOKEN_SECONDS).alias("own"))
    near = known.drop("_row").withColumn("bin", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    gone = near.groupBy("bin").applyInPandas(_evicted, "token string")
    own = known.where(F.col("_row").isNotNull()).join(gone, "token", "left_anti").select("_row").distinct()
    return marked.join(own, "_row", "left_anti").select(*lines.columns)
