"""WARC files and the audit of their fixity by Merkle trees.

``write`` renders pages as WARC/1.0 records and stores them as gzipped WARC files, one for each number of
``file``; ``read`` parses such files by Content-Length. A tree has, from the bottom, records (digest of offset,
length and bytes), offset ranges of RANGE bytes, files, and groups of FANOUT nodes up to one root; each node's
digest is that of its children's in order, so a node stands for an ordered range of offsets. ``audit`` compares
two trees from the root and goes down only where digests differ, so what it reads of the lower levels is the
children of mismatching nodes, and ends at the records that differ, are missing, are extra, or cannot be read.

Defined results: null url and html count as empty, null ids as no id; line ends in a url become spaces; equal
rows are two records, one after the other; an empty table has no file, and equal trees give no row. A record
that moves (because one before it in its file is gone or has another length) is reported where it was
(missing) and where it is (extra), or as altered if another begins there. Extra columns are never read.

Damage never ends an audit. A record is readable if its magic, its Content-Length and the line ends behind its
payload are in their places; else the bytes up to the next record that is (or the file's end) are one unreadable
stretch. A gzip stream is read up to its first fault, where a stretch marks the file as unreadable; records
behind it have no known bytes and are reported as missing. A record written inside a page may be taken for one
while a stretch is searched, and is then an extra one.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.llm.common import checked_broadcast, cut

#: Pages in a file, on average.
FILE_PAGES = 400
#: Bytes of a file under one range node.
RANGE = 1 << 17
FANOUT = 16
_EOL = "\r\n"
RECORDS = "file long, offset long, length long, page_id long, url string, digest string, payload binary, whole string, unreadable boolean"
_MAGIC, _END = b"WARC/", b"\r\n\r\n"
_FIRST_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
#: Compressed bytes that are read at a time from a broken stream.
_BLOCK = 4096


def render(pages: DataFrame, files: int) -> DataFrame:
    """``pages`` (page_id, url, html) as records: file, offset, length, page_id, sha (of the html), whole (SHA-256 of the whole record), head, html. A page's file and place follow from a hash of its row."""
    html, url = F.coalesce("html", F.lit("")), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")
    key = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", F.md5(F.col("html").cast("binary"))))
    size = F.octet_length("html")
    head = F.concat(
        F.lit(f"WARC/1.0{_EOL}WARC-Type: resource{_EOL}WARC-Record-ID: <urn:md5:"), F.col("key"), F.lit(f">{_EOL}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{_EOL}WARC-Date: 2024-01-01T00:00:00Z{_EOL}Content-Type: text/html; charset=utf-8{_EOL}WARC-Payload-Digest: sha256:"), F.col("sha"),
        F.lit(f"{_EOL}Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{_EOL}Content-Length: "), size.cast("string"), F.lit(_EOL * 2),
    )
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html")).withColumns({"key": key, "sha": F.sha2("html", 256)})
    x = x.withColumns({"file": F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(files)), "head": head})
    x = x.withColumns({"length": (F.octet_length("head") + size + 4).cast("long"), "whole": F.sha2(F.concat("head", "html", F.lit(_EOL * 2)), 256)})
    order = Window.partitionBy("file").orderBy("key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return x.select("file", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "page_id", "key", "sha", "whole", "head", "html", F.lead("key").over(order).isNull().alias("last"))


def write(records: DataFrame, path: str) -> None:
    """Stores rendered records as gzipped WARC files under ``path``, each file's records in the order of their offsets."""
    rows = records.select("file", "offset", F.concat("head", "html").alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", "offset").select("file", "value")
    rows.write.partitionBy("file").option("lineSep", _EOL * 2).option("compression", "gzip").text(path)


def _unzipped(data: bytes) -> tuple[bytes, bool]:
    """Content of a file, and whether it is whole; of a broken gzip stream what precedes its first fault."""
    if data[:2] != b"\x1f\x8b":
        return data, True
    try:
        return gzip.decompress(data), True
    except (OSError, EOFError, zlib.error):
        pass
    out: list[bytes] = []
    while data[:2] == b"\x1f\x8b":
        stream, at = zlib.decompressobj(31), 0
        try:
            while at < len(data) and not stream.eof:
                kept = stream.copy()
                out.append(stream.decompress(data[at : at + _BLOCK]))
                at += _BLOCK
        except zlib.error:
            try:
                for i in range(at, len(data)):
                    out.append(kept.decompress(data[i : i + 1]))
            except zlib.error:
                break
        data = stream.unused_data
    return b"".join(out), False


def _record(data: bytes, at: int) -> tuple[int, int, dict[str, str]] | None:
    """Where the payload and the record at ``at`` end, with the header's fields; None if it is not readable."""
    end = data.find(_END, at)
    if end < 0 or not data.startswith(_MAGIC, at):
        return None
    fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    size = fields.get("Content-Length", "").strip()
    if not re.fullmatch("[0-9]{1,18}", size):
        return None
    stop = end + 8 + int(size)
    return (end + 4, stop, fields) if data[stop - 4 : stop] == _END else None


def _next(data: bytes, at: int) -> int:
    """Where the next readable record behind ``at`` begins, or the end."""
    # the line ends before it may be spoilt, too
    for m in _FIRST_LINE.finditer(data, at + 1):
        if _record(data, m.start()):
            return m.start()
    return len(data)


def _page(field: str) -> int | None:
    """A page id, if the field holds one."""
    return int(field) if re.fullmatch("-?[0-9]{1,19}", field) and -(1 << 63) <= int(field) < 1 << 63 else None


def _rows(file: int | None, content: bytes) -> list[tuple]:
    """Records and unreadable stretches of a file."""
    data, whole = _unzipped(content)
    rows, at = [], 0
    while at < len(data):
        if found := _record(data, at):
            start, stop, fields = found
            named = (_page(fields.get("Page-Id", "").strip()), fields.get("WARC-Target-URI", ""), fields.get("WARC-Payload-Digest", ""), data[start : stop - 4])
        else:
            stop, named = _next(data, at), (None, "", "", b"")
        rows.append((file, at, stop - at, *named, hashlib.sha256(data[at:stop]).hexdigest(), not found))
        at = stop
    if not whole and not (rows and rows[-1][-1]):
        rows.append((file, at, 0, None, "", "", b"", "", True))
    return rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.bool_())
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            file = int(path.rsplit("file=", 1)[1].split("/", 1)[0]) if "file=" in path else None
            columns = list(zip(*_rows(file, content.as_py()), strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: file, offset, length, page_id, url, digest (as the record states it), payload, whole (SHA-256 of the whole record), unreadable. A file is parsed in one task; WARC files are of bounded size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parse, RECORDS)


def leaf(sha: Column) -> Column:
    """Digest of a record from its offset, length and the SHA-256 of all its bytes."""
    return F.sha2(F.concat_ws("|", "offset", "length", sha), 256)


class Tree:
    """Levels of a replica's tree, each a table of (keys..., digest); keys of level i are a prefix or a division of those of level i - 1."""

    def __init__(self, records: DataFrame, top: int, name: str):
        """``records``: file, offset, length, page_id, digest (as ``leaf`` has it). ``top``: group levels above the files."""
        join = lambda order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256)
        rows = cut(records.withColumn("range", F.floor(F.col("offset") / RANGE)), f"{name}-records")
        ranges = rows.groupBy("file", "range").agg(join("offset").alias("digest"))
        ranges = cut(ranges, f"{name}-ranges")
        level = ranges.groupBy("file").agg(join("range").alias("digest")).withColumnRenamed("file", "node0")
        self.levels = [cut(level, f"{name}-files")]
        for i in range(1, top + 1):
            below = self.levels[-1].withColumn(f"node{i}", F.floor(F.col(f"node{i - 1}") / FANOUT))
            self.levels.append(cut(below.groupBy(f"node{i}").agg(join(f"node{i - 1}").alias("digest")), f"{name}-group{i}"))
        self.ranges, self.rows = ranges, rows


def _differ(a: DataFrame, b: DataFrame, keys: list[str], within: DataFrame | None, on: list[str], carried: list[str]) -> DataFrame:
    """Nodes that differ among those of both replicas under the nodes ``within``."""
    if within is not None:
        few = checked_broadcast(within.select(*on).distinct())
        a, b = a.join(few, on, "left_semi"), b.join(few, on, "left_semi")
    left = a.select(*keys, F.col("digest").alias("_a"), *[F.col(c).alias(f"a_{c}") for c in carried])
    right = b.select(*keys, F.col("digest").alias("_b"), *[F.col(c).alias(f"b_{c}") for c in carried])
    return left.join(right, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))


def audit(a: DataFrame, b: DataFrame, files: int) -> DataFrame:
    """Where replica ``b`` differs from ``a`` (each: file, offset, length, page_id, digest; with ``unreadable`` where a reader found some): file, offset, length, page_id, status."""
    a, b = (t if "unreadable" in t.columns else t.withColumn("unreadable", F.lit(False)) for t in (a, b))
    top = max(0, math.ceil(math.log(max(1, files), FANOUT)))
    x, y = Tree(a, top, "warc-a"), Tree(b, top, "warc-b")
    within: DataFrame | None = None
    for i in range(top, -1, -1):
        p, q = x.levels[i], y.levels[i]
        if within is not None:
            p, q = (t.withColumn(f"node{i + 1}", F.floor(F.col(f"node{i}") / FANOUT)) for t in (p, q))
        within = cut(_differ(p, q, [f"node{i}"], within, [f"node{i + 1}"], []).select(f"node{i}"), f"warc-differ{i}")
    within = within.withColumnRenamed("node0", "file")
    within = cut(_differ(x.ranges, y.ranges, ["file", "range"], within, ["file"], []).select("file", "range"), "warc-differ-ranges")
    found = _differ(x.rows, y.rows, ["file", "offset"], within, ["file", "range"], ["length", "page_id", "unreadable"])
    bad = F.coalesce("a_unreadable", F.lit(False)) | F.coalesce("b_unreadable", F.lit(False))
    status = F.when(bad, "unreadable").when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("altered")
    return found.select("file", "offset", F.coalesce("a_length", "b_length").alias("length"), F.coalesce("a_page_id", "b_page_id").alias("page_id"), status.alias("status"))


def leaves(records: DataFrame, payload: str | None = None) -> DataFrame:
    """Records, rendered or read, as ``audit`` takes them. Both have their whole bytes' SHA-256 already, so that ``payload``, the column's name, is not read here."""
    unreadable = ["unreadable"] if "unreadable" in records.columns else []
    return records.select("file", "offset", "length", "page_id", leaf(F.col("whole")).alias("digest"), *unreadable)
