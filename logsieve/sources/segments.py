"""HTTP out of captured TCP payloads: requests from single segments, responses from whole flows put back in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.sources.tables import apart, held

# The methods with which a request begins, the least bytes of one, and the bytes of a segment that are read.
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE"]
LEAST_BYTES, SCAN_BYTES = 14, 8192
# Lengths of a request without a stated length, and of one that comes in chunks.
UNKNOWN, CHUNKED = -1, -2
#: Bytes of a head or of a chunk's size; a longer one is malformed.
HEAD_BYTES = 1 << 20
#: Bytes of previews in one batch of responses.
BATCH_BYTES = 4 << 20
_BLANK = " \t\n\x0b\f\r"
_SCHEMA = pa.schema([("flow", pa.string()), ("n", pa.int32()), ("ts_us", pa.int64()), ("status", pa.int32()), ("content_type", pa.string()), ("content_length", pa.int64()), ("preview", pa.binary())])
RESPONSES = "flow string, n int, ts_us long, status int, content_type string, content_length long, preview binary"


def requests(segments: DataFrame) -> DataFrame:
    """``segments`` (payload binary, ...) that begin a request, with method, path, host, user_agent, content_length and header_len.

    The first SCAN_BYTES are read. host and user_agent are empty where they are not found; of a header that comes
    twice the last counts. content_length is UNKNOWN without one and CHUNKED for chunks; header_len is 0 where the
    headers do not end there. Null and short payloads, unknown methods and cut request lines go. Columns of the same
    names are replaced.
    """
    own = ["method", "path", "host", "user_agent", "content_length", "header_len"]
    rows = segments.drop(*own).where(held(F.octet_length("payload") >= LEAST_BYTES))
    rows = rows.withColumn("_text", F.decode(F.substring("payload", 1, SCAN_BYTES), "ISO-8859-1")).where(held(F.col("_text").rlike(f"^(?:{'|'.join(METHODS)}) ") & F.col("_text").contains("\n")))
    # the first empty line ends the head; of a head that does not end, what follows the last line feed is cut
    upto = lambda x: F.when(F.contains("_text", F.lit(x)), F.length(F.substring_index("_text", x, 1)) + len(x))
    end = F.least(upto("\n\n"), upto("\n\r\n"))
    rows = apart(apart(rows).withColumn("header_len", F.coalesce(end, F.lit(0))))
    whole = F.col("header_len")
    head = F.when(whole > 0, F.substring("_text", F.lit(1), whole)).otherwise(F.substring(F.col("_text"), F.lit(1), F.length("_text") - F.length(F.substring_index("_text", "\n", -1))))
    rows = apart(rows.withColumn("_lines", F.split(head, "\n")))  # a carriage return at a line's end goes with the blanks around a value
    first, shape = F.get("_lines", F.lit(0)), r"(?s)^([^ ]*) (.*) HTTP/[^ ]*\z"
    rows = rows.where(held(first.rlike(shape)))
    named = F.transform(F.filter("_lines", lambda x, i: (i > 0) & x.contains(":")), lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x)), F.lit(_BLANK)).alias("value")))
    rows = apart(rows.withColumn("_named", named))
    utf8 = lambda c: F.encode(c, "ISO-8859-1").cast("string")
    last = lambda name: F.coalesce(F.try_element_at(F.filter("_named", lambda x: x["name"] == name), F.lit(-1))["value"], F.lit(""))
    number = lambda v: F.when(v.rlike(r"^[+-]?[0-9]+\z"), v.try_cast("bigint"))
    lengths = F.transform("_named", lambda x: F.when(x["name"] == "content-length", number(x["value"])).when((x["name"] == "transfer-encoding") & F.lower(x["value"]).contains("chunked"), F.lit(CHUNKED).cast("bigint")))
    rows = rows.withColumns({
        "method": F.regexp_extract(first, shape, 1), "path": utf8(F.regexp_extract(first, shape, 2)), "host": utf8(last("host")), "user_agent": utf8(last("user-agent")),
        "content_length": F.coalesce(F.try_element_at(F.filter(lengths, lambda x: x.isNotNull()), F.lit(-1)), F.lit(UNKNOWN).cast("bigint")),
    })
    return rows.drop("_text", "_lines", "_named")


class _Flow:
    """Responses of one flow, its bytes given in order and a piece at a time; no more than a head or a preview is held."""

    def __init__(self, max_body: int):
        self.max_body, self.n, self.state, self.line = max_body, 0, "head", bytearray()

    def feed(self, data: memoryview) -> Iterator[tuple]:
        at, data = 0, bytes(data)
        while at < len(data) and self.state != "dead":
            if self.state in ("body", "chunk", "close"):
                size = len(data) - at if self.state == "close" else min(self.left, len(data) - at)
                self.preview += data[at : at + min(size, self.max_body - len(self.preview))]
                at += size
                if self.state != "close":
                    self.left -= size
                    if not self.left:
                        if self.state == "body":
                            yield self._done()
                        else:
                            self.state = "chunk end"
                continue
            end = data.find(b"\n", at)
            stop = len(data) if end < 0 else end + 1
            self.line += data[at:stop]
            at = stop
            if len(self.line) > HEAD_BYTES:
                yield from self.broken()
            elif end >= 0:
                yield from self._lines()

    def _lines(self) -> Iterator[tuple]:
        if self.state == "head":
            if not self.line.endswith((b"\n\n", b"\n\r\n")) and bytes(self.line) not in (b"\n", b"\r\n"):
                return
            head, self.line = bytes(self.line), bytearray()
            if not self._head(head):
                self.state = "dead"
            elif self.state == "head":
                yield self._done()
            return
        line, self.line = bytes(self.line).rstrip(b"\r\n"), bytearray()
        if self.state == "chunk size":
            size = line.partition(b";")[0].rstrip()
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
                yield from self.broken()
            else:
                self.left = int(size, 16)
                self.state = "chunk" if self.left else "trailer"
        elif self.state == "chunk end":
            if line:
                yield from self.broken()
            else:
                self.state = "chunk size"
        elif not line:
            yield self._done()

    def _head(self, head: bytes) -> bool:
        """Reads a head and sets how the body ends; whether it is well formed."""
        first, *lines = [x.removesuffix(b"\r") for x in head.split(b"\n")]
        begin = re.match(rb"HTTP/([0-9])\.([0-9]) +([0-9]{3})(?: |\Z)", first)
        if not begin:
            return False
        fields: dict[bytes, list[bytes]] = {}
        for x in lines:
            name, colon, value = x.partition(b":")
            if x and not (colon and name):
                return False
            fields.setdefault(name.lower(), []).append(value.strip())
        self.status, self.type, self.preview, self.length = int(begin[3]), fields.get(b"content-type", [b""])[0], bytearray(), 0
        sizes, coded = set(fields.get(b"content-length", [])), fields.get(b"transfer-encoding", [])
        if coded and begin[1] + begin[2] >= b"11":
            if [x.lower() for x in coded] != [b"chunked"]:
                return False
            sizes, self.length = set(), -1
        if len(sizes) > 1 or any(not re.fullmatch(rb"[0-9]{1,18}", x) for x in sizes):
            return False
        if self.status // 100 == 1 or self.status in (204, 304):
            self.length = 0
        elif self.length < 0:
            self.state = "chunk size"
        elif sizes:
            self.length = self.left = int(sizes.pop())
            self.state = "body" if self.left else "head"
        else:
            self.length, self.state = -1, "close"
        return True

    def _done(self) -> tuple:
        self.state, self.n = "head", self.n + 1
        preview = bytes(self.preview)
        return self.n, self.status, self.type.decode("utf-8", "replace"), len(preview) if self.length < 0 and preview else self.length, preview

    def broken(self) -> Iterator[tuple]:
        """The flow ends or is malformed from here: a response whose body has begun counts with what there is of it."""
        if self.state not in ("head", "dead"):
            yield self._done()
        self.state = "dead"


def _parse(max_body: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        flow, name, upto, ts, held = None, None, 0, 0, 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            rows.clear()
            return out

        for b in batches:
            payloads = b.column("payload")
            for i, (key, at, when) in enumerate(zip(b.column("flow").to_pylist(), b.column("at").to_pylist(), b.column("ts_us").to_pylist(), strict=True)):
                found = []
                if flow is None or key != name:
                    if flow is not None:
                        found += [(name, n, ts, *rest) for n, *rest in flow.broken()]
                    flow, name, upto = _Flow(max_body), key, at
                data = memoryview(payloads[i].as_buffer()) if payloads[i].is_valid else memoryview(b"")
                ts, fresh, upto = when, data[max(0, upto - at) :], max(upto, at + len(data))
                found += [(name, n, ts, *rest) for n, *rest in flow.feed(fresh)]
                for r in found:
                    rows.append(r)
                    held += len(r[-1]) + 64
                if held > BATCH_BYTES:
                    yield batch()
                    held = 0
        if flow is not None:
            rows.extend((name, n, ts, *rest) for n, *rest in flow.broken())
        if rows:
            yield batch()

    return run


def responses(segments: DataFrame, max_body: int = 4096, tasks: int | None = None) -> DataFrame:
    """HTTP/1 responses out of ``segments`` (flow string, seq long: TCP's number of the first byte, ts, payload binary; one direction of a connection is a flow).

    A row for each response: flow, n (from 1, its place in the flow), ts (of the segment that ended it), status,
    content_type, content_length (that of the preview where none is stated), preview (the body's first ``max_body``
    bytes, out of its chunks) and preview_hash (SHA-256). Numbers wrap at 2^32, and a flow's bytes lie within 2^31 of
    its first segment in time. Of bytes that come twice those of the segment that begins first count (of equal
    beginnings the earlier one); bytes that never came are passed over. A malformed head ends its flow, a body that
    is cut counts as far as it goes. Rows without seq or ts go; rows without a flow are one flow; null payloads are empty.

    One shuffle by flow; then each task reads its flows' sorted segments one after the other and holds one head or
    preview, never a flow. A connection's bytes can only be read in order, so a flow is not split. ``tasks`` is the
    number of tasks that flows are dealt among, for segments that grow while the session's number stays.
    """
    by_time = Window.partitionBy("flow").orderBy("ts", "seq")
    rows = segments.where("seq IS NOT NULL AND ts IS NOT NULL").select(F.col("flow").cast("string").alias("flow"), F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "ts", "payload")
    rows = rows.repartition(tasks, "flow") if tasks else rows
    rows = rows.withColumn("at", F.pmod(F.col("seq") - F.first("seq").over(by_time) + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31))
    ordered = rows.select("flow", "at", "ts_us", "payload").sortWithinPartitions("flow", "at", "ts_us", F.octet_length("payload").desc())
    out = ordered.mapInArrow(_parse(max_body), RESPONSES)
    return out.select("flow", "n", F.timestamp_micros("ts_us").alias("ts"), "status", "content_type", "content_length", "preview", F.sha2("preview", 256).alias("preview_hash"))
