import gzip
import hashlib
import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logsieve.llm import warc
from logsieve.llm.common import checkpoint_dir


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>page {i} é</p>" * (i % 40)) for i in range(600)]
    rows += [(None, None, None), (None, "http://x/\r\nEvil: 1", "WARC/1.0\r\n\r\nnot a record\r\n\r\n"), (7, "dup", "same"), (7, "dup", "same"), (8, "long", "z" * 400_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).cache()


def test_files_round_trip(spark, pages):
    path = f"{checkpoint_dir(spark)}/warc-test"
    records = warc.render(pages, 5).cache()
    warc.write(records, path)
    want = sorted((r.file, r.offset, r.length, r.page_id or -1, r.html) for r in records.collect())
    got = warc.read(spark, path).collect()
    assert sorted((r.file, r.offset, r.length, r.page_id or -1, r.payload.decode()) for r in got) == want
    assert all(r.digest == "sha256:" + hashlib.sha256(r.payload).hexdigest() for r in got)
    one = next(Path(path.removeprefix("file://")).rglob("*.gz"))
    data = gzip.decompress(one.read_bytes())
    assert data.startswith(b"WARC/1.0\r\nWARC-Type: resource\r\n") and data.endswith(b"\r\n\r\n")


def test_audit_finds_altered_missing_and_extra_records_only(spark, pages):
    a = warc.leaves(warc.render(pages, 40), "html").cache()
    assert warc.audit(a, a, 40).count() == 0
    rows = a.orderBy("file", "offset").collect()
    altered, gone = rows[100], rows[333]
    b = a.withColumn("digest", F.when((F.col("file") == altered.file) & (F.col("offset") == altered.offset), "0").otherwise(F.col("digest")))
    b = b.where(~((F.col("file") == gone.file) & (F.col("offset") == gone.offset)))
    extra = spark.createDataFrame([(3, 10**9, 5, 99, "d")], a.schema)
    got = sorted((r.file, r.offset, r.status) for r in warc.audit(a, b.union(extra), 40).collect())
    assert got == sorted([(altered.file, altered.offset, "altered"), (gone.file, gone.offset, "missing"), (3, 10**9, "extra")])


def test_a_whole_file_gone_and_empty_tables(spark, pages):
    a = warc.leaves(warc.render(pages, 3), "html").cache()
    assert warc.audit(a, a.where("file <> 1"), 3).where("status = 'missing'").count() == a.where("file = 1").count()
    none = a.limit(0)
    assert warc.audit(none, none, 1).count() == 0
    assert warc.audit(none, a, 3).count() == a.count()


def test_header_faults_and_faults_inside_a_file_are_found(spark, pages):
    path = f"{checkpoint_dir(spark)}/warc-faults-{uuid.uuid4().hex}"
    records = warc.render(pages, 3).cache()
    warc.write(records, path)
    a = warc.leaves(records).cache()
    assert warc.audit(a, warc.leaves(warc.read(spark, path)), 3).count() == 0
    place = {f: sorted((r.offset, r.length) for r in a.where(f"file = {f}").collect()) for f in range(3)}
    data = {f: bytearray(gzip.decompress(next(Path(path.removeprefix("file://")).glob(f"file={f}/*.gz")).read_bytes())) for f in range(3)}
    swaps = [(b"Target-URI: http", b"Target-URI: hxtp"), (b"-Date: 2024", b"-Date: 2034"), (b"<urn:md5:", b"<urn:md4:"), (b"sha256:", b"sha255:"), (b"Page-Id: ", b"Page-Id= "), (b"WARC/1.0", b"XARC/1.0"), (b"Content-Length: ", b"Content-Length: x")]
    want = set()
    for (old, new), (at, length) in zip(swaps, place[0][5::11], strict=False):
        record = bytes(data[0][at : at + length]).replace(old, new, 1)
        assert record != bytes(data[0][at : at + length])
        data[0][at : at + length] = record[:-1] if len(record) > length else record
        want.add((0, at, "unreadable" if new in (b"XARC/1.0", b"Content-Length: x") else "altered"))
    # the last byte of a record in the middle of a file
    at, length = place[0][150]
    data[0][at + length - 1] = 0
    want.add((0, at, "unreadable"))
    # a record inside a file gone: those behind it move
    at, length = place[1][50]
    del data[1][at : at + length]
    want |= {(1, o, "missing") for o, _ in place[1][50:]} | {(1, o - length, "extra") for o, _ in place[1][51:]}
    both = {o for o, _ in place[1][50:]} & {o - length for o, _ in place[1][51:]}
    want = {(f, o, "altered" if f == 1 and o in both else status) for f, o, status in want}
    packed = bytearray(gzip.compress(bytes(data[2])))
    packed[len(packed) // 2 :] = b""
    broken = Path(path.removeprefix("file://") + "-broken")
    for f, content in enumerate([bytes(data[0]), gzip.compress(bytes(data[1])), bytes(packed)]):
        (broken / f"file={f}").mkdir(parents=True)
        (broken / f"file={f}" / "part.warc").write_bytes(content)
    got = {(r.file, r.offset, r.status) for r in warc.audit(a, warc.leaves(warc.read(spark, str(broken))), 3).collect()}
    assert {x for x in got if x[0] < 2} == want
    # the broken file: what precedes the break is sound, one stretch marks the break, the rest is gone
    lost = sorted((o, status) for f, o, status in got if f == 2)
    assert lost[0][1] == "unreadable" and {s for _, s in lost[1:]} == {"missing"}
    assert 0 < len(lost) <= len(place[2]) and [o for o, _ in lost[1:]] == [o for o, _ in place[2]][-len(lost) + 1 :]


def test_streams_with_any_fault_are_read_without_an_error(pages):
    r = random.Random(3)
    one = b"WARC/1.0\r\nPage-Id: 5\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(one * 40)
    assert [x[1:4] for x in warc._rows(0, data)] == [(i * len(one), len(one), 5) for i in range(40)]
    for _ in range(300):
        bad = bytearray(data if r.random() < 0.5 else one * 40)
        for _ in range(r.randint(1, 3)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        rows = warc._rows(0, bytes(bad))
        assert [x[1] for x in rows] == sorted({x[1] for x in rows})
    # a fault in the trailer alone: all records are sound, and the file is marked
    rows = warc._rows(0, data[:-8] + b"\0" * 8)
    assert [x[-1] for x in rows] == [False] * 40 + [True] and rows[-1][1] == 40 * len(one)
    for size in (b"-9", b"9" * 30, b"", b"4"):
        rows = warc._rows(0, one + one.replace(b"Length: 3", b"Length: " + size) + one)
        assert [x[-1] for x in rows] == [False, True, False]
