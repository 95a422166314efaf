import tracemalloc
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsieve.llm import packing, rans, tokens
from logsieve.llm.common import checkpoint_dir


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


def test_words_give_the_ids_of_whole_texts(tokenizer):
    texts = ["It's I'LL don't  x y a\x1cb İstanbul ΣΑΣ ß Straße ​ é é <|endoftext|> a.b,c!! 12 3a4 ,, . 你好", None, "", " \n ", "a" * 300, "x'scar 'twas", "Ünïcode, wörds. " * 50]
    ids, n = tokens.WordEncoder(tokens.default_path()).encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_a_full_memo_changes_no_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 5)
    enc = tokens.WordEncoder(tokens.default_path())
    for text in ("alpha beta gamma delta epsilon zeta eta", "theta alpha, iota kappa beta"):
        assert enc.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_worker_holds_few_bytes_a_word_and_few_encodings_at_a_time():
    enc = tokens.WordEncoder(tokens.default_path())
    real, most = enc.tokenizer, []

    class Watched:
        def encode_batch_fast(self, strings, **options):
            most.append(sum(len(x.split()) for x in strings))
            return real.encode_batch_fast(strings, **options)

    enc.tokenizer = Watched()
    letters = np.random.default_rng(5).integers(97, 123, (60_000, 9)).astype(np.uint8)
    text = pa.array([b" ".join(x.tobytes() for x in letters).decode()])
    enc.encode(pa.array(["warm up"]))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for _, ids, _ in enc.slices(text):
        n = len(ids)
    del ids
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert max(most) <= 4096 and n > 60_000
    assert kept <= 4 * n + 60 * 60_000
    # words met before are not encoded again
    most.clear()
    again, _ = enc.encode(text)
    assert len(again) == n and not most


def test_words_longer_than_the_memo_takes_and_others_keep_their_places(tokenizer):
    enc = tokens.WordEncoder(tokens.default_path())
    texts = ["alpha " + "q" * 65 + " beta " + "7" * 90 + " z", "beta " + "q" * 65 + "! alpha 7 " + "é" * 64]
    for _ in range(2):
        assert enc.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]


def held(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_best_fit_and_its_bound():
    sizes = np.random.default_rng(3).integers(0, 100, 3000)
    bins, _, fill = packing.best_fit_decreasing(sizes, 100)
    assert np.bincount(bins, sizes).astype(int).tolist() == fill.tolist() and fill.max() <= 100
    assert packing.lower_bound(np.bincount(sizes, minlength=101), 100) <= len(fill)
    assert packing.lower_bound(np.bincount([51] * 7 + [1] * 7, minlength=101), 100) == 7
    assert packing.lower_bound(np.bincount([34] * 10, minlength=101), 100) == 5


def test_packing_is_whole_gapless_and_near_the_bound(spark):
    pieces = spark.range(6000).selectExpr("id AS doc_id", "1 + (id * 7919) % 100 AS length", "id AS note")
    rows = packing.pack(pieces, 100, part_pieces=500).collect()
    assert sorted((r.doc_id, r.length, r.note) for r in rows) == [(i, 1 + (i * 7919) % 100, i) for i in range(6000)]
    sizes = np.array([r.length for r in rows])
    assert held(rows, 100) <= 1.01 * packing.lower_bound(np.bincount(sizes, minlength=101), 100)


def test_certificates_and_columns_of_the_caller(spark):
    pieces = spark.range(3000).selectExpr("id AS uid", "1 + (id * 7919) % 100 AS length", "id AS part", "'x' AS certified")
    out = packing.pack(pieces, 100, part_pieces=500).cache()
    rows = out.collect()
    assert out.columns == ["uid", "length", "part", "sequence_id", "offset", "certified"]
    assert sorted((r.uid, r.part) for r in rows) == [(i, i) for i in range(3000)]
    told = packing.certificate(out, 100)
    assert told["bins"] == held(rows, 100) and told["bound"] <= told["bins"] and told["uncertified"] == sum(not r.certified for r in rows)
    assert packing.certificate(packing.pack(pieces.limit(0), 100), 100) == {"bins": 0, "bound": 0, "uncertified": 0}


def test_a_gap_that_no_exchange_can_close_ends_and_is_told(spark):
    # sizes of 34 and 45: bins hold two at most, which none of the bounds proves for all of them
    pieces = spark.range(2000).selectExpr("34 + id % 12 AS length", "id")
    out = packing.pack(pieces, 100, part_pieces=300)
    rows = out.collect()
    assert held(rows, 100) >= packing.certificate(out, 100)["bound"] and len(rows) == 2000


def test_ids_that_a_double_cannot_hold_stay_exact_beside_nulls(spark):
    big = [2**53 + 1, None, 2**63 - 1, -(2**63), 2**53 + 3]
    docs = spark.createDataFrame([(d, f"some words {i}") for i, d in enumerate(big)], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in packing.pack_documents(docs).collect()) == sorted(map(str, big))
    path = f"{checkpoint_dir(spark)}/rans-big-{uuid.uuid4().hex}"
    rans.write(docs, path)
    assert sorted(str(r.doc_id) for r in rans.read(spark, path).collect()) == sorted(map(str, big))


def test_a_long_document_is_cut_into_pieces_without_loss(spark, tokenizer, monkeypatch):
    text = "alpha beta, gamma! " * 20_000
    rows = packing.pack_documents(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), capacity=100).collect()
    ids = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece))
    assert ids == np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert all(r.length == len(r.ids) // 4 <= 100 for r in rows)
    held(rows, 100)


def test_pieces_and_packing_of_documents(documents, empty, tokenizer):
    rows = packing.pack_documents(documents).collect()
    held(rows, 2048)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == r.piece * 2048 and r.length == len(r.ids) // 4
        got[r.doc_id].append(r)
    text = {r.doc_id: r.text or "" for r in documents.collect() if r.doc_id is not None}
    for d, t in text.items():
        want = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(r.ids for r in got[d]) == want * (2 if d == 8 else 1)
    assert len(got[None]) == 2
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [5] * 1000, list(range(40_000)), np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 49_000)])
def test_segments_round_trip(ids):
    ids = np.array(ids, "<u4")
    seg = rans.Segment(rans.encode_segment([1, None], np.array([len(ids), 0]), ids))
    assert (seg.ids() == ids).all() and seg.doc_ids == [1, None]
    if len(seg.points) > 1:
        assert (seg.block(1) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()


def test_a_spoilt_segment_is_found():
    data = bytearray(rans.encode_segment([1], np.array([5000]), np.arange(5000, dtype="<u4") % 97))
    data[-10] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Segment(bytes(data)).ids()


def test_frequencies_add_up():
    r = np.random.default_rng(0)
    for _ in range(50):
        f = rans.quantize(np.maximum(1, r.pareto(0.5, r.integers(1, 3000)).astype(np.int64)), 16)
        assert f.sum() == 1 << 16 and f.min() >= 1


def test_files_give_documents_back_in_order(spark, documents, empty, tokenizer, monkeypatch):
    path = f"{checkpoint_dir(spark)}/rans-test-{uuid.uuid4().hex}"
    rans.write(documents.repartition(4), path)
    rows = rans.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in documents.collect()), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in rows:
        if r.doc_id is not None:
            want = np.array([*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert zlib.crc32(r.ids) == zlib.crc32(want)
    rans.write(empty, path + "-empty")
    assert rans.read(spark, path + "-empty").count() == 0


def test_blocks_are_far_smaller_than_ids(spark):
    path = f"{checkpoint_dir(spark)}/rans-size-{uuid.uuid4().hex}"
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat sat on the mat and the dog ran off. "), 50).alias("text"))
    rans.write(docs, path)
    s = spark.read.parquet(path).agg(F.sum("tokens").alias("t"), F.sum(F.length("data")).alias("b")).first()
    assert s.b < s.t
