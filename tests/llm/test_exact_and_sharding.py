import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from logsieve.llm import dedup, sharding

BIG = 2**63


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_minimal_perfect_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    sizes, bits = dedup.build_mph(keys)
    assert sorted(dedup.slots(keys, sizes, bits)) == list(range(5000))
    others = np.random.default_rng(2).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    assert dedup.slots(others, sizes, bits).max() < 5000


def test_exact_groups_against_brute_force(documents):
    rows = documents.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    want = sorted((str(r.doc_id), str(min((d for d in groups[normal(r.text)] if d is not None), default=None)), len(groups[normal(r.text)]), hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows)
    got = dedup.exact_groups(documents).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest.hex()) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_drop_repeats_keeps_one_row_of_each_group_and_all_columns(documents):
    out = dedup.drop_repeats(documents)
    assert out.columns == documents.columns
    kept = out.collect()
    assert sorted(normal(r.text) for r in kept) == sorted({normal(r.text) for r in documents.collect()})


def test_members_and_nonmembers_of_the_history(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(3000)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup.exact_groups(docs).collect()}
    assert got == {i: (i % 700, len(range(i % 700, 3000, 700)), i < 700) for i in range(3000)}


def test_empty_tables(empty):
    assert dedup.exact_groups(empty).count() == 0
    assert dedup.drop_repeats(empty).count() == 0
    assert sharding.shard(empty, 8).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection_and_inverts(n):
    to = sharding.permute(np.arange(n), n, 5)
    assert sorted(to) == list(range(n))
    assert (sharding.invert(to, n, 5) == np.arange(n)).all()


def test_shards_are_even_gapless_and_reproducible(documents, spark):
    docs = documents.select("doc_id", "text").union(spark.range(100, 3100).selectExpr("id", "concat('t', id % 5)"))
    got = sharding.shard(docs, 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(docs.repartition(5), 8).collect()
    key = lambda rows: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(got) == key(again)
    want = {(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == want


def test_rows_with_one_key_are_spread_over_all_shards(spark):
    docs = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text")
    assert {r["count"] for r in sharding.shard(docs, 8).groupBy("shard").count().collect()} == {500}


def test_a_repeat_goes_though_no_row_without_an_id_stays(spark):
    rows = [(5, "one  text"), (None, "one text"), (6, "another")]
    out = dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(5, "one  text"), (6, "another")]


def test_ids_beside_nulls_are_whole_and_none_is_a_sentinel(spark):
    big = 2**53 + 5
    rows = [(1, "a"), (None, "a"), (2, "b"), (9, "c"), (None, "c"), (big, "z"), (None, "z"), (big + 2, "c"), (None, "q"), (2**63 - 1, "top"), (None, "top"), (-(2**63), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.digest.hex()): (r.keep_id, r.group_size, r.kept) for r in dedup.exact_groups(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha("a")] == (1, 2, True) and got[None, sha("a")] == (1, 2, False)
    assert got[big, sha("z")] == (big, 2, True) and got[None, sha("q")] == (None, 1, True)
    assert got[2**63 - 1, sha("top")] == (2**63 - 1, 2, True) and got[9, sha("c")] == (-(2**63), 4, False)
    kept = sorted((str(r.doc_id), r.text) for r in dedup.drop_repeats(docs).collect())
    assert kept == sorted([("1", "a"), ("2", "b"), (str(-(2**63)), "c"), (str(big), "z"), ("None", "q"), (str(2**63 - 1), "top")])


def test_a_history_can_be_named_and_names_of_columns_may_clash(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i % 7}", i) for i in range(50)] + [(3, "text 3", 99)], "doc_id long, text string, __id long").withColumns({"__digest": F.lit("x"), "__of": F.lit("y")})
    out = dedup.drop_repeats(docs, F.col("doc_id") < 5)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(7))


def test_a_text_of_very_many_rows_is_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_ROWS", 10)
    docs = spark.range(200).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' ELSE concat('t', id % 50) END AS text")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup.exact_groups(docs).collect()}
    text = lambda i: "" if i % 3 == 0 else f"t{i % 50}"
    groups = defaultdict(list)
    for i in range(200):
        groups[text(i)].append(i)
    assert got == {i: (min(groups[text(i)]), len(groups[text(i)])) for i in range(200)}


def _feistel(index, n, seed):
    """The permutation number by number, as the operator's text describes it."""
    m64 = 2**64 - 1

    def mix(x, key):
        x = ((x ^ key) * 0x9E3779B97F4A7C15) & m64
        x ^= x >> 29
        x = (x * 0xBF58476D1CE4E5B9) & m64
        return x ^ (x >> 32)

    keys = [mix(i, (seed * 0x94D049BB133111EB + 1) & m64) for i in range(1, 7)]
    half = 1
    while 4**half < n:
        half += 1
    mask = (1 << half) - 1
    while True:
        left, right = index >> half, index & mask
        for k in keys:
            left, right = right, left ^ (mix(right, k) & mask)
        index = (left << half) | right
        if index < n:
            return index


@pytest.mark.parametrize("n", [1, 2, 5, 100, 1000])
def test_permutation_against_a_scalar_one(n):
    assert sharding.permute(np.arange(n), n, 17).tolist() == [_feistel(i, n, 17) for i in range(n)]


def test_shards_follow_from_the_row_numbers(spark):
    docs = spark.createDataFrame([(7 * i % 101, "x" * (i % 5)) for i in range(101)], "doc_id long, text string")
    for r in sharding.shard(docs, 8).collect():
        p = _feistel(r.doc_id, 101, 17)
        assert (r.shard, r.slot, r.row_index) == (p % 8, p // 8, r.doc_id)
