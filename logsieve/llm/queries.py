"""One query for each operator, over its whole table with production parameters; SQL holds those that DuckDB can express."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import dedup, merkle, minhash, mining, mixing, ngram_join, packing, quality, rans, sharding, toxicity, warc, whitening
from logsieve.llm.common import checkpoint_dir
from logsieve.llm.folds import held_out

SHARDS = 8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to tempered source weights."""
    return mixing.mix(_documents(spark, sf_dir))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit finds in a stored replica of all pages into which faults were put: records with another first byte of the payload, or of equal length but another date, stated digest or record id in the header, and the last record of each fifth file gone."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = max(1, math.ceil(pages.count() / warc.FILE_PAGES))
    first = warc.render(pages, files)
    original = warc.leaves(first, "html")
    hit = (F.pmod(F.conv(F.substring("key", 9, 4), 16, 10).cast("long"), F.lit(97)) == 3) & (F.octet_length(F.substring("html", 1, 1)) == 1)
    spoilt = F.when(hit, F.concat(F.when(F.substring("html", 1, 1) == "#", "@").otherwise("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    # which part of a record is spoilt; a header's spoilt part is as long as before
    part = F.pmod(F.conv(F.substring("key", 13, 4), 16, 10).cast("long"), F.lit(4))
    head = (
        F.when(hit & (part == 1), F.regexp_replace("head", "WARC-Date: 2024", "WARC-Date: 2025"))
        .when(hit & (part == 2), F.regexp_replace("head", "WARC-Payload-Digest: sha256:.", "WARC-Payload-Digest: sha256:x"))
        .when(hit & (part == 3), F.regexp_replace("head", "<urn:md5:.", "<urn:md5:x"))
        .otherwise(F.col("head"))
    )
    html = F.when(part == 0, spoilt).otherwise(F.col("html"))
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(first.where(~(F.col("last") & (F.col("file") % 5 == 0))).withColumns({"html": html, "head": head}), path)
    return warc.audit(original, warc.leaves(warc.read(spark, path), "payload"), files)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    pieces = packing.token_pieces(_documents(spark, sf_dir))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    found = dedup.exact_groups(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links between sets of four-word shingles with a Jaccard of 0.85 or more."""
    return ngram_join.near_groups(_documents(spark, sf_dir), 4, 85, 100)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``."""
    placed = sharding.shard(_documents(spark, sf_dir), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_index")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness."""
    return merkle.fingerprints(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = _documents(spark, sf_dir)
    model, _ = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, read back."""
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rans.write(_documents(spark, sf_dir), path)
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links between sets of two-word shingles with a Jaccard of 0.8 or more."""
    return minhash.near_groups(_documents(spark, sf_dir), 2, 80, 100)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, after a seventh of the labels moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components, with its exact deviation from the mean."""
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


SQL = {
    "op1_mixing": r"""
WITH src AS (SELECT coalesce(source, '') AS s, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY 1),
rate AS (SELECT s, (1.0 * sum(n) OVER ()) * w / (sum(w) OVER () * n) AS r FROM src),
split AS (SELECT s, greatest(1, ceil(r / 32.0))::INT AS draws, r / greatest(1, ceil(r / 32.0))::INT AS m FROM rate),
terms AS (SELECT s, m, draws, k, CASE WHEN k = 0 THEN exp(-m) ELSE exp(-m + k * ln(m) - lgamma(k + 1)) END AS p FROM split, range(128) t(k)),
cdf AS (SELECT s, draws, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
tab AS (SELECT s, draws, list(c ORDER BY k) AS t FROM cdf GROUP BY s, draws),
row_ AS (SELECT d.*, concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS r, coalesce(source, '') AS s FROM documents d),
draw AS (SELECT row_.*, list_sum([len(list_filter(t, lambda c: c <= ('0x' || substr(md5(concat_ws('|', '11', r, i::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0)) FOR i IN range(1, draws + 1)]) AS n FROM row_ JOIN tab USING (s))
SELECT doc_id, text, lang, source, n_chars, c::INT AS copy_no, md5(concat_ws('|', '11', r, 'copy', c::VARCHAR)) AS mix_key
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS c FROM draw)
""",
    "op2_warc_fixity": r"""
WITH f AS (SELECT greatest(1, ceil(count(*) / 400.0))::BIGINT AS files FROM pages),
p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') AS url, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, md5(concat_ws('|', page_id::VARCHAR, url, md5(html))) AS key FROM p),
r AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % files AS file, (312 + strlen(url) + strlen(coalesce(page_id::VARCHAR, '')) + strlen(strlen(html)::VARCHAR) + strlen(html))::BIGINT AS length FROM k, f),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", lead(key) OVER (PARTITION BY file ORDER BY key) IS NULL AS last FROM r)
SELECT file, "offset", length, page_id, CASE WHEN last AND file % 5 = 0 THEN 'missing' ELSE 'altered' END AS status FROM o
WHERE (last AND file % 5 = 0) OR (('0x' || substr(key, 9, 4))::BIGINT % 97 = 3 AND strlen(substr(html, 1, 1)) = 1)
""",
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""",
    "op7_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, length(text) // 2 AS half, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM o),
t AS (SELECT doc_id, 0 AS k, text AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, next_text FROM e),
leaf AS (SELECT doc_id, k, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(list_transform(string_split(s, chr(10)), lambda p: string_split(p, ' ')),
  lambda w: list_transform(range(0, (len(w) - 1) // 8 + 1), lambda i: md5(array_to_string(list_slice(w, i * 8 + 1, i * 8 + 8), ' '))))) AS tree FROM t),
node AS (SELECT doc_id, k, tree, list_transform(tree, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))) AS sec FROM leaf),
fp AS (SELECT doc_id, k, sha256(array_to_string(sec, '')) AS root, list_distinct(list_transform(flatten(flatten(tree)), lambda l: substr(l, 1, 8))) AS leaves,
  sha256(array_to_string(sec, '')) || ';' || array_to_string(list_transform(range(1, len(tree) + 1), lambda i: substr(sec[i], 1, 8) || '=' || array_to_string(list_transform(tree[i],
    lambda p: substr(md5(array_to_string(p, '')), 1, 8) || ':' || array_to_string(list_transform(p, lambda l: substr(l, 1, 8)), ',')), '/')), '|') AS f FROM node)
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE len(list_intersect(a.leaves, b.leaves)) * 2.0::DOUBLE / (len(a.leaves) + len(b.leaves)) END AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0::DOUBLE ELSE len(list_intersect(a.leaves, c.leaves)) * 2.0::DOUBLE / (len(a.leaves) + len(c.leaves)) END AS near_next
FROM e JOIN fp a ON a.doc_id = e.doc_id AND a.k = 0 JOIN fp b ON b.doc_id = e.doc_id AND b.k = 1 JOIN fp c ON c.doc_id = e.doc_id AND c.k = 2
""",
    "op12_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON v.vec_id <> a.vec_id AND len(v.x) = len(a.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3
""",
}
