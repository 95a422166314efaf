"""From raw documents to packed training sequences: five stages, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import dedup, mixing, ngram_join, packing, quality
from logsieve.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents below this quality score go.
QUALITY = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null texts are judged as empty ones. Without labels of good documents all stay."""
    model, _ = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, QUALITY).where("predicted = 1").select(*COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id (rows without one come last); null texts count as empty."""
    return dedup.drop_repeats(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links between sets of five-word shingles with a Jaccard of 0.8 or more; texts without words stay."""
    return ngram_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have tempered weights, shuffled; a document may come several times, and a null source is one of its own."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets; an empty or null text is one piece. Rows that repeat are packed each."""
    pieces = packing.token_pieces(docs)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("n-gram jaccard join", drop_near),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenizing and model scores are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents of ``sf_dir``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{i}")
    return docs
