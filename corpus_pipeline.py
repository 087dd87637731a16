"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on every row and whole text that the one before it kept, and
returns the columns of documents; the last one adds the pieces. Stages are written and read again between, in
the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import line_dedup, minhash_dedup, mixing, sentencepiece, shared, toxicity

#: Shares of tokens by quality label; no document's rate falls under 1, so none is dropped here, and the
#: targets are shares of as many tokens as that takes.
MIX = {1: 0.88, 0: 0.12}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is under 0.5."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat in three documents or more, but for the largest doc_id's; n_chars counted anew."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies."""
    return minhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once, and again as often as its rate asks for."""
    return mixing.mixed(docs, _labels(spark, sf_dir), least=1.0, targets=MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with pieces (ids), n_pieces and round_trip (decoding gives the text)."""
    pieces = sentencepiece.load_pieces(sentencepiece.spark_model_path(spark))
    out = sentencepiece.encode(docs, pieces, check="round_trip")
    return out.withColumn("n_pieces", F.size("pieces").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The classifier, the samples and the search for pieces have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.table(docs, f"pipeline-{name}")
    return docs
