"""Corpus pipeline: quality classifier, exact deduplication, near-deduplication, packing. Part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, text_hash, written
from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.near_dedup import near_dedup
from factloom.llm.packing import pack
from factloom.llm.quality import fit, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows whose verdict is to stay. Verdicts name a row by id and text, so rows that share an id, or lack one, are told apart.

    Those that go are fewer than those that stay, so they alone are joined.
    """
    gone = verdicts.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (text_hash(docs["text"]) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return _kept(docs, exact_dedup(docs, hashed=True))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more on five-word shingles) stays."""
    return _kept(docs, near_dedup(docs, num=80, den=100, hashed=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 2048 tokens."""
    return pack(docs, 2048)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

#: The stages use a trained model, sketches and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
