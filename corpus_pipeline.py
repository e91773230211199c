"""The corpus pipeline: quality classifier, near-dedup, PII, mixing, packing, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshloom.llm.common import cut, load
from meshloom.llm.mix import mix_documents
from meshloom.llm.neardup import one_of_each
from meshloom.llm.packing import pack_documents
from meshloom.llm.perplexity import good_documents
from meshloom.llm.pii import sanitised
from meshloom.llm.queries import byte_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's limit allows."""
    return good_documents(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies (five words, similarity 0.8)."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data generalised in text."""
    return sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids."""
    return pack_documents(docs, *byte_vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("pack", pack)]
#: SQL expresses neither the classifier, the tokenizer nor the packing; tests/llm holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
