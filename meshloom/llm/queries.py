"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .align import align_tokenizers
from .common import load
from .divergence import source_divergence
from .mix import mix_plan
from .neardup import near_duplicates
from .oracle import SQL
from .packing import pack_documents
from .passages import repeated_passages
from .perplexity import quality_scores
from .pii import pii_spans
from .quality import quality_rules
from .secretscan import secret_spans
from .tokens import token_counts
from .topk import exact_top_k
from .urls import url_verdicts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_vocabulary() -> tuple[str, str, str]:
    """Paths and split pattern of the byte-level vocabulary that packing uses."""
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), k=3, percent=85)


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(load(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), *byte_vocabulary())


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents"))


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(load(spark, sf_dir, "documents"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(load(spark, sf_dir, "embeddings"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(load(spark, sf_dir, "documents"), *byte_vocabulary(), tokenizer_path("piece_bpe_32k.model"))


def op12_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(load(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(load(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources,
            op2_near_duplicates,
            op3_pii_spans,
            op4_token_counts,
            op5_quality_rules,
            op6_pack_windows,
            op7_repeated_passages,
            op8_secret_spans,
            op9_perplexity,
            op10_top_k,
            op11_align_tokenizers,
            op12_url_verdicts,
            op13_source_divergence,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
