"""The registered queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import fingerprint

    return fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_rake_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import mixing

    return mixing.weights(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), targets=mixing.TARGETS)


def op3_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import chunked_bpe

    return chunked_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("byte_bpe_50k.json"))


def op4_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import pii

    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_pairwise_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import gam

    return gam.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import prefix_tokens

    return prefix_tokens.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("piece_bpe_32k.model"), 4096)


def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import neardup

    return neardup.assign(table(spark, sf_dir, "documents", "doc_id", "text"), n=3, percent=85, rows=7)


def op8_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import knn

    return knn.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=50, k=5)


def op10_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import langid

    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to callable, in the order of the operators' numbers."""
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express on whole tables."""
    return dict(importlib.import_module("spanloom.llm.sql").ORACLES)
