"""The corpus pipeline: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. The check tool and ``run`` write a stage's result as Parquet and read it again for the next.

Null and empty texts are scored, kept if their score allows, linked with nothing, have no personal data and no tokens; repeated rows
become one, rows that share an id stay apart if their texts differ; ties go to the least id; very long texts are worked on whole; an
empty table gives an empty result; further columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import chunked_bpe, gam, mixing, neardup, pii
from spanloom.llm.common import remove, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under the threshold (learnt from the labels of documents still there)."""
    return gam.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8 or more."""
    return neardup.keep_one(docs, n=5, percent=80, rows=6)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of their kinds; no document goes."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their cells' calibrated probabilities."""
    return mixing.sampled(docs, targets=mixing.TARGETS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    import public_tokenizers

    return chunked_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out.drop("ids")
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:  # a stage's input goes when its result is written; the last stage's stays for who reads the result
            remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: A trained classifier and MinHash candidates are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None
