"""A cleaning pipeline over `documents`: quality rules, toxicity, MinHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderspark.llm import near_dedup, packing, quality, queries, toxicity
from tenderspark.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the outlier rule keep."""
    return quality.keep_good(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), queries.fold_of_id(4) != 2)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_first(docs, words=5, similar=(80, 100))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, queries.TOKENIZER)


STAGES = [
    ("quality", quality_rules),
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: SQL expresses none of the fitted stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
