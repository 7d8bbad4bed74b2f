"""A corpus from raw documents to packed training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs:

1. quality rules: documents that the rules or the likelihood ratio reject go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. personal data: every span is replaced by the label of its kind;
4. best-fit packing: pieces of all remaining documents with their sequence and place.

Defined cases, each the operator's own: all columns may be null and other columns may have any
name; repeated rows and ids are rows of their own (the Jaccard join keeps one of equal texts);
an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from scorewatch.llm import jaccard, packing, privacy, quality
from scorewatch.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts fail the base rules and go; a null doc_id has no label; repeated rows are judged alike."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal rows and of near copies one stays, whatever their ids; texts without words all stay."""
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; a null text stays null; copies of a text get the same replacements."""
    return privacy.sanitised(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text is one piece of its end id; repeated rows and ids have pieces of their own."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("personal data", personal_data), ("best-fit packing", packed_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


#: Counting, hashing and packing are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
