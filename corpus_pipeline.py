"""From raw documents to packed sequences: the stages of a training-data pipeline.

run(spark, sf_dir) applies STAGES in order. Each stage takes all that the one before kept, is written
as Parquet in the cluster's shared folder and read again. All but the last return the columns of
documents.

1. quality: documents that the current policy of the rule ledger rejects go.
2. near_duplicates: of documents that share 80 % of their five-word shingles, one of each group stays.
3. mixing: sources are mixed to their target weights; a document is there as often as it is taken.
4. packing: pieces of the documents' tokens, packed into sequences of at most 2048.

Null or empty texts fail the rules and go. Null sources are a source. Rows that repeat an id, or have
none, are documents of their own in every stage: only a text that has a near duplicate goes. Ties are
broken by id, then by row. Further columns are carried as far as mixing, except by the names it makes
itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import mixing, near_duplicates, packing, quality_rules
from trailmark.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.kept(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("mixing", mix), ("packing", pack)]
#: The join, the tokenizer and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
