"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

1. ``quality_rules``: documents that the strict quality policy rejects go.
2. ``ngram_jaccard``: of each group of near-duplicates (five-word shingles, similarity 0.8) one stays.
3. ``personal_data``: spans of personal data are masked in the texts.
4. ``source_mix``: every document is repeated or left out so that sources meet their target weights.
5. ``packed_windows``: the mix is encoded and packed into training windows; a row for each piece.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacloom.llm.common import table, written
from vacloom.llm.jaccard import one_of_each
from vacloom.llm.mixing import mixed_documents
from vacloom.llm.packing import packed
from vacloom.llm.pii import redacted
from vacloom.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packed_windows", packed_windows),
]

#: Message passing and the solved packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
