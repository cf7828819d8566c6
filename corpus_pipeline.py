"""The corpus pipeline: quality filter, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last
return the columns of documents; the last returns each document's place in the packed batches.  Stages
keep or drop rows, never ids: what happens to one row does not depend on others that share its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import documents, stored
from lodestrata.llm.exact_dedup import keep_one
from lodestrata.llm.ngram_jaccard import keep_one_of_similar
from lodestrata.llm.packing import pack, word_lengths
from lodestrata.llm.quality import filter_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels, accepts.

    A null text is scored as an empty one, null and repeated ids are scored row by row, whole texts of
    any length are read; no documents, no rows; columns pass through as they are.
    """
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space.

    The longest original text stays, then the smallest id, null ids last; of rows alike in both, one.
    A null text is an empty one, and all empty ones are a group; no documents, no rows; columns pass
    through as they are.
    """
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (null last), of each group linked by a similarity of 0.8 or
    more of their shingles of five words.

    Texts without words, null ones too, link with nothing and stay; one with fewer words than five is
    one shingle; rows are told apart though ids repeat; no documents, no rows; columns pass through.
    """
    return keep_one_of_similar(docs, size=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot, a row a row of docs.

    A null text has no words and takes one padded place; repeated and null ids are rows of their own;
    a text longer than the budget is a batch of its own; no documents, no rows; other columns go.
    """
    return pack(word_lengths(docs))


STAGES = [("quality", quality), ("dedup", dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: No SQL expresses the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written before the next reads them."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
