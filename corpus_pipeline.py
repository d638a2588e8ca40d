"""A training-data pipeline over the documents table: rules, classifier, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of documents. Mixing may return a row
several times, or not at all, as its source's weight asks; packing gives one row a piece.

Cases: null and empty texts have too few words for the rules, so they go there; texts of any length pass whole; rows without an id pass all stages (the rules and the
classifier judge texts, and near duplicates leave what has no id); of rows with one id near duplicates keep one; null languages and sources are groups
of their own; further columns of documents, whatever their names, come through all stages but the last; ties are settled as the operators state; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlens.llm import bradley_terry, mixing, near_dups, packing, quality_rules
from arborlens.llm.common import remainder, stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the adaptive thresholds of their language and source."""
    return quality_rules.filter_quality(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of the whole documents table, held-out rows apart:
    among those that the rules kept, hardly any are labelled 0."""
    model = bradley_terry.learn_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", remainder("id", 4) != 2)
    return bradley_terry.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return near_dups.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
