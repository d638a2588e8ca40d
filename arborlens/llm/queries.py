"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bradley_terry, chat, class_lm, mixing, near_dups, packing, progressive_jpeg, quality_rules, sstable, toxicity
from .common import remainder, stored, table


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(bradley_terry.counted(table(spark, sf_dir, "documents"), "doc_id", "text"), "counts")
    model = bradley_terry.learn(counts, table(spark, sf_dir, "labels"), "quality", remainder("id", 4) != 2)
    found = bradley_terry.score_counts(counts, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= bradley_terry.THRESHOLD).cast("int").alias("predicted"))


def op2_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_bottom_k_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assignments(stored(mixing.sized(table(spark, sf_dir, "documents")), "sized"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = progressive_jpeg.store_texts(table(spark, sf_dir, "documents"))
    return progressive_jpeg.read_back(stored(media, "media", compression="zstd"))


def op7_finite_state_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", remainder("id", 5) != 0)
    found = toxicity.scored(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = stored(sstable.write_shards(docs, sstable.new_folder(docs)), "manifest")
    return sstable.read_shards(manifest)


def op9_class_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a row's place in its file doesn't depend on how files are split
    chunk = class_lm.chunk_of([F.col("_metadata.file_path")], F.col("_metadata.row_index"), F.col("text"))
    return class_lm.score(docs, remainder("doc_id", 7) != 2, chunk)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.read_back(stored(chat.format_conversations(turns.unionByName(more)), "formatted", compression="zstd"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bradley_terry, op2_adaptive_quality_rules, op3_bottom_k_near_dups, op4_temperature_mixing, op5_vector_packing, op6_progressive_jpeg, op7_finite_state_toxicity,
        op8_sorted_string_tables, op9_class_ngram_scores, op10_chat_format,
    )
}
ORACLES = {"op2_adaptive_quality_rules": quality_rules.assess_sql(), "op4_temperature_mixing": mixing.assignments_sql()}
