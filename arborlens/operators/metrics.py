"""Lines of code: per file, per language, ranked, as shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..rules import LANGUAGES
from .ranks import numbered


def language(ext: Column) -> Column:
    """The language of an extension; null if unknown. A literal map of fixed size: no join."""
    return F.try_element_at(F.expr(f"map({', '.join(text.quoted(x) for kv in LANGUAGES.items() for x in kv)})"), ext)


def file_lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, loc, language) of text files, from files or facts; binary, invalid and unread ones are left out."""
    loc = F.col("loc") if "loc" in files.columns else text.line_count(text.text_of(F.col("content"))).alias("loc")
    out = files.select("repo_id", "path", loc, language(F.col("ext")).alias("language"))
    return out.where("loc is not null")


def language_loc(lines: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Lines by known language; a language of empty files stays, with 0."""
    return lines.where("language is not null").groupBy(*keys, "language").agg(F.sum("loc").cast("bigint").alias("loc"))


def total_loc(lines: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Lines of known languages together, 0 of none; a repository without any has its row."""
    known = F.when(F.col("language").isNotNull(), F.col("loc"))
    return lines.groupBy(*keys).agg(F.coalesce(F.sum(known), F.lit(0)).cast("bigint").alias("total_loc"))


def breakdown(lines: DataFrame) -> DataFrame:
    """(repo_id, file, loc, language), unknown languages as Other."""
    return lines.select("repo_id", F.concat(F.lit("./"), "path").alias("file"), "loc", F.coalesce("language", F.lit("Other")).alias("language"))


def ranked(rows: DataFrame, by: str = "file", keys: tuple[str, ...] = ("repo_id",), most: int | None = None) -> DataFrame:
    """With rank by loc, largest first, ties by path components; only the first `most`, cut before rows are shuffled, if asked for."""
    order = [F.desc("loc"), text.order_key(F.col(by))]
    if not most:
        return numbered(rows, order, "rank", keys)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)


def shares(by_language: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Adds pct (whole numbers), and bar."""
    whole = F.sum("loc").over(Window.partitionBy(*keys))
    out = by_language.withColumn("pct", text.percent(F.col("loc"), whole))
    return out.withColumn("bar", text.bar(F.col("pct")))
