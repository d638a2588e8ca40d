"""The per-file operators on streams: they keep no state, so they run on readStream unchanged; sums by language are kept by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import manifests, metrics
from ..sources import repo


def language_loc(files: DataFrame) -> DataFrame:
    """Running lines by language of a stream of (repo_id, path, content); for output mode complete or update."""
    return metrics.language_loc(metrics.file_lines(repo.with_names(files)))


def infrastructure(files: DataFrame) -> DataFrame:
    """Labels of a stream of paths, as they come; append mode."""
    return manifests.infrastructure_labels(repo.with_names(files))


def windowed_loc(files: DataFrame, time_col: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Lines by language and time window; windows close when the watermark passes them."""
    lines = repo.with_names(files).withWatermark(time_col, late)
    own = lines.select(F.window(time_col, width).alias("window"), metrics.language(F.col("ext")).alias("language"), text.line_count(text.text_of(F.col("content"))).alias("loc"))
    return own.where("language is not null and loc is not null").groupBy("window", "language").agg(F.sum("loc").alias("loc"))
