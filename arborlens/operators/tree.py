"""Directory trees as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ranks import numbered

DEPTH = 6


def tree_lines(entries: DataFrame, max_depth: int = DEPTH) -> DataFrame:
    """(repo_id, line_no, line) from (repo_id, path, is_dir) with all directories listed: directories first, then names in small letters.

    A directory at the depth limit has one line with an ellipsis below it, even if it is empty. An entry meets its ancestors,
    at most max_depth of them, in one join.
    """
    parts = F.split("path", "/")
    flat = entries.select("repo_id", "path", "is_dir", text.file_name(F.col("path")).alias("name"), text.parent(F.col("path")).alias("parent"), F.size(parts).alias("depth"))
    flat = flat.where(F.col("depth") <= max_depth)
    order = [F.desc("is_dir"), F.lower("name"), F.col("name")]
    flat = flat.withColumn("last", F.lead("name").over(Window.partitionBy("repo_id", "parent").orderBy(*order)).isNull())
    part = F.struct((~F.col("is_dir")).alias("f"), F.lower("name").alias("l"), F.col("name").alias("n"))
    steps = flat.select("repo_id", F.col("path").alias("at"), "last", part.alias("key"), F.col("depth").alias("level"))
    above = flat.select("repo_id", "path", "name", "is_dir", "depth", F.explode(F.transform(F.sequence(F.lit(1), "depth"), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("at"))
    whole = above.join(steps, ["repo_id", "at"]).groupBy("repo_id", "path", "name", "is_dir", "depth").agg(F.array_sort(F.collect_list(F.struct("level", "last", "key"))).alias("chain"))
    bars = F.transform(F.col("chain"), lambda x: F.when(x["last"], "    ").otherwise("│   "))
    whole = whole.withColumn("key", F.transform("chain", lambda x: x["key"])).withColumn("below", F.array_join(bars, ""))
    prefix = F.array_join(F.slice(bars, 1, F.col("depth") - 1), "")
    mark = F.when(F.element_at("chain", -1)["last"], "└── ").otherwise("├── ")
    named = whole.select("repo_id", "key", F.lit(0).alias("extra"), F.concat(prefix, mark, F.col("name"), F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))
    cut = whole.where(F.col("is_dir") & (F.col("depth") == max_depth)).select("repo_id", "key", F.lit(1).alias("extra"), F.concat("below", F.lit("    …")).alias("line"))
    rows = named.unionByName(cut)
    # an ellipsis follows its directory and comes before what is after it: arrays that begin alike compare by length, then by extra
    return numbered(rows, [F.col("key"), F.col("extra")], "line_no", ("repo_id",)).select("repo_id", "line_no", "line")


def render(label: str, lines: DataFrame, max_depth: int = DEPTH) -> str:
    """The tree of one repository as text, its label first."""
    if max_depth <= 0:
        return f"{label}/\n    …\n"
    rows = lines.orderBy("line_no").select("line").collect()  # the text is the result
    return "".join(f"{x}\n" for x in [f"{label}/", *[r["line"] for r in rows]])
