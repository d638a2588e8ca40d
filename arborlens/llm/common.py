"""Shared plumbing: reading tables, durable intermediate tables, hash splits and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import drop, new_path, remove, shared_dir, stored

__all__ = [
    "connected_components", "drop", "free_name", "join_counted", "map_batches", "new_path", "place_of", "remainder", "remove", "return_memory", "shared_dir", "stored", "table", "text_of",
]

#: The characters that separate words: space, and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id written as text, modulo by."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, or a variation that no column has (case-insensitively)."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def place_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a file that executors write or read themselves."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def return_memory() -> None:
    """Give what a finished task has freed back to the system: Python workers are kept for later tasks, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow by single batches; f returns a batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out
        return_memory()

    return df.mapInArrow(run, schema)


#: A key is hot if it has more than one in HOT of the rows, so fewer than HOT keys are.
HOT = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The inner join of left with right, which has each key once and, in the column `count`, left's rows of that key.

    Hot keys, fewer than HOT of them whatever the input, are broadcast; the others meet in a shuffle, in which no key has more
    than one in HOT of the rows. Both sides are told apart by the hot keys' hashes, so a key with the hash of a hot one goes
    with it. Both inputs are read more than once, so they should be stored tables.
    """
    rows, key = left.count(), F.xxhash64(*keys)
    hot = [r[0] for r in right.where(F.col(count) * HOT > rows).select(key).distinct().collect()]  # fewer than HOT
    if not hot:
        return left.join(right, keys)
    few = left.where(~key.isin(hot)).join(right.where(~key.isin(hot)), keys)
    return left.where(key.isin(hot)).join(F.broadcast(right.where(key.isin(hot))), keys).unionByName(few)


def text_of(column: pa.Array) -> pa.Array:
    """A text column with nulls as empty texts, with 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


#: Edges up to which joins of connected_components broadcast one side, of 16 bytes a row and twice as many rows at most.
FEW = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of edges (a, b) reaches, by alternating large-star and small-star.

    Edges are replaced by edges to the smallest known neighbour until nothing changes; every step is a partial
    aggregation and an equi-join, so no neighbourhood is ever gathered in one row. Few edges are joined by broadcast; of more, both
    sides of each join are stored tables, whose partitions Spark splits where a node has very many neighbours. Each round is written to the
    shared folder. Empty edges give an empty result; loops and repeated edges don't matter.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, before = stored(pairs, "edges"), None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, many = now, now[0] > FEW
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(stored(low, "lowest") if many else F.broadcast(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges") if many else large
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(stored(least, "lowest") if many else F.broadcast(least), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        pairs = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
    out = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stored(out.unionByName(roots.join(out, "id", "left_anti")), "components")
