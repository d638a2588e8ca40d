"""Reachability over edge tables, and what it leaves out."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import new_path, stored
from ..functions import text
from ..rules import ENTRY_POINTS

#: Nodes, edges and sources of a group that one task searches; larger groups are searched round by round.
LOCAL = 1_000_000
#: Rounds of one edge, and edges of a later round.
WIDE, STEPS = 6, 8


def reachable(nodes: DataFrame, edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The nodes (keys, node) that paths of edges (keys, src, dst) from the sources reach, sources included; only through nodes.

    Groups of the keys with up to LOCAL rows are searched by one task each, after one shuffle, however long their paths are; so a table of many
    repositories takes one pass. Of a larger group no task holds more than its share: a round takes the frontier STEPS edges further in one job (one edge
    at first, while frontiers are wide), and rounds grow with the longest distance over STEPS. Both end on cycles.
    """
    keys = list(keys)
    group = keys or ["__all"]
    nothing = F.lit(None).cast(nodes.schema["node"].dataType)
    rows = nodes.select(*keys, F.lit(0).alias("kind"), F.col("node").alias("a"), nothing.alias("b"))
    rows = rows.unionByName(edges.select(*keys, F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b"))
    rows = rows.unionByName(sources.select(*keys, F.lit(2).alias("kind"), F.col("node").alias("a"), nothing.alias("b")))
    rows = stored(rows if keys else rows.withColumn("__all", F.lit(0)), "graph")
    large = rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > LOCAL).drop("n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    search = _search(keys), f"{schema}{', ' if keys else ''}node {nodes.schema['node'].dataType.simpleString()}"
    if large.isEmpty():
        return rows.groupBy(*group).applyInArrow(*search)
    large = stored(large, "large")
    out = rows.join(large, group, "left_anti").groupBy(*group).applyInArrow(*search)
    own = rows.join(large, group, "left_semi")
    parts = [own.where(F.col("kind") == k).select(*keys, *names) for k, names in ((0, [F.col("a").alias("node")]), (1, [F.col("a").alias("src"), F.col("b").alias("dst")]), (2, [F.col("a").alias("node")]))]
    return out.unionByName(_by_rounds(*parts, keys))


def _search(keys: list[str]):
    """A search from the sources of one group: rows of nodes (kind 0), edges (1) and sources (2)."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        codes = pa.chunked_array([*rows.column("a").chunks, *rows.column("b").chunks]).combine_chunks().dictionary_encode()
        number = codes.indices.fill_null(-1).to_numpy()
        a, b = number[: len(kind)], number[len(kind) :]
        open_ = np.zeros(len(codes.dictionary) + 1, bool)
        open_[a[kind == 0]] = True
        open_[-1] = False
        src, dst = a[kind == 1], b[kind == 1]
        good = open_[dst]
        src, dst = src[good], dst[good]
        order = np.argsort(src, kind="stable")
        starts = np.searchsorted(src[order], np.arange(len(open_))).tolist()
        after, found = dst[order].tolist(), [x for x in np.unique(a[kind == 2]).tolist() if open_[x]]
        left = open_.tolist()
        for x in found:
            left[x] = False
        for x in found:  # grows
            for y in after[starts[x] : starts[x + 1] if x + 1 < len(starts) else None]:
                if left[y]:
                    left[y] = False
                    found.append(y)
        own = [pa.array([rows.column(k)[0].as_py()] * len(found), rows.schema.field(k).type) for k in keys]
        return pa.table([*own, codes.dictionary.take(pa.array(found, pa.int64()))], [*keys, "node"])

    return run


def _by_rounds(nodes: DataFrame, edges: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """The same for groups of any size; what rounds find is appended to one table in the shared folder."""
    spark = nodes.sparkSession
    nodes = stored(nodes.distinct(), "nodes")
    links = stored(edges.distinct().join(nodes.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi"), "edges")
    frontier = stored(sources.distinct().join(nodes, [*keys, "node"], "left_semi"), "frontier")
    place, rounds = new_path(spark, "reached"), 0
    frontier.write.parquet(place)
    while not frontier.isEmpty():
        seen = spark.read.schema(nodes.schema).parquet(place)
        step, met = frontier, []
        for _ in range(1 if rounds < WIDE else STEPS):
            step = step.withColumnRenamed("node", "src").join(links, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
            step = step.join(seen, [*keys, "node"], "left_anti")
            met.append(step)
        # successors of what the earlier steps met are met too: only the last step's nodes go on
        flagged = [s.withColumn("open", F.lit(k == len(met) - 1)) for k, s in enumerate(met)]
        fresh = stored(reduce(DataFrame.unionByName, flagged).groupBy(*keys, "node").agg(F.max("open").alias("open")), "frontier")
        fresh.drop("open").write.mode("append").parquet(place)
        frontier, rounds = fresh.where("open").drop("open"), rounds + 1
    return spark.read.schema(nodes.schema).parquet(place)


def entry_points(nodes: DataFrame) -> DataFrame:
    """The nodes (repo_id, node) with a name of an entry point."""
    return nodes.where(text.file_name(F.col("node")).isin(*ENTRY_POINTS))


def dead(nodes: DataFrame, edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The nodes that the sources don't reach; all of them without sources."""
    return nodes.select(*keys, "node").distinct().join(reachable(nodes, edges, sources, keys), [*keys, "node"], "left_anti")


def dead_files(files: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, path) of the scanned files that no entry point reaches."""
    nodes = files.select("repo_id", F.col("path").alias("node"))
    return dead(nodes, links, entry_points(nodes), ("repo_id",)).withColumnRenamed("node", "path")
