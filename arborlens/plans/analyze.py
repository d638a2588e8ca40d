"""The whole analysis: tables of a row a file, label, edge or language, and one nested row a repository.

Contents are read once: a lean table of facts is stored, and all else comes from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..operators import facts, graph, imports, infer, manifests, metrics

#: Columns of the result, in their order.
RESULT = (
    "project_type string, total_loc bigint, languages map<string,bigint>, frameworks array<string>, databases array<string>, infrastructure array<string>, "
    "architecture string, dead_code array<string>, dependency_graph map<string,array<string>>, file_breakdown array<struct<file:string,loc:bigint,language:string>>"
)


def tables(files: DataFrame, listing: DataFrame | None = None) -> dict[str, DataFrame]:
    """The analysis as tables, for repositories of any size: facts, files (repo_id, file, loc, language), languages, totals, labels (repo_id, kind, label), edges
    (repo_id, src, dst, ord) and dead (repo_id, path). listing: all paths that imports may lead to."""
    known = stored(facts.facts(files), "facts")
    listing = known.select("repo_id", "path") if listing is None else listing
    lines = metrics.file_lines(known)
    links = stored(imports.edges(known, listing), "edges")
    return {
        "facts": known, "files": metrics.breakdown(lines), "languages": metrics.language_loc(lines), "totals": metrics.total_loc(lines),
        "labels": manifests.all_labels(known), "edges": links, "dead": graph.dead_files(known, links),
    }


def analyze(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(repo_id, then RESULT) from files (repo_id, path, name, ext, content): tables() nested into one row a repository, as the JSON result wants it.
    A row holds all paths of its repository, so one of tens of millions of files is for tables()."""
    t = tables(files, listing)
    shown = F.concat(F.lit("./"), "path")

    def nested(df: DataFrame, name: str, order, value) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
        return df.groupBy("repo_id").agg(F.transform(rows, lambda x: x["v"]).alias(name))

    by_language = nested(t["languages"], "languages", ["language"], F.struct("language", "loc")).withColumn("languages", F.map_from_entries("languages"))
    entry = F.struct("file", "loc", "language")
    parts = nested(t["files"], "file_breakdown", [(-F.col("loc")).alias("k"), F.split("file", "/").alias("p")], entry)
    deps = imports.adjacency(t["facts"].select("repo_id", "path"), t["edges"]).select("repo_id", shown.alias("path"), F.transform("deps", lambda x: F.concat(F.lit("./"), x)).alias("deps"))
    deps = nested(deps, "dependency_graph", ["path"], F.struct("path", "deps")).withColumn("dependency_graph", F.map_from_entries("dependency_graph"))
    gone = nested(t["dead"], "dead_code", [F.split("path", "/").alias("k")], shown)
    out = t["facts"].select("repo_id").distinct()
    for side in (by_language, t["totals"], manifests.label_sets(t["labels"]), parts, deps, gone):
        out = out.join(side, "repo_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("frameworks", "databases", "infrastructure", "dead_code")})
    out = out.withColumns(
        {
            "languages": F.coalesce("languages", F.expr("cast(map() as map<string,bigint>)")), "total_loc": F.coalesce("total_loc", F.lit(0).cast("bigint")),
            "dependency_graph": F.coalesce("dependency_graph", F.expr("cast(map() as map<string,array<string>>)")),
            "file_breakdown": F.coalesce("file_breakdown", F.expr("cast(array() as array<struct<file:string,loc:bigint,language:string>>)")),
        }
    )
    given = infer.flags(F.col("frameworks"), F.col("databases"), F.map_keys("languages"), F.col("infrastructure"))
    out = out.withColumn("project_type", infer.project_type(given)).withColumn("architecture", infer.architecture(given))
    return out.select("repo_id", *_names())


def _names() -> list[str]:
    return ["project_type", "total_loc", "languages", "frameworks", "databases", "infrastructure", "architecture", "dead_code", "dependency_graph", "file_breakdown"]


def empty() -> dict:
    """The result of a repository without files."""
    return {
        "project_type": infer.OTHER_PROJECT, "total_loc": 0, "languages": {}, "frameworks": [], "databases": [], "infrastructure": [],
        "architecture": infer.OTHER_ARCHITECTURE, "dead_code": [], "dependency_graph": {}, "file_breakdown": [],
    }


def to_json(result: DataFrame) -> DataFrame:
    """(repo_id, json): the result as one line of JSON."""
    return result.select("repo_id", F.to_json(F.struct(*_names()), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """The result again from (repo_id, json)."""
    return rows.select("repo_id", F.from_json("json", RESULT).alias("r")).select("repo_id", "r.*")
