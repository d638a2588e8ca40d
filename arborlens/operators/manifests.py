"""Frameworks and databases from manifests, infrastructure from paths: rows (repo_id, kind, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text
from ..functions.json_keys import section_keys
from . import facts


#: Frameworks and databases by the manifest whose keys name them.
RULES = {
    "npm": (rules.NPM_FRAMEWORKS, rules.NPM_DATABASES), "pip": (rules.PIP_FRAMEWORKS, rules.PIP_DATABASES), "cargo": (rules.CARGO_FRAMEWORKS, rules.CARGO_DATABASES),
}


def rule_table(df: DataFrame, tables: dict[str, tuple[dict[str, str], dict[str, str]]]) -> DataFrame:
    """(manifest, key, kind, label) of fixed rules, as values within the plan."""
    rows = [(m, k, kind, v) for m, both in tables.items() for kind, table in zip(("framework", "database"), both, strict=True) for k, v in table.items()]
    values = ", ".join(f"({', '.join(map(text.quoted, r))})" for r in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(manifest, key, kind, label)")


def matched_by_manifest(keys: DataFrame, tables: dict[str, tuple[dict[str, str], dict[str, str]]]) -> DataFrame:
    """Equal manifests and keys; the rules are a few dozen rows, so they are broadcast."""
    return keys.join(F.broadcast(rule_table(keys, tables)), ["manifest", "key"]).select("repo_id", "kind", "label")


def matched(keys: DataFrame, frameworks: dict[str, str], databases: dict[str, str]) -> DataFrame:
    """Equal keys."""
    return matched_by_manifest(keys.withColumn("manifest", F.lit("any")), {"any": (frameworks, databases)})


def npm_keys(files: DataFrame) -> DataFrame:
    own = facts.of(files).where("package is not null")
    return own.select("repo_id", F.lit("npm").alias("manifest"), F.explode(section_keys(rules.NPM_SECTIONS)("package")).alias("key"))


def npm_labels(files: DataFrame) -> DataFrame:
    return matched_by_manifest(npm_keys(files), RULES)


def pip_keys(files: DataFrame) -> DataFrame:
    lines = facts.lines(files, F.col("name") == "requirements.txt").where("line <> '' and not startswith(line, '#')")
    return lines.select("repo_id", F.lit("pip").alias("manifest"), text.requirement_name(F.col("line")).alias("key"))


def pip_labels(files: DataFrame) -> DataFrame:
    return matched_by_manifest(pip_keys(files), RULES)


def in_sections(lines: DataFrame, keys: tuple[str, ...], sections: tuple[str, ...], is_header: Column, order: str = "line_no") -> DataFrame:
    """The lines, headers apart, whose last header is one of sections."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("header", F.last_value(F.when(is_header, F.col("line")), F.lit(True)).over(upto))
    return held.where(~is_header & F.col("header").isin(*sections))


def cargo_keys(files: DataFrame) -> DataFrame:
    lines = in_sections(facts.lines(files, F.col("name") == "Cargo.toml"), ("repo_id", "path"), rules.CARGO_SECTIONS, F.col("line").startswith("["))
    return lines.select("repo_id", F.lit("cargo").alias("manifest"), text.cargo_key(F.col("line")).alias("key"))


def cargo_labels(files: DataFrame) -> DataFrame:
    return matched_by_manifest(cargo_keys(files), RULES)


def first_rule(line: Column, table: dict[str, str]) -> Column:
    """The label of the first rule, in the table's order, whose key the line holds; null if none."""
    out = F.lit(None).cast("string")
    for key, label in reversed(table.items()):
        out = F.when(F.contains(line, F.lit(key)), label).otherwise(out)
    return out


def go_labels(files: DataFrame) -> DataFrame:
    out = facts.lines(files, F.col("name") == "go.mod").select("repo_id", F.lit("framework").alias("kind"), first_rule(F.col("line"), rules.GO_FRAMEWORKS).alias("label"))
    return out.where("label is not null")


def infrastructure_flags(path: Column, name: Column) -> Column:
    """The labels of a path below its root, as an array."""
    slashed = F.concat(F.lit("/"), F.translate(path, "\\", "/"))
    yaml = name.endswith(".yaml") | name.endswith(".yml")
    return F.array_compact(
        F.array(
            F.when(name == "Dockerfile", "Docker"),
            F.when(name.isin("docker-compose.yml", "docker-compose.yaml"), "Docker Compose"),
            F.when(name == "Makefile", "Makefile"),
            F.when(F.contains(slashed, F.lit("/.github/workflows/")), "GitHub Actions"),
            F.when((F.contains(slashed, F.lit("/k8s/")) | F.contains(slashed, F.lit("/kubernetes/"))) & yaml, "Kubernetes"),
        )
    )


def infrastructure_labels(files: DataFrame) -> DataFrame:
    return files.select("repo_id", F.lit("infrastructure").alias("kind"), F.explode(infrastructure_flags(F.col("path"), F.col("name"))).alias("label"))


def all_labels(files: DataFrame) -> DataFrame:
    """Distinct labels of all kinds, of files or facts; the keys of all manifests meet the rules in one join."""
    files = facts.of(files)
    keyed = matched_by_manifest(npm_keys(files).unionByName(pip_keys(files)).unionByName(cargo_keys(files)), RULES)
    return keyed.unionByName(go_labels(files)).unionByName(infrastructure_labels(files)).distinct()


def label_sets(labels: DataFrame) -> DataFrame:
    """(repo_id, frameworks, databases, infrastructure), sorted arrays."""
    own = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("label")))).alias(n) for k, n in (("framework", "frameworks"), ("database", "databases"), ("infrastructure", "infrastructure"))]
    return labels.groupBy("repo_id").agg(*own)
