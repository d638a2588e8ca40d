"""The import graph: specifiers by regular expression, targets by an ordered join of candidate paths with the listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..rules import JS_EXTENSIONS
from . import facts

#: What comes before a quoted specifier, in the order in which a line is searched.
TRIGGERS = ("from ", "require\\(", "import\\(")


def specifiers(line: Column, triggers: tuple[str, ...] = TRIGGERS) -> Column:
    """Quoted strings after each trigger (white space between), trigger by trigger; calls may overlap."""
    parts = [F.regexp_extract_all(line, F.lit(f"(?s){t}(?=(?U:\\s)*([\"'`])(.*?)\\1)"), F.lit(2)) for t in triggers]
    return F.concat(*parts)


def _joined(directory: Column, rest: Column) -> Column:
    return text.normalize(F.concat(F.when(directory != "", F.concat(directory, F.lit("/"))).otherwise(""), rest))


def js_candidates(path: Column, specifier: Column) -> Column:
    """The path itself, with each extension instead of its own, and the index files below it."""
    base = _joined(text.parent(path), specifier)
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")
    swapped = [F.when(~specifier.rlike(r"(^|/)\.\.$"), F.concat(stem, F.lit(f".{e}"))) for e in JS_EXTENSIONS]
    below = F.when(base != "", F.concat(base, F.lit("/"))).otherwise("")
    return F.array(base, *swapped, *[F.concat(below, F.lit(f"index.{e}")) for e in JS_EXTENSIONS])


def python_candidates(path: Column, line: Column) -> Column:
    """For `from .x import`: one dot is the file's directory, each further one the one above."""
    dots = F.length(F.regexp_extract(line, r"^from (\.+)", 1))
    module = F.regexp_replace(F.regexp_extract(line, r"^from \.+(?U:\s)*(\S*)", 1), r"\.+$", "")
    base = _joined(text.parent(path), F.concat(F.repeat(F.lit("../"), dots - 1), F.translate(module, ".", "/")))
    below = F.when(base != "", F.concat(base, F.lit("/"))).otherwise("")
    return F.when(module == "", F.array(F.concat(below, F.lit("__init__.py")))).otherwise(F.array(F.concat(base, F.lit(".py")), F.concat(below, F.lit("__init__.py"))))


def rust_candidates(path: Column, module: Column) -> Column:
    base = _joined(text.parent(path), module)
    return F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs")))


def import_candidates(files: DataFrame) -> DataFrame:
    """(repo_id, src, ord, candidates) of each import statement of files or facts; ord orders the statements of a file."""
    own, ext = facts.of(files), F.col("ext")
    js = facts.lines(own, ext.isin(*JS_EXTENSIONS)).where(~text.is_slash_comment(F.col("line")))
    js = js.select("repo_id", "path", "line_no", F.posexplode(specifiers(F.col("line"))).alias("pos", "spec")).where(text.is_relative(F.col("spec")))
    js = js.select("repo_id", F.col("path").alias("src"), F.struct("line_no", "pos").alias("ord"), js_candidates(F.col("path"), F.col("spec")).alias("candidates"))
    zero = F.struct("line_no", F.lit(0).alias("pos")).alias("ord")
    py = facts.lines(own, ext == "py").where(F.col("line").startswith("from ."))
    py = py.select("repo_id", F.col("path").alias("src"), zero, python_candidates(F.col("path"), F.col("line")).alias("candidates"))
    rs = facts.lines(own, ext == "rs").where(~text.is_slash_comment(F.col("line"))).withColumn("module", F.regexp_extract("line", r"^(?:pub)*(?U:\s)*mod (.*?);+$", 1)).where("module <> ''")
    rs = rs.select("repo_id", F.col("path").alias("src"), zero, rust_candidates(F.col("path"), text.trim(F.col("module"))).alias("candidates"))
    return js.unionByName(py).unionByName(rs)


def resolved(statements: DataFrame, listing: DataFrame) -> DataFrame:
    """(repo_id, src, dst, ord): the first candidate that exists, each target once a file at its first place."""
    tried = statements.select("repo_id", "src", "ord", F.posexplode("candidates").alias("prio", "dst")).where("dst is not null")
    found = tried.join(listing.select("repo_id", F.col("path").alias("dst")).distinct(), ["repo_id", "dst"])
    first = found.groupBy("repo_id", "src", "ord").agg(F.min_by("dst", "prio").alias("dst"))
    return first.groupBy("repo_id", "src", "dst").agg(F.min("ord").alias("ord"))


def edges(files: DataFrame, listing: DataFrame) -> DataFrame:
    return resolved(import_candidates(files), listing)


def adjacency(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, path, deps): every node, its targets in order, none as an empty array."""
    own = links.groupBy("repo_id", F.col("src").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("deps"))
    return nodes.join(own, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
