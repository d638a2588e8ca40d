"""One pass over the contents of files: what all later operators need, as a lean table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..rules import JS_EXTENSIONS

#: Manifests that are read line by line.
LINE_MANIFESTS = ("requirements.txt", "Cargo.toml", "go.mod")


def _wanted() -> Column:
    """The lines of `text`, with their numbers, that an import or a manifest could be in; the others are not kept."""

    def listed(values) -> str:
        return ", ".join(map(text.quoted, values))

    numbered = "transform(split(text, '\\n', -1), (x, k) -> struct(k AS line_no, x AS line))"
    kept = f"""
        CASE WHEN name IN ({listed(LINE_MANIFESTS)}) THEN {numbered}
             WHEN ext IN ({listed(JS_EXTENSIONS)}) THEN filter({numbered}, x -> contains(x.line, 'from ') OR contains(x.line, 'require(') OR contains(x.line, 'import('))
             WHEN ext = 'py' THEN filter({numbered}, x -> contains(x.line, 'from .'))
             WHEN ext = 'rs' THEN filter({numbered}, x -> contains(x.line, 'mod ')) END"""
    return F.transform(F.expr(kept), lambda x: F.struct(x["line_no"].alias("line_no"), text.trim(x["line"]).alias("line")))


def facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, ext, loc, package, lines) from files (repo_id, path, name, ext, content): lines of text with something in them, null for
    what is no text; the text of a package.json; numbered lines with imports or of other manifests, trimmed."""
    own = files.select("repo_id", "path", "name", "ext", text.text_of(F.col("content")).alias("text"))
    package = F.when(F.col("name") == "package.json", F.col("text"))
    return own.select("repo_id", "path", "name", "ext", text.line_count(F.col("text")).alias("loc"), package.alias("package"), _wanted().alias("lines"))


def of(files: DataFrame) -> DataFrame:
    """facts(), of files or of a table that has them."""
    return files if "lines" in files.columns else facts(files)


def lines(files: DataFrame, which: Column) -> DataFrame:
    """(repo_id, path, line_no, line) of the kept lines of the files that a condition on name or ext selects."""
    return of(files).where(which).select("repo_id", "path", F.inline("lines"))
