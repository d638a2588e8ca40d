"""Files that use a framework: a line, no comment, that holds one of its patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text


def uses(body: Column, ext: Column, extensions: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    """Whether a text of one of the extensions has such a line; stops at the first."""

    def hit(raw: Column) -> Column:
        line = text.trim(raw)
        any_of = F.contains(line, F.lit(patterns[0]))
        for p in patterns[1:]:
            any_of = any_of | F.contains(line, F.lit(p))
        return ~text.is_usage_comment(line) & any_of

    return ext.isin(*extensions) & F.coalesce(F.exists(text.lines(body), hit), F.lit(False))


def files_using(files: DataFrame, framework: str) -> DataFrame:
    """(repo_id, path) in path order; none for an unknown framework."""
    extensions, patterns = rules.USAGE.get(framework.lower(), ((), ()))
    if not extensions:
        return files.select("repo_id", "path").limit(0)
    own = files.where(F.col("ext").isin(*extensions)).select("repo_id", "path", "ext", text.text_of(F.col("content")).alias("text"))
    return own.where(uses(F.col("text"), F.col("ext"), extensions, patterns)).select("repo_id", "path").orderBy("repo_id", text.order_key(F.col("path")))
