"""Text and path expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import CLONE_ERRORS, GIT_PREFIXES, OTHER_CLONE_ERROR


def text_of(content: Column) -> Column:
    """A file's text; null if it holds a NUL byte or isn't strict UTF-8."""
    return F.when(~F.contains(content, F.lit(b"\x00")), F.try_validate_utf8(content.cast("string")))


def quoted(value: str) -> str:
    """value as a string of SQL: tables of fixed values are one call that way, not one for each value."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (not only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines by line feeds, an empty one after the last included; other control characters don't separate."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Lines with a character that isn't white space; null for a null text."""
    return F.size(F.filter(lines(text), lambda x: x.rlike(r"(?U)\S"))).cast("bigint")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """In small letters; empty for names without one, and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def order_key(path: Column) -> Column:
    """Paths compare component by component."""
    return F.split(path, "/")


def normalize(path: Column) -> Column:
    """Without empty and . components; .. takes the one before it, and stays where there is none."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def parent(path: Column) -> Column:
    """The directory of a path; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def relative_to(path: Column, root: str) -> Column:
    """./ and the rest after the root; the path itself outside of it."""
    root = root.rstrip("/")
    return F.when(path.startswith(f"{root}/"), F.concat(F.lit("./"), F.substr(path, F.lit(len(root) + 2)))).otherwise(path)


def is_relative(specifier: Column) -> Column:
    return specifier.startswith(".")


def is_git_url(c: Column) -> Column:
    return reduce(Column.__or__, [c.startswith(p) for p in GIT_PREFIXES])


def requirement_name(line: Column) -> Column:
    """What stands before the first of = > < ! [ ; in small letters."""
    return F.lower(trim(F.get(F.split(line, r"[=><!\[;]", 2), F.lit(0))))


def cargo_key(line: Column) -> Column:
    """What stands before the first =, without quotes around it."""
    return F.regexp_replace(trim(F.get(F.split(line, "=", 2), F.lit(0))), r'^"+|"+$', "")


def is_slash_comment(trimmed: Column) -> Column:
    """The comment test of the import graph for the languages with slashes."""
    return trimmed.rlike(r"^(//|/\*|\*)")


def is_usage_comment(trimmed: Column) -> Column:
    """The comment test of the usage scan: a hash counts only before a space or alone."""
    return trimmed.rlike(r"^(//|# |/\*|\*)") | (trimmed == "#")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    """A whole number, rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / F.nullif(whole, F.lit(0)))).otherwise(0).cast("bigint")


def bar(pct: Column, width: int = 28) -> Column:
    filled = F.floor(pct * width / 100).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def clone_error(message: Column, url: Column) -> Column:
    """What to tell of a failed clone; the first rule that fits."""

    def said(form: str) -> Column:
        head, _, name = form.rstrip("}").partition("{")
        return F.concat(F.lit(head), {"url": url, "message": message}[name])

    out = said(OTHER_CLONE_ERROR)
    for words, form in reversed(CLONE_ERRORS):
        out = F.when(reduce(Column.__or__, [F.contains(message, F.lit(w)) for w in words]), said(form)).otherwise(out)
    return out


def longest_path(path: Column) -> Column:
    """An aggregate: bytes of the longest path, 4 at least; 20 of no paths."""
    return F.greatest(F.lit(4), F.coalesce(F.max(F.octet_length(path)), F.lit(20))).cast("bigint")
