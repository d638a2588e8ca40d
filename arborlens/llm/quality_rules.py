"""Quality rules with adaptive thresholds, from mergeable quantile sketches for each language and source.

Fixed cutoffs are replaced by fences around the bulk of each (language, source) group: a document is out where a
measure lies beyond its group's quartiles by more than `reach` times the spread. The quantiles come from
log-linear histograms: a value below 64 is its own bucket, a larger one keeps its 6 leading bits (relative error
1/32 at most). Such a sketch is a table of (group, measure, bucket, count), so partial sketches merge by adding
counts, on the map side first: a source with a third of all rows costs no more than any other, the result doesn't
depend on the order of merging, and the sketches of small groups are merged upwards (source, then language, then
all) until they hold `least` documents.

Cases: a null text is an empty one; a document of no words fails the base rule; texts of any length are counted whole; null languages and sources are
groups of their own; null ids are kept as they are; repeated rows are judged one by one, each alike; a value on a fence is within it; other columns, whatever their names, come through filter_quality
unchanged and don't matter to assess; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text_stats
from .common import free_name, map_batches, stored, text_of

#: Measure, numerator, denominator and spread floor: 1000 * n_symbols div n_words and so on. The floor keeps a group
#: whose quartiles coincide from rejecting what differs a little.
MEASURES = (
    ("symbols", "1000 * n_symbols", "n_words", 30),
    ("dup_lines", "1000 * n_dup_lines", "n_lines + 1", 120),
    ("repeats", "1000 * n_repeat_words", "n_words", 100),
    ("word_length", "100 * word_chars", "n_words", 50),
)
#: Measures with a lower fence too.
TWO_SIDED = ("word_length",)
REACH, LEAST = 3, 200
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counted(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """docs with a struct of counts in the column `out`, which must be free; nothing is shuffled."""
    kind = f"struct<{', '.join(f'{c}: bigint' for c in _COLUMNS)}>"
    at = [text_stats.COUNTS.index(c) for c in _COLUMNS]
    place = docs.columns.index(text_col)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = text_stats.counts(text_of(batch.column(place)))
        struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in at], list(_COLUMNS))
        return pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, out])

    return map_batches(docs, add, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{out}` {kind}"]))


def _measured() -> list[Column]:
    """The measures; null for a text without words."""
    return [F.expr(f"({top}) div nullif({below}, 0)").alias(name) for name, top, below, _ in MEASURES]


def bucket(v: Column) -> Column:
    """The lower end of v's bucket."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(level, groups, measure, bucket, n): histograms of all levels, from all groups (level 0) to none; two groups at most are rolled up from the right."""
    long = measured.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m, *_ in MEASURES])).alias("x"))
    fine = long.groupBy(*groups, "x.measure", "x.bucket").agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    out = fine
    for level in range(1, len(groups) + 1):
        kept = groups[: len(groups) - level]
        rolled = fine.groupBy(*kept, "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
        out = out.unionByName(rolled, allowMissingColumns=True)
    return out


def thresholds(sketch: DataFrame, groups: list[str], reach: int = REACH) -> DataFrame:
    """(level, groups, n_docs, <measure>_low, <measure>_high): the fences of each group at each level."""
    by = ["level", *groups, "measure"]
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    ranked = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(whole))
    q = [F.min(F.when(F.expr(f"upto * 4 >= total * {k}"), F.col("bucket"))).alias(f"q{k}") for k in (1, 3)]
    found = ranked.groupBy(*by).agg(*q, F.max("total").alias("n_docs"))
    spread = "greatest(q3 - q1, " + "case measure " + " ".join(f"when '{m}' then {floor}" for m, _, _, floor in MEASURES) + " end)"
    found = found.withColumn("high", F.expr(f"q3 + {reach} * {spread}")).withColumn("low", F.expr(f"q1 - {reach} * {spread}"))
    sides = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m, *_ in MEASURES for side in ("low", "high")]
    return found.groupBy("level", *groups).agg(F.max("n_docs").alias("n_docs"), *sides)


def judged(measured: DataFrame, fences: DataFrame, groups: list[str], verdict: str, least: int = LEAST) -> DataFrame:
    """measured with the boolean column `verdict`: inside the fences of the smallest enclosing group of `least` documents."""
    out = measured
    names = [c for c in fences.columns if c.endswith(("_low", "_high"))]
    for level in range(len(groups) + 1):
        kept = groups[: len(groups) - level]
        own = fences.where(F.col("level") == level)
        if level < len(groups):
            own = own.where(F.col("n_docs") >= least)
        side = own.select(*[F.col(g).alias(f"__k{k}_{level}") for k, g in enumerate(kept)], F.struct(*names).alias(f"__f{level}"))
        on = [F.col(g).eqNullSafe(F.col(f"__k{k}_{level}")) for k, g in enumerate(kept)]
        if on:
            both = on[0]
            for c in on[1:]:
                both = both & c
            out = out.join(side, both, "left").drop(*[f"__k{k}_{level}" for k in range(len(kept))])
        else:
            out = out.join(F.broadcast(side), F.lit(True), "left")  # one row
    out = out.withColumn("__f", F.coalesce(*[F.col(f"__f{level}") for level in range(len(groups) + 1)]))
    inside = F.lit(True)
    for m, *_ in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"__f.{m}_high"))
        if m in TWO_SIDED:
            inside = inside & (F.col(m) >= F.col(f"__f.{m}_low"))
    return out.withColumn(verdict, F.coalesce(inside, F.lit(False))).drop("__f", *[f"__f{level}" for level in range(len(groups) + 1)])


def filter_quality(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that pass the base rule and lie inside their group's fences; columns as they were.

    The texts are counted once for the sketches and once for the filter; only counts are shuffled.
    """
    c = free_name("rule_counts", docs.columns)
    lean = counted(docs.select(*dict.fromkeys([text_col, *groups])), text_col, c)
    keys = [f"__g{k}" for k in range(len(groups))]
    renamed = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)]
    base = F.expr(BASE_FAILED)
    measured = lean.select(*renamed, f"{c}.*").where(~base).select(*keys, *_measured())
    fences = stored(thresholds(sketches(measured, keys), keys), "fences")  # of known size, so a small one is broadcast
    full = counted(docs, text_col, c)
    rows = full.select(*renamed, F.struct(*[F.col(f"`{x}`") for x in full.columns]).alias("__row"), f"{c}.*").where(~base)
    kept = judged(rows.select(*keys, "__row", *_measured()), fences, keys, "__kept").where("__kept")
    return kept.select(*[F.col(f"__row.`{x}`").alias(x) for x in docs.columns])


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row a document: id, the counts, base_failed, the measures and kept. The counts are stored, so that texts are read once."""
    c = "__counts"
    keys = [f"__g{k}" for k in range(len(groups))]
    lean = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)])
    found = stored(counted(lean, "__text", c).select("__id", *keys, f"{c}.*"), "counts")
    measured = found.withColumn("base_failed", F.expr(BASE_FAILED)).select("*", *_measured())
    fences = stored(thresholds(sketches(measured.where("not base_failed"), keys), keys), "fences")
    out = judged(measured, fences, keys, "__inside")
    return out.select(F.col("__id").alias(id_col), *_COLUMNS, "base_failed", *[m for m, *_ in MEASURES], (F.col("__inside") & ~F.col("base_failed")).alias("kept"))


def assess_sql(docs: str = "documents") -> str:
    """assess() on lang and source as DuckDB SQL."""
    buckets = ", ".join(f"('{m}', {m})" for m, *_ in MEASURES)
    floors = " ".join(f"WHEN '{m}' THEN {floor}" for m, _, _, floor in MEASURES)
    sides = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {e} END) AS {m}_{side}" for m, *_ in MEASURES for side, e in (("low", f"q1 - {REACH} * spread"), ("high", f"q3 + {REACH} * spread")))
    names = ", ".join(f"coalesce(a.{m}_{s}, b.{m}_{s}, c.{m}_{s}) AS {m}_{s}" for m, *_ in MEASURES for s in ("low", "high"))
    inside = " AND ".join([f"{m} <= {m}_high" for m, *_ in MEASURES] + [f"{m} >= {m}_low" for m in TWO_SIDED])
    measures = ", ".join(f"CASE WHEN {below} > 0 THEN ({top}) // ({below}) END AS {m}" for m, top, below, _ in MEASURES)
    return f"""
WITH src AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS text FROM {docs}),
spl AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM src),
grams AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, ws[i], ws[i + 1], ws[i + 2]) AS c
          FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM spl WHERE len(ws) >= 3)),
hits AS (SELECT rn, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY rn),
cnt AS (SELECT s.rn, doc_id, lang, source, len(ws) AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
        length(text) - length(replace(text, chr(10), '')) AS n_lines
        FROM spl s LEFT JOIN hits h ON h.rn = s.rn),
m AS (SELECT *, ({BASE_FAILED}) AS base_failed, {measures} FROM cnt),
x AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket
      FROM m, LATERAL (VALUES {buckets}) AS t(measure, v) WHERE NOT base_failed),
h AS (SELECT 0 AS level, lang, source, measure, bucket, count(*) AS n FROM x GROUP BY ALL
      UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM x GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, measure, bucket, count(*) FROM x GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
      sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM h),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1,
      min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3 FROM r GROUP BY ALL),
sp AS (SELECT *, greatest(q3 - q1, CASE measure {floors} END) AS spread FROM q),
f AS (SELECT level, lang, source, max(total) AS n_docs, {sides} FROM sp GROUP BY level, lang, source),
j AS (SELECT m.*, {names} FROM m
      LEFT JOIN (SELECT * FROM f WHERE level = 0 AND n_docs >= {LEAST}) a ON a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
      LEFT JOIN (SELECT * FROM f WHERE level = 1 AND n_docs >= {LEAST}) b ON b.lang IS NOT DISTINCT FROM m.lang
      LEFT JOIN (SELECT * FROM f WHERE level = 2) c ON TRUE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, FALSE) AS kept FROM j
"""
