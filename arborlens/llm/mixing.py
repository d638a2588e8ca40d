"""Mixing sources to target weights by temperature, with DataFrame and SQL functions only.

Sources have token shares p. Their weights are p**t, normalised. The exponent t is bisected in [0, 1]: it is the largest
whose weights reach the target entropy (a share of the evenest one, ln of the number of sources), raised as far as the repetition
limit asks: no source may be read more than `max_passes` times for the token budget. Each round is one aggregation over the table of
shares at 31 exponents, which halves the interval five times; four rounds fix t to 1e-6.

A source's weight is realised in blocks: its documents fall into BLOCKS blocks by a hash of their ids. For each pass over
the source the blocks are permuted anew, by a hash of source, pass and block; whole passes take all blocks, the last one takes them in
order while they fit the rest of the source's budget, those that are larger than all of the rest after the others. The budget is thus met from below, to
one block that would fit by itself. `schedule` is
the millionth of the source's budget at which a block begins: ordered by it, sources advance together.

A source with a third of all rows has as many blocks as any other, so no group is gathered: sums are partial aggregations, and the
documents join the plan by source and block.

Cases: a null text has no tokens; a text of any length counts whole, and belongs to one block; a null source is a source of its own; rows without an id are of one block; documents of
a source without tokens come once; repeated rows are rows of their own (of one block); blocks with equal hashes go by number; columns of any names, nested ones too, come through
mixed unchanged; with a budget of 0 only documents without tokens come; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, stored

ENTROPY, MAX_PASSES, BLOCKS, ROUNDS = 0.97, 4.0, 1024, 4


def token_count(text: Column) -> Column:
    """Words of the text; of a null one, none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("\x00"))


def block_of(id_: Column) -> Column:
    """A number below BLOCKS from the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint") % BLOCKS


def exponent(shares: DataFrame, total: int, budget: int, entropy: float = ENTROPY, max_passes: float = MAX_PASSES, rounds: int = ROUNDS) -> float:
    """t for a table of (key, tokens) with positive tokens; 31 rows come to the driver each round."""
    if not total:
        return 1.0
    n = shares.count()
    logs = shares.select(F.log(F.col("tokens") / F.lit(float(total))).alias("lp"))

    def search(meets) -> float:
        """The largest exponent that meets a condition that holds below some point."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            grid = [low + (high - low) * k / 32 for k in range(1, 32)]
            at = logs.select("lp", F.explode(F.array(*[F.lit(t) for t in grid])).alias("t"))
            power = F.exp(F.col("t") * F.col("lp"))
            found = at.groupBy("t").agg(F.sum(power).alias("s"), F.sum(F.col("t") * F.col("lp") * power).alias("a"), F.max(F.exp((F.col("t") - 1) * F.col("lp"))).alias("m"))
            good = [r["t"] for r in found.collect() if meets(r)]
            low = max([low, *good])
            high = min([high, *[t for t in grid if t > low]])
        return low

    target = entropy * math.log(n)
    one = logs.select(F.sum(-F.exp("lp") * F.col("lp")).alias("h")).first()["h"]
    even = 1.0 if one >= target - 1e-9 else search(lambda r: math.log(r["s"]) - r["a"] / r["s"] >= target)
    scale = budget / total
    # reading the rarest source more than max_passes times is avoided by a larger exponent
    limit = search(lambda r: scale * r["m"] / r["s"] > max_passes)
    least = 0.0 if limit == 0.0 and scale / n / _least_share(logs) <= max_passes else limit + 1 / 32**rounds
    return min(1.0, max(even, least))


def _least_share(logs: DataFrame) -> float:
    return math.exp(logs.agg(F.min("lp")).first()[0])


def plan(sizes: DataFrame, entropy: float = ENTROPY, max_passes: float = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """(key, block, pass_no, block_rank, schedule) from (key, block, tokens) of all blocks; one row for each use of a block."""
    shares = sizes.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    total = shares.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = total if budget is None else budget
    t = exponent(shares.where("tokens > 0"), total, budget, entropy, max_passes)
    whole = max(total, 1)
    norm = shares.where("tokens > 0").agg(F.sum(F.exp(F.lit(t) * F.log(F.col("tokens") / F.lit(float(whole)))))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(t) * F.log(F.col("tokens") / F.lit(float(whole)))) / F.lit(norm)).otherwise(0.0)
    wanted = shares.select("key", F.col("tokens").alias("have"), F.floor(F.lit(float(budget)) * weight + 0.5).cast("bigint").alias("want"))
    wanted = wanted.withColumn("passes", F.when(F.col("have") > 0, F.expr("want div have")).otherwise(F.lit(0)))
    uses = sizes.join(wanted, "key").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    large = F.expr("pass_no = passes and tokens > want - passes * have")  # nothing of the last pass can hold it
    order = Window.partitionBy("key", "pass_no").orderBy(large, F.md5(F.concat_ws(":", "key", F.col("pass_no").cast("string"), F.col("block").cast("string")).cast("binary")), "block")
    uses = uses.withColumn("block_rank", F.row_number().over(order).cast("bigint")).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    uses = uses.where(F.expr("pass_no < passes or upto <= want - passes * have"))
    schedule = F.expr("case when want > 0 then (1000000 * (pass_no * have + upto - tokens)) div want else 0 end")
    return uses.select("key", "block", "pass_no", "block_rank", schedule.alias("schedule"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, key, block, tokens) of each row."""
    return docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), block_of(F.col(id_col)).alias("block"), token_count(F.col(text_col)).alias("tokens"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as their source's weight asks; columns as they were, and no more."""
    sizes = stored(sized(docs, id_col, text_col, source_col).groupBy("key", "block").agg(F.sum("tokens").alias("tokens")), "sizes")
    uses = plan(sizes, **options).select(F.col("key").alias("__key"), F.col("block").alias("__block"))
    name = free_name("__row", docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name), source_key(F.col(source_col)).alias("__key"), block_of(F.col(id_col)).alias("__block"))
    return rows.join(uses, ["__key", "__block"]).select(*[F.col(f"{name}.`{c}`").alias(c) for c in docs.columns])


def assignments(table: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """From sized(): a row for each use of a document: id, source, n_tokens, pass_no, block, block_rank, schedule."""
    uses = plan(stored(table.groupBy("key", "block").agg(F.sum("tokens").alias("tokens")), "sizes"), **options)
    out = table.join(uses, ["key", "block"])
    return out.select(F.col("id").alias(id_col), F.nullif("key", F.lit("\x00")).alias("source"), F.col("tokens").alias("n_tokens"), "pass_no", "block", "block_rank", "schedule")


def assignments_sql(docs: str = "documents") -> str:
    """assignments() of a whole table as DuckDB SQL, at the default options."""

    def search(name: str, condition: str) -> str:
        steps, before = [], "SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high"
        for k in range(ROUNDS):
            prior = f"({before})" if k == 0 else f"{name}{k - 1}"
            steps.append(f"""{name}g{k} AS (SELECT b.low, b.high, low + (high - low) * i / 32 AS t FROM {prior} b, range(1, 32) AS r(i)),
{name}a{k} AS (SELECT t, any_value(low) AS low, any_value(high) AS high, sum(exp(t * lp)) AS s, sum(t * lp * exp(t * lp)) AS a, max(exp((t - 1) * lp)) AS m FROM {name}g{k}, logs GROUP BY t),
{name}l{k} AS (SELECT greatest(max(low), coalesce(max(CASE WHEN {condition} THEN t END), 0)) AS low, max(high) AS high FROM {name}a{k}),
{name}{k} AS (SELECT any_value(l.low) AS low, least(any_value(l.high), coalesce(min(CASE WHEN g.t > l.low THEN g.t END), 1)) AS high FROM {name}l{k} l, {name}g{k} g)""")
        return ",\n".join(steps)

    last = ROUNDS - 1
    return f"""
WITH sized AS (SELECT doc_id, coalesce(source, chr(0)) AS key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens,
               ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % {BLOCKS} AS block FROM {docs}),
sizes AS (SELECT key, block, sum(tokens)::BIGINT AS tokens FROM sized GROUP BY ALL),
shares AS (SELECT key, sum(tokens)::BIGINT AS tokens FROM sizes GROUP BY key),
tot AS (SELECT sum(tokens)::BIGINT AS total, count(*) FILTER (tokens > 0) AS n FROM shares),
logs AS (SELECT ln(tokens / total::DOUBLE) AS lp FROM shares, tot WHERE tokens > 0),
{search("e", f"ln(s) - a / s >= {ENTROPY} * ln((SELECT n FROM tot))")},
{search("r", f"m / s > {MAX_PASSES}")},
ex AS (SELECT least(1.0, greatest(
    CASE WHEN (SELECT sum(-exp(lp) * lp) FROM logs) >= {ENTROPY} * ln(n) - 1e-9 THEN 1.0 ELSE (SELECT low FROM e{last}) END,
    CASE WHEN (SELECT low FROM r{last}) = 0 AND 1.0 / n / (SELECT exp(min(lp)) FROM logs) <= {MAX_PASSES} THEN 0.0 ELSE (SELECT low FROM r{last}) + 1.0 / {32**ROUNDS} END)) AS t FROM tot),
norm AS (SELECT sum(exp(t * lp)) AS z FROM logs, ex),
want AS (SELECT key, tokens AS have, CASE WHEN tokens > 0 THEN floor(total::DOUBLE * (exp(t * ln(tokens / total::DOUBLE)) / z) + 0.5)::BIGINT ELSE 0 END AS want FROM shares, tot, ex, norm),
pas AS (SELECT *, CASE WHEN have > 0 THEN want // have ELSE 0 END AS passes FROM want),
uses AS (SELECT s.key, s.block, s.tokens, p.have, p.want, p.passes, unnest(range(0, p.passes + 1)) AS pass_no FROM sizes s JOIN pas p USING (key)),
ranked AS (SELECT *, row_number() OVER w AS block_rank, sum(tokens) OVER w AS upto FROM uses
           WINDOW w AS (PARTITION BY key, pass_no ORDER BY (pass_no = passes AND tokens > want - passes * have), md5(key || ':' || pass_no || ':' || block), block ROWS UNBOUNDED PRECEDING))
SELECT d.doc_id, nullif(d.key, chr(0)) AS source, d.tokens AS n_tokens, r.pass_no, d.block, r.block_rank,
       CASE WHEN r.want > 0 THEN ((1000000 * (r.pass_no * r.have + r.upto - r.tokens)) // r.want)::BIGINT ELSE 0 END AS schedule
FROM sized d JOIN ranked r ON r.key = d.key AND r.block = d.block WHERE r.pass_no < r.passes OR r.upto <= r.want - r.passes * r.have
"""
