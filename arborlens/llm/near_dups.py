"""Near duplicates by bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles, as 64-bit hashes; its sketch is the k least. Equal sets are one class
   from here on, so exact copies cost one row.
2. Inverted lists of retained values generate overlaps. Two sets with a Jaccard similarity of 0.8 share, of the k least values
   of their union, fewer than 0.4 k with a chance below 1e-6 at k = 32; so both sketches share c = 0.4 k values at least, and any
   choice of size - c + 1 values from each must meet. Each class lists its rarest such values; what stands in no other
   sketch needs no list. Frequent values are thus listed only by documents that consist of little else.
3. In a list of up to SHORT classes all pairs are compared; in a longer one, dealt out in portions, each class is compared with one
   pivot, the class with the least hash for that value. A pair is a candidate if the union of both sketches estimates a similarity
   of half the threshold or more. Lists hold the upper halves of the sketches' values: equal halves of different values can only add to an estimate.
4. Candidates are verified on full sets; links give connected components. Each class meets its least candidate first, in one shuffle
   of the sets; of the other candidates only those between components that these links leave apart are verified, so a group of near
   copies costs a set a copy, not a set a pair.
5. Long lists that still hold several components are finished exactly. Lists with the same main component are one group, in which
   every class outside that component meets every class whose size allows the similarity, block by block: first sketch against sketch, by the
   rule of step 3, which leaves the classes that have such a partner in another component; then these, full set against full set. Of a pair of
   blocks only links between components that it hasn't linked yet come out. So texts that merely share a frequent value cost a sketch a block,
   and full sets move only where sketches are alike; nothing is dropped or capped.

All hashes rest on a key that is drawn for each call, after the texts are given, so no texts can be made whose different shingles meet; the
results don't depend on it.

Cases: a null text has no set, nor has one without words; they are linked with nothing. With fewer words than a shingle the whole
sequence is one. Texts of any length count whole. Rows with one id are one document and give one row: its set is the union of its
texts' sets (an id with more shingles than a task can hold is like a text too long for one). A row without an id is a document of its own, linked with nothing
and kept. Equal texts are linked, whatever their order. Columns besides the two that are named don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import FEW, connected_components, drop, join_counted, map_batches, return_memory, stored, text_of

SIZE, THRESHOLD, RETAINED, SHARE = 5, 0.8, 32, 0.4
SHORT, PORTION = 16, 512
#: Values of full sets, and sets, in a block of step 5; sketches in a block of it.
BLOCK, ROWS, SKETCHES = 1 << 17, 160, 384
#: Bits of the largest filter that picks documents in place; with more than a fourth of them documents they are joined instead.
BITS = 1 << 25
_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)


def _sets(texts: pa.Array, size: int, key: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, values, bounds) for runs of documents."""
    data, offsets = K.buffers(texts)
    for i, j in K.units(offsets):
        _, _, _, _, h, doc = K.unit_words(data, offsets, i, j, fold=True, key=key)
        yield i, *K.distinct_sets(*K.shingles(h, doc, size), j - i)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int, k: int, key: int) -> DataFrame:
    """(id, n, s1, s2, sketch) of each row: set size, a 128-bit hash of the set, and its k least values. Nothing is shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sums, sketches, lengths = [], [], [], []
        for _, values, bounds in _sets(text_of(batch.column(1)), size, key):
            counts = np.diff(bounds)
            total = np.zeros((len(counts), 2), np.uint64)
            full = np.flatnonzero(counts)
            if len(full):
                for c in range(2):
                    total[full, c] = np.bitwise_xor.reduceat(K.mix(values ^ _OTHER if c else values), bounds[full])
            take = np.minimum(counts, k)
            n.append(counts)
            sums.append(total)
            lengths.append(take)
            sketches.append(values[np.repeat(bounds[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())])
        total, ends = np.concatenate(sums).view(np.int64), np.r_[0, np.cumsum(np.concatenate(lengths))]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sketches).view(np.int64)))
        columns = [batch.column(0), pa.array(np.concatenate(n)), pa.array(np.ascontiguousarray(total[:, 0])), pa.array(np.ascontiguousarray(total[:, 1])), lists]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "s1", "s2", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(_rows(docs, id_col, text_col), run, f"id {kind}, n bigint, s1 bigint, s2 bigint, sketch array<bigint>")


def united(sketches: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, k: int, key: int) -> tuple[DataFrame, DataFrame | None]:
    """(sketches with one row an id, values): the stored table of sketched() with the rows of each id united; values holds (id, rows, u), u being a
    value with its sign bit turned, of the ids whose texts differ, or is None where all ids are different. Rows without an id stay.

    All is counted before it is shuffled by id, so an id with a third of the rows gathers nothing but its k least values.
    """
    named = sketches.where("id is not null")
    if named.count() == named.select("id").distinct().count():
        return sketches, None
    one = named.groupBy("id").agg(F.min(F.struct("s1", "s2", "n", "sketch")).alias("m"), F.max(F.struct("s1", "s2", "n")).alias("x"), F.count("*").alias("rows"))
    one = stored(one.select("id", "rows", "m.*", ((F.col("m.s1") != F.col("x.s1")) | (F.col("m.s2") != F.col("x.s2")) | (F.col("m.n") != F.col("x.n"))).alias("mixed")), "united")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, values, bounds in _sets(text_of(batch.column(1)), size, key):
            found.append(values)
            owner.append(np.repeat(np.arange(i, i + len(bounds) - 1), np.diff(bounds)))
        v, at = np.concatenate(found), pa.array(np.concatenate(owner))
        columns = [pa.array(x.view(np.int64)) for x in (v ^ np.uint64(1 << 63), K.mix(v), K.mix(v ^ _OTHER))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *columns], ["id", "rows", "u", "m1", "m2"])

    kind = docs.schema[id_col].dataType.simpleString()
    mixed = join_counted(_rows(docs, id_col, text_col).where("id is not null"), one.where("mixed").select("id", "rows"), ["id"], "rows")
    values = stored(map_batches(mixed, run, f"id {kind}, rows bigint, u bigint, m1 bigint, m2 bigint").distinct(), "values")
    sums = values.groupBy("id").agg(F.count("*").alias("n"), F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"))
    least = values.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("u"))).where(F.col("r") <= k).groupBy("id").agg(F.sort_array(F.collect_list("u")).alias("us"))
    back = F.transform("us", lambda u: u.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")))
    names = ["id", "n", "s1", "s2", "sketch"]
    out = one.where("not mixed").select(*names).unionByName(sums.join(least, "id").select("id", "n", "s1", "s2", back.alias("sketch")))
    return stored(out.unionByName(sketches.where("id is null").select(*names)), "sketches"), values.select("id", "u")


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The similarity that two sketches give: of the k least values of their union, the share that both hold."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 0.0
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def _halves(sketch: str):
    """The upper 32 bits of a sketch's values, in the same order."""
    return F.transform(sketch, lambda v: F.shiftright(v, 32).cast("int"))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint32)
    at = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _list_candidates(k: int, least: float):
    """Over rows (v, portion, long, pivot, id, sketch) sorted by v and portion, pivots first: candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, kind = None, [], [], None
        for batch in batches:
            kind = batch.schema.field(4).type
            sketches = _lists(batch.column(5))
            vs, portions, longs, _, ids, _ = (batch.column(c).to_pylist() if c < 5 else None for c in range(6))
            for r, now in enumerate(zip(vs, portions, strict=True)):
                if now != key:
                    key, held = now, []
                own = (ids[r], sketches[r].copy())
                for other, sketch in held:
                    if other != own[0] and estimate(sketch, own[1], k) >= least:
                        out.append((min(other, own[0]), max(other, own[0])))
                if not longs[r] or not held:
                    held.append(own)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _block_partners(k: int, least: float):
    """Over the rows (comp, id, stray, sketch) of two blocks: the ids of strays and of others in another component that have sketches alike."""

    def run(rows: pa.Table) -> pa.Table:
        ids, comps = rows.column("id").combine_chunks(), rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        stray = rows.column("stray").combine_chunks().to_numpy(zero_copy_only=False)
        sketches = [x for chunk in rows.column("sketch").chunks for x in _lists(chunk)]
        right = np.flatnonzero(~stray)
        sizes = np.array([len(sketches[r]) for r in right], np.int64)
        values = np.concatenate([sketches[r] for r in right]) if len(right) else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        found = np.zeros(len(stray), bool)
        for x in np.flatnonzero(stray):
            lo, hi = np.searchsorted(values, sketches[x], "left"), np.searchsorted(values, sketches[x], "right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(right))
            # no less than estimate() finds: what both hold may lie beyond the k least of the union
            good = (both >= least * np.minimum(k, len(sketches[x]) + sizes - both) - 1e-9) & (comps[right] != comps[x])
            if good.any():
                found[x] = True
                found[right[good]] = True
        return pa.table([ids.filter(pa.array(found)).unique()], ["id"])

    return run


def _block_links(threshold: float):
    """Over the rows (comp, id, stray, members) of two blocks: links between strays and others, one for each pair of components.

    All intersections of a stray with the other block's sets come from one lookup in that block's sorted values.
    """
    percent = round(threshold * 100)

    def run(rows: pa.Table) -> pa.Table:
        ids, comps = rows.column("id").combine_chunks(), rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        stray = rows.column("stray").combine_chunks().to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for chunk in rows.column("members").chunks for m in chunk]
        right = np.flatnonzero(~stray)
        sizes = np.array([len(sets[r]) for r in right], np.int64)
        values = np.concatenate([sets[r] for r in right]) if len(right) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        out, linked = [], set()
        for x in np.flatnonzero(stray):
            lo, hi = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(right))
            good = 100 * both >= percent * (len(sets[x]) + sizes - both)
            for y in right[good & (comps[right] != comps[x])]:
                pair = (min(comps[x], comps[y]), max(comps[x], comps[y]))
                if pair not in linked:
                    linked.add(pair)
                    out.append((x, y))
        left, other = (ids.take(pa.array([o[k] for o in out], pa.int64())) for k in (0, 1))
        return pa.table([left, other], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; sets: (id, members) with sorted 64-bit values as bytes."""
    percent = round(threshold * 100)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, True))
            good.append(100 * both >= percent * (len(p) + len(q) - both))
        return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, f"a {kind}, b {kind}")


def _picked(rows: DataFrame, ids: DataFrame, f, schema: str) -> DataFrame:
    """map_batches(f) of the rows (id, text) whose id is in ids, and maybe of a few others: by a filter of at most BITS bits that tasks read rows
    through in place; only for more ids by a join, which shuffles the texts. ids: a stored table."""
    count, bits = ids.count(), 1 << 10
    if 4 * count > BITS:
        return map_batches(rows.join(ids, "id", "left_semi"), f, schema)
    while bits < BITS and bits < 16 * count:
        bits *= 2
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    marks = ids.select(place.alias("p")).select(F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("m"))
    marks = marks.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # BITS / 32 rows at most
    words = np.zeros(bits // 32, np.uint32)
    words[marks.column("w").to_numpy()] = marks.column("m").to_numpy().astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        p = batch.column(2).to_numpy()
        some = batch.select([0, 1]).filter(pa.array(shared.value[p >> 5] >> (p & 31).astype(np.uint32) & np.uint32(1) == 1))
        return f(some) if some.num_rows else None

    return map_batches(rows.select("id", "text", place.alias("p")), run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int, key: int, values: DataFrame | None = None) -> DataFrame:
    """(id, members) of the documents in ids, from whole texts. values: those of united()."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        members = []
        for _, found, bounds in _sets(text_of(batch.column(1)), size, key):
            members += [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.binary())], ["id", "members"])

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        members = [(np.array(us.as_py(), np.int64).view(np.uint64) ^ np.uint64(1 << 63)).tobytes() for us in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.binary())], ["id", "members"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, members binary"
    if values is None:
        return _picked(_rows(docs, id_col, text_col), ids, run, schema)
    more = values.join(ids, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("u")).alias("us"))
    plain = ids.join(values.select("id").distinct(), "id", "left_anti")
    same = map_batches(_rows(docs, id_col, text_col).join(plain, "id", "left_semi"), run, schema).groupBy("id").agg(F.min("members").alias("members"))
    return same.unionByName(map_batches(more, packed, schema))


def _meetings(near: DataFrame, what: DataFrame, column: str, cost: Column | None, rows: int) -> GroupedData:
    """Groups of the rows (comp, id, stray, column) of two blocks of a group's band: each block of its strays with each block of all its classes.
    near: a stored table (main, id, comp, stray, n, own, band); what: (id, column). A block has about `rows` rows at most, and BLOCK of the cost, if given."""
    x = F.col("stray") & (F.col("own") == F.col("band"))

    def parts_of(one: Column) -> Column:
        by_rows = F.ceil(F.sum(one) / rows)
        return by_rows if cost is None else F.greatest(F.ceil(F.sum(one * cost) / BLOCK), by_rows)

    blocks = near.groupBy("main", "band").agg(parts_of(x.cast("int")).alias("ps"), parts_of(F.lit(1)).alias("qs"), F.count("*").alias("size"))
    h, zero = F.xxhash64("id"), F.lit(0).cast("bigint")
    placed = join_counted(near, stored(blocks.where("ps > 0"), "blocks"), ["main", "band"], "size").join(what, "id")
    ours = placed.where(x).select("main", "band", F.pmod(h, "ps").alias("p"), F.explode(F.sequence(zero, F.col("qs") - 1)).alias("q"), "id", "comp", "stray", column)
    theirs = placed.select("main", "band", F.explode(F.sequence(zero, F.col("ps") - 1)).alias("p"), F.pmod(h, "qs").alias("q"), "id", "comp", F.lit(False).alias("stray"), column)
    return ours.unionByName(theirs).groupBy("main", "band", "p", "q")


def _star_checks(threshold: float):
    """Over rows (main, portion, centre, id, members) sorted by the first two, centres first: the pairs (a, b) of a centre and a row whose sets reach the threshold."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for main, portion, first, m in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(4), strict=True):
                own = np.frombuffer(m.as_buffer(), np.uint64)
                if first:
                    key, centre = (main, portion), own.copy()
                elif key != (main, portion):
                    raise ValueError(f"no set of {main}")
                both = 0 if first else len(np.intersect1d(centre, own, True))
                good.append(not first and 100 * both >= percent * (len(centre) + len(own) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        return_memory()

    return run


def star_links(
    pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, key: int, values: DataFrame | None, threshold: float
) -> DataFrame:
    """The pairs (a, b), for each b the one with the least a, whose full sets reach the threshold. pairs: a stored table with a < b.

    Sets go to the least ids straight from the texts and aren't stored; an id with many partners has several portions, each with a copy of its set."""
    kind = pairs.schema["a"].dataType.simpleString()
    stars = stored(pairs.groupBy("b").agg(F.min("a").alias("a")), "stars")
    centres = stored(stars.groupBy("a").agg(F.count("*").alias("size")), "centres")
    portions = F.ceil(F.col("size") / PORTION).cast("int")
    own = join_counted(stars, centres, ["a"], "size").select(F.col("b").alias("id"), F.col("a").alias("main"), F.pmod(F.xxhash64("b"), portions).cast("int").alias("portion"), F.lit(False).alias("centre"))
    copies = centres.select(F.col("a").alias("id"), F.col("a").alias("main"), F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"), F.lit(True).alias("centre"))
    places = stored(own.unionByName(copies), "places")
    wanted = stored(places.select("id").distinct(), "wanted")
    sets = full_sets(docs, wanted, id_col, text_col, size, key, values)
    rows = sets.join(F.broadcast(places) if places.count() <= FEW else places, "id").select("main", "portion", "centre", "id", "members")
    rows = rows.repartition("main", "portion").sortWithinPartitions("main", "portion", F.desc("centre"))
    return rows.mapInArrow(_star_checks(threshold), f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, threshold: float = THRESHOLD, k: int = RETAINED
) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id that links reach, its own included) and kept."""
    least, key = SHARE * threshold / 0.8, secrets.randbits(64)
    table, values = united(stored(sketched(docs, id_col, text_col, size, k, key), "sketches"), docs, id_col, text_col, size, k, key)
    kind = table.schema["id"].dataType.simpleString()
    classes = table.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "sketch")).alias("m"), F.count("*").alias("copies"))
    classes = stored(classes.select("s1", "s2", "n", "copies", F.col("m.id").alias("id"), F.col("m.sketch").alias("sketch")), "classes")

    # 2: the rarest values of each class, without those of one sketch only
    postings = classes.select("id", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    frequent = stored(postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "frequent")
    lists = join_counted(postings, frequent, ["v"], "df").groupBy("id").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    need = F.when(F.col("s") < int(threshold * k), F.ceil(F.col("s") * threshold)).otherwise(F.ceil(F.col("s") * least))
    room = F.greatest(F.lit(0), (F.col("s") - need + 1 - (F.col("s") - F.size("vs"))).cast("int"))
    chosen = stored(lists.select("id", F.explode(F.slice("vs", F.lit(1), room)).alias("x")).select("id", "x.v"), "postings")
    sizes = chosen.groupBy("v").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", "v").alias("h"), "id"))["id"].alias("pivot")).where("size > 1")
    listed = stored(join_counted(chosen, stored(sizes, "sizes"), ["v"], "size"), "listed")

    # 3: short lists whole, long ones by portions with their pivot
    members = listed.withColumn("long", F.col("size") > SHORT).withColumn("portions", F.ceil(F.col("size") / PORTION).cast("int"))
    own = F.col("id") == F.col("pivot")
    spread = F.when(~F.col("long"), F.array(F.lit(0))).when(own, F.sequence(F.lit(0), F.col("portions") - 1))
    spread = spread.otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("portions")).cast("int")))
    dealt = members.select("v", F.explode(spread).alias("portion"), "long", own.alias("pivot"), "id")
    sketches = classes.select("id", _halves("sketch").alias("sketch"))
    rows = dealt.join(sketches, "id").select("v", "portion", "long", "pivot", "id", "sketch")
    rows = rows.repartition("v", "portion").sortWithinPartitions("v", "portion", F.desc("pivot"), "id")
    pairs = stored(rows.mapInArrow(_list_candidates(k, least), f"a {kind}, b {kind}").distinct(), "candidates")

    # 4
    links = stored(star_links(pairs, docs, id_col, text_col, size, key, values, threshold), "links")
    parts = connected_components(links)
    ends = [parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part")) for c in ("a", "b")]
    apart = F.coalesce("a_part", "a") != F.coalesce("b_part", "b")
    rest = stored(pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(apart).select("a", "b"), "candidates")
    if not rest.isEmpty():
        wanted = stored(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        sets = stored(full_sets(docs, wanted, id_col, text_col, size, key, values), "sets")
        more = stored(verified(rest, sets, threshold), "links")
        drop(sets)
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = connected_components(links)

    # 5
    long = listed.where(F.col("size") > SHORT).join(parts, "id", "left")
    long = stored(long.select("v", "id", F.coalesce("component", "id").alias("comp")), "long")
    shares = long.groupBy("v", "comp").agg(F.count("*").alias("n"))
    main = shares.groupBy("v").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("size")).where("kinds > 1")
    group = stored(join_counted(long, stored(main, "main"), ["v"], "size").select("main", "id", "comp").distinct(), "unfinished")
    if not group.isEmpty():
        # sets as similar as that lie in one band of sizes, or in two beside each other; a shade wider, for the rounding
        band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(1 / threshold))).cast("int") if threshold < 1 else F.col("n").cast("int")
        group = group.join(classes.select("id", "n"), "id").select("*", (F.col("comp") != F.col("main")).alias("stray"), band.alias("own"))
        near = stored(group.select("*", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("band")), "group")
        found = _meetings(near, sketches, "sketch", None, SKETCHES).applyInArrow(_block_partners(k, least), f"id {kind}")
        partners = stored(found.distinct(), "partners")
        sets = stored(full_sets(docs, partners, id_col, text_col, size, key, values), "sets")
        near = stored(near.join(partners, "id", "left_semi"), "near")
        more = stored(_meetings(near, sets, "members", F.col("n"), ROWS).applyInArrow(_block_links(threshold), f"a {kind}, b {kind}"), "links")
        drop(sets)
        if not more.isEmpty():
            parts = connected_components(links.unionByName(more))

    found = classes.select("s1", "s2", "n", "copies", "id").join(parts, "id", "left")
    found = stored(found.select("s1", "s2", "n", "copies", F.coalesce("component", "id").alias("component")), "found")
    rows = table.drop("sketch")
    out = join_counted(rows.where("n > 0 and id is not null"), found, ["s1", "s2", "n"], "copies").select("id", "n", "component")
    out = out.unionByName(rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that a document with a smaller id stands for; columns as they were. Of rows with one id the one
    whose text has the smallest hash stays; rows without an id all stay."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("__kept_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    own = F.col(f"__row.`{id_col}`")
    found = rows.join(kept, own == F.col("__kept_id"), "left_semi").withColumn("__id", own)
    one = found.groupBy("__id").agg(F.min_by("__row", F.xxhash64(F.col(f"__row.`{text_col}`"))).alias("__row"))
    out = one.select("__row").unionByName(rows.where(own.isNull()))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def slow_components(docs: list[tuple[int, str | None]], size: int, threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """id: (set size, component) by brute force, for tests."""
    import re

    sets = {}
    for i, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        own = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
        sets[i] = sets.get(i, set()) | own
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= round(threshold * 100) * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
