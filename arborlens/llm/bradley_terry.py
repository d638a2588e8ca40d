"""Quality classifier: Bradley-Terry pairwise ranking of documents, thresholded by a quantile of the scores.

A document's strength is a linear function of features of its whole text. Preference pairs (a document labelled 1 over one
labelled 0) are fitted by the logistic loss on feature differences, with a ridge penalty, by Newton's method. A
quantile of the strengths of the labelled sample is the threshold: the one with the best balanced accuracy. The score is a
logistic curve through 0.7 at that threshold, so score >= 0.7 is the decision.

The fit uses all labelled rows. With at most SAMPLE rows of each label the driver fits them itself, on at most PAIRS pairs. More are dealt by hashes of
ids into groups of about GROUP rows, the scarcer label's rows into several where it takes that to give each group enough of them; every row of a group is in pairs with the
group's rows of the other label. Tasks sum gradients and curvatures over all pairs, in whole numbers, so that no order of rows matters; the spread of the
features and the threshold come from histograms of all rows. The driver holds sums and histograms, whose size doesn't depend on the rows.

Cases: a null text is an empty one and is scored like any other; texts of any length are counted whole; labels other than 0 and 1, and labels
without a document, are ignored; if an id has several labels the largest counts, and of several texts the one with the smallest counts is learned
from; repeated rows get the same score; rows without an id are scored, not learned from; of thresholds that do equally well the middle one is taken, and ids whose hashes are
equal go by id; other columns don't matter, whatever their names; without rows of both labels nothing is learned and every score is 0.7; empty tables give
empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_stats
from .common import map_batches, stored, text_of

SAMPLE, PAIRS, THRESHOLD = 12_000, 96_000, 0.7
#: Rows of the more frequent label in a group, the least of the other one, and the unit of sums over groups.
GROUP, FEW, UNIT = 4096, 512, 2.0**30
_N = {c: k for k, c in enumerate(text_stats.COUNTS)}
_WIDTH = 14


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios of the counts; labels, languages, sources and ids are no part of them."""
    c = {k: counts[:, i].astype(float) for k, i in _N.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["n_symbols"] / words, c["n_dup_lines"] / (c["n_lines"] + 1), c["n_repeat_words"] / words, c["word_chars"] / words,
            c["n_upper"] / chars, c["n_lower"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_wide"] / chars, c["n_stops"] / words,
            np.log1p(c["n_kinds"]) / np.log1p(words), c["n_wordless"] / words, c["n_lines"] / words,
        ],
        1,
    )


@dataclass
class Model:
    """centre and scale standardise the features; knots bend each into pieces; strength = pieces @ weights."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def pieces(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-1 - z, 0)], 1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.pieces(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        up = np.log(THRESHOLD / (1 - THRESHOLD)) + self.strength(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(up, -30, 30)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Bradley-Terry weights: the least logistic loss on better - worse, row by row."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """A model from rows of features x with labels y in {0, 1}; without both labels, one of equal strengths."""
    k = x.shape[1]
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(k), np.ones(k), np.zeros(3 * k), 0.0)
    good, bad = x[y == 1], x[y == 0]
    # robust spread of the good rows, so that outliers of the bad ones don't flatten the scale
    centre = np.median(good, 0)
    scale = np.maximum(np.percentile(good, 95, 0) - np.percentile(good, 5, 0), 1e-3)
    model = Model(centre, scale, np.zeros(3 * k), 0.0)
    rng = np.random.default_rng(seed)
    n = min(pairs, 8 * max(len(good), len(bad)))
    a = np.resize(rng.permutation(len(good)), n)
    b = rng.permutation(np.resize(rng.permutation(len(bad)), n))
    model.weights = fit_pairs(model.pieces(good)[a], model.pieces(bad)[b])
    s = model.strength(x)
    cuts = np.quantile(s, np.linspace(0, 1, 1001))
    g, h = np.sort(s[y == 1]), np.sort(s[y == 0])
    right = (1 - np.searchsorted(g, cuts, "left") / len(g)) + np.searchsorted(h, cuts, "left") / len(h)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    model.threshold = float(cuts[best[len(best) // 2]])
    return model


def counted(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(id, counts): the counts of each whole text; no shuffle."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = text_stats.counts(text_of(batch.column(1)))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), count, f"id {kind}, counts array<bigint>")


def labelled(labels: DataFrame, label: str, allowed: Column, id_col: str) -> DataFrame:
    """(id, y) of all allowed rows of labels, with y in {0, 1}."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(allowed & F.col("y").isin(0, 1) & F.col("id").isNotNull())
    return marks.groupBy("id").agg(F.max("y").alias("y"))


def _grouped(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """(g, good, bad): the features of each group's rows as bytes, in an order that depends on nothing but the rows. rows: (id, y, counts); n: rows by label."""
    most = max(n, key=n.get)
    groups = -(-n[most] // GROUP)
    copies = min(groups, -(-groups * FEW // n[1 - most]))
    places = F.when(F.col("y") == most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(copies - 1)))
    dealt = rows.select("id", "y", "counts", F.explode(places).alias("copy"))
    dealt = dealt.select("y", "counts", F.pmod(F.pmod(F.xxhash64("id"), F.lit(groups)) + F.col("copy"), F.lit(groups)).alias("g"))

    def pack(rows: pa.Table) -> pa.Table:
        x = np.array(rows.column("counts").to_pylist(), np.int64)
        y = rows.column("y").to_numpy()
        both = [features(z[np.lexsort(z.T)]).tobytes() for z in (x[y == 1], x[y == 0])]
        return pa.table({"g": rows.column("g").slice(0, 1), "good": pa.array(both[:1], pa.binary()), "bad": pa.array(both[1:], pa.binary())})

    return dealt.groupBy("g").applyInArrow(pack, "g bigint, good binary, bad binary")


def _over_groups(groups: DataFrame, f, key: str) -> list:
    """(key, n) over all groups, n being the sum of what f(g, good, bad) gives as arrays of keys and whole numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, values = [], []
        for g, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k, v = f(g, *(np.frombuffer(z, float).reshape(-1, _WIDTH) for z in both))
            keys.append(k)
            values.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, values)], [key, "n"])

    sums = map_batches(groups, run, f"{key} bigint, n bigint").groupBy(key).agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    return sorted((r[0], int(r[1])) for r in sums.collect())


def _ordered(x: np.ndarray, drop: int) -> np.ndarray:
    """The leading bits of doubles as integers in the order of the numbers: all but the last `drop` bits."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))) >> drop


def _least(keys: np.ndarray, drop: int) -> np.ndarray:
    """The least number with each of the leading bits that _ordered() gives."""
    bits = keys.astype(np.int64) << drop
    return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(float)


def fit_groups(groups: DataFrame, seed: int = 7, ridge: float = 1.0, steps: int = 30) -> Model:
    """fit() over a stored table of _grouped(): features to 1 in 256, thresholds to 1 in 1,024, of all rows."""
    k, room = _WIDTH, 1 << 52

    def spread(g: int, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_ordered(good, 44) + np.arange(k) * np.int64(room), return_counts=True)

    at = np.array(_over_groups(groups, spread, "bin"), np.int64)
    # features are no less than 0, so a bin's number tells its feature
    place, marks = at[:, 0] // room, []
    for j in range(k):
        own = at[place == j]
        run = np.cumsum(own[:, 1])
        marks.append(_least(own[np.searchsorted(run, np.array([0.05, 0.5, 0.95]) * run[-1]), 0] % room, 44))
    low, centre, high = np.array(marks).T
    model = Model(centre, np.maximum(high - low, 1e-3), np.zeros(3 * k), 0.0)

    def sums(g: int, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(good) or not len(bad):
            return np.zeros(0), np.zeros(0)
        rng, n = np.random.default_rng([seed, g]), 8 * max(len(good), len(bad))
        a = np.resize(rng.permutation(len(good)), n)
        d = model.pieces(good)[a] - model.pieces(bad)[rng.permutation(np.resize(rng.permutation(len(bad)), n))]
        p = 1 / (1 + np.exp(np.clip(d @ model.weights, -30, 30)))
        both = np.concatenate([((d * (p * (1 - p))[:, None]).T @ d).ravel(), d.T @ p])
        return np.arange(len(both)), np.rint(both * UNIT)

    m = 3 * k
    for _ in range(steps):
        found = np.array([float(v) for _, v in _over_groups(groups, sums, "place")]) / UNIT
        step = np.linalg.solve(found[: m * m].reshape(m, m) + ridge * np.eye(m), found[m * m :] - ridge * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break

    def strengths(g: int, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([2 * _ordered(model.strength(z), 42) + c for c, z in ((1, good), (0, bad))]), return_counts=True)

    at = np.array(_over_groups(groups, strengths, "bin"), np.int64)
    bins = np.unique(at[:, 0] >> 1)
    count = np.zeros((len(bins), 2))
    count[np.searchsorted(bins, at[:, 0] >> 1), at[:, 0] & 1] = at[:, 1]
    below = np.cumsum(count, 0) - count
    right = below[:, 0] / count[:, 0].sum() + 1 - below[:, 1] / count[:, 1].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    model.threshold = float(_least(bins[best[len(best) // 2]][None], 42)[0])
    return model


def learn(counts: DataFrame, labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on all rows of counts (id, counts) whose id is in labels and allowed (a condition on `id`); only labels' ids and labels are shuffled with the counts.
    With at most `sample` rows of each label the driver fits them."""
    rows = counts.join(labelled(labels, label, allowed, id_col), "id").groupBy("id", "y").agg(F.min("counts").alias("counts"))
    rows = stored(rows.select("id", F.col("y").cast("int").alias("y"), "counts"), "labelled")
    n = {0: 0, 1: 0} | {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if min(n.values()) and max(n.values()) > sample:
        return fit_groups(stored(_grouped(rows, n), "groups"))
    found = rows.select("y", "counts").collect() if min(n.values()) else []  # `sample` rows of each label at most
    x = np.array([r[1] for r in found], np.int64).reshape(-1, len(text_stats.COUNTS))
    y = np.array([r[0] for r in found], int)
    order = np.lexsort((y, *x.T)) if len(x) else np.zeros(0, np.int64)  # rows arrive in any order
    return fit(features(x[order]), y[order])


def learn_from(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """learn() from texts that nobody has counted yet. Of few labels, the ids are broadcast and only their documents counted; else all are, in place."""
    rows, marks = docs.select(id_col, text_col), labelled(labels, label, allowed, id_col)
    if marks.count() <= 2 * sample:
        rows = rows.join(F.broadcast(marks.select(F.col("id").alias(id_col))), id_col, "left_semi")
    return learn(stored(counted(rows, id_col, text_col), "counts"), labels, label, allowed, id_col, sample)


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, score) from whole texts; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = text_stats.counts(text_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(x)))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double")


def score_counts(counts: DataFrame, model: Model) -> DataFrame:
    """(id, score) from (id, counts)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(-1, len(text_stats.COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(x)))], ["id", "score"])

    return map_batches(counts.select("id", "counts"), run, f"id {counts.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more; columns as they were, nothing shuffled."""
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = text_stats.counts(text_of(batch.column(place)))
        return batch.filter(pa.array(model.score(features(x)) >= THRESHOLD))

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
