"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import hashlib
import os
import random
import struct
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlens.llm import bradley_terry, chat, class_lm, common, kernels, mixing, near_dups, packing, progressive_jpeg, quality_rules, queries, sstable, text_stats, tokens, toxicity
from arborlens.llm.common import connected_components, remainder, table

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n_words string, score string, block string, held_out string, `__id` string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [None, "", "  \n ", "one", "a b", "A B", "é è\tö ß", "x " * 400, "don't stop. Now!! <|endoftext|>", "\\ </s> [INST] x", LONG, LONG, "汉字 テスト", "a\x0bb\x0cc\x1cd\x85e"]


def table_of(spark, texts, **more):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", 0, "x", "y", "z", "b", "h", "i") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table_of(spark, ODD).unionByName(table_of(spark, ODD).where("doc_id = 4"))


@pytest.fixture(scope="module")
def none(spark):
    return table_of(spark, ["x"]).limit(0)


needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


# -- kernels ---------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAb é\t\n\r#x|\x0b", max_size=60), max_size=8))
def test_counts_match_plain_python(texts):
    found = text_stats.counts(pa.array(texts, pa.large_string()))
    for row, t in zip(found, texts, strict=True):
        want = text_stats.slow_counts(t)
        assert {k: row[text_stats.COUNTS.index(k)] for k in want} == want


def thue_morse(n):
    """A word of n letters and its complement, which collide in every polynomial hash modulo a power of two."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048, 65536])
def test_counts_of_words_alike(n):
    a, b = thue_morse(n)
    text = f"{a}\n{b}\n{a} {b} {a} {a}\n{b} {a} {a} {b}"
    row = text_stats.counts(pa.array([text], pa.large_string()))[0]
    want = text_stats.slow_counts(text)
    assert {k: row[text_stats.COUNTS.index(k)] for k in want} == want and row[text_stats.COUNTS.index("n_kinds")] == 2


def test_words_with_other_ends_have_other_hashes():
    words = sorted({w[:k] for w in ("a" * 90, "ab" * 45, "\0" * 90, "é" * 45) for k in range(1, len(w))})
    h = [kernels.words(np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), key=kernels.FIXED)[2] for w in words]
    assert all(len(x) == 1 for x in h) and len({int(x[0]) for x in h}) == len(words)
    at_end = kernels.words(np.frombuffer(b"zz ab", np.uint8), np.zeros(1, np.int64))[2][1]
    assert at_end == kernels.words(np.frombuffer(b"ab ababab", np.uint8), np.zeros(1, np.int64))[2][0]


def test_counts_of_long_texts(monkeypatch):
    monkeypatch.setattr(kernels, "WINDOW", 1 << 10)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") for _ in range(5000)), "q" * 5000, "", "a b"]
    for row, t in zip(text_stats.counts(pa.array(texts, pa.large_string())), texts, strict=True):
        assert {k: row[text_stats.COUNTS.index(k)] for k in text_stats.slow_counts(t)} == text_stats.slow_counts(t)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_join_of_hot_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    left = spark.createDataFrame([("a", i) for i in range(30)] + [(f"k{i % 7}", 100 + i) for i in range(40)], "k string, x int")
    right = left.groupBy("k").count().where("k <> 'k6'").withColumn("y", F.concat("k", F.lit("!")))
    found = common.join_counted(left, right, ["k"], "count").select("k", "x", "y").collect()
    assert sorted(map(tuple, found)) == sorted((r.k, r.x, r.k + "!") for r in left.collect() if r.k != "k6")


@needs_tables
def test_quality_classifier_on_held_out_rows(spark):
    found = queries.op1_bradley_terry(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").toPandas()
    own = found[found.held_out]
    assert len(own) > 50 and (own.predicted == own.quality).mean() > 0.95
    assert ((found.score >= 0) & (found.score <= 1)).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()


def test_quality_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 0), (3, 1), (3, 0), (5, 1), (7, 0), (99, 1), (5, None), (None, 1)], "doc_id bigint, quality int")
    counts = bradley_terry.counted(odd, "doc_id", "text")
    model = bradley_terry.learn(counts, labels, "quality", F.lit(True))
    rows = bradley_terry.scored(odd, model, "doc_id", "text").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.id == 4}) == 1
    kept = bradley_terry.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score >= 0.7 for r in rows)
    same = bradley_terry.learn_from(odd, labels, "quality", F.lit(True))
    assert np.array_equal(same.weights, model.weights) and same.threshold == model.threshold
    assert bradley_terry.learn_from(none, labels, "quality", F.lit(True)).threshold == 0
    flat = bradley_terry.learn(counts, labels.limit(0), "quality", F.lit(True))
    assert {round(r.score, 6) for r in bradley_terry.scored(odd, flat, "doc_id", "text").collect()} == {0.7}
    assert bradley_terry.scored(none, model, "doc_id", "text").count() == 0 and bradley_terry.learn(bradley_terry.counted(none, "doc_id", "text"), labels, "quality", F.lit(True)).threshold == 0


def test_quality_classifier_of_repeated_rows(spark, monkeypatch):
    """Ids with many different texts take no more than one place in the sample, always the same one."""
    texts = ["A good line of words, it seems. " * k for k in range(2, 30)] + ["#$ %%% 11 && " * k for k in range(2, 30)]
    rows = [(i % 40, t) for i, t in enumerate(texts * 3)]
    labels = spark.createDataFrame([(i, int(i < 28)) for i in range(40)], "doc_id bigint, quality int")
    models = []
    for k in (1, 5):
        counts = bradley_terry.counted(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(k), "doc_id", "text")
        models.append(bradley_terry.learn(counts, labels, "quality", F.lit(True), sample=9))
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold


def test_quality_classifier_learns_from_all_labelled_rows(spark, monkeypatch):
    """More rows than the driver fits: all take part, in any order, and the model is about that of all rows in one place."""
    monkeypatch.setattr(bradley_terry, "GROUP", 60)
    monkeypatch.setattr(bradley_terry, "FEW", 20)
    rng = np.random.default_rng(2)
    x = rng.integers(1, 200, (600, len(text_stats.COUNTS)))
    x[:, 0] += 200
    y = (x[:, 2] + rng.integers(0, 60, 600) < 60).astype(int)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, quality int")
    models = []
    for k in (1, 5):
        rows = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id bigint, counts array<bigint>").repartition(k)
        models.append(bradley_terry.learn(rows, labels, "quality", F.lit(True), sample=9))
        whole = bradley_terry.learn(rows, labels, "quality", F.lit(True))
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold
    good = bradley_terry.features(x)[y == 1]
    assert np.allclose(models[0].centre, np.median(good, 0), rtol=0.03, atol=1e-6)
    right = [((m.score(bradley_terry.features(x)) >= 0.7) == y).mean() for m in (models[0], whole)]
    strengths = [m.strength(bradley_terry.features(x)) for m in (models[0], whole)]
    assert right[0] > right[1] - 0.02 and np.corrcoef(*strengths)[0, 1] > 0.99
    # one more row of another kind changes the model, wherever its hash lies: there is no sample that it could miss
    for i in (600, 601, 602):
        odd = rows.unionByName(spark.createDataFrame([(i, [500] * x.shape[1])], "id bigint, counts array<bigint>"))
        other = bradley_terry.learn(odd, labels.unionByName(spark.createDataFrame([(i, 1)], labels.schema)), "quality", F.lit(True), sample=9)
        assert not np.array_equal(other.weights, models[0].weights)


def test_pairs_recover_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    s = x @ [2.0, -1.0, 0.0]
    up = s[:200] > s[200:]
    w = bradley_terry.fit_pairs(np.where(up[:, None], x[:200], x[200:]), np.where(up[:, None], x[200:], x[:200]))
    assert np.corrcoef(x @ w, s)[0, 1] > 0.98


# -- 2 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("v", [0, 1, 63, 64, 65, 1000, 123_456_789])
def test_buckets(spark, v):
    b = spark.range(1).select(quality_rules.bucket(F.lit(v).cast("bigint"))).first()[0]
    assert b <= v < b + max(1, b // 32 + 1)


def test_quality_rules_odd_rows(spark, odd, none):
    found = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.assess(odd).collect()}
    assert {r[0] for r in found} == set(range(len(ODD))) and (0, 0, True, False) in found
    for doc, n, failed, _ in found:
        own = text_stats.slow_counts(ODD[doc])
        assert n == own["n_words"] and failed == (n < 50 or 100 * own["n_repeat_words"] > 50 * n)
    kept = quality_rules.filter_quality(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in found if r[3]}
    assert quality_rules.assess(none).count() == 0 and quality_rules.filter_quality(none).count() == 0


def test_quality_rules_reject_outliers(spark):
    rng = random.Random(4)
    good = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(3, 7))) for _ in range(80)) for _ in range(300)]
    bad = [" ".join(f"{w}%%%" for w in t.split()) for t in good[:10]]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(good + bad)], "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r.kept for r in quality_rules.assess(df).collect()}
    assert all(found[i] for i in range(300)) and not any(found[i] for i in range(300, 310))


@needs_tables
@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{ROOT}/documents.parquet')")
    df = queries.QUERIES[name](spark, ROOT)
    want = c.sql(f"SELECT {', '.join(sorted(df.columns))} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) == sorted(want, key=repr)


# -- 3 ---------------------------------------------------------------------------------------------------------------


def near_texts():
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(2000)]
    base, out = [rng.choice(voc) for _ in range(60)], []
    for _ in range(90):
        w = base[:]
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(60)] = rng.choice(voc)
        out.append(" ".join(w))
    for _ in range(40):
        b = [rng.choice(voc) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 4)):
            w = b[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(voc)
            out.append(" ".join(w))
    return out + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(100)] + ["", None, "x", "X", " ", "x y"]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size):
    docs = [(i * 7 % 1009, t) for i, t in enumerate(near_texts())]
    found = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=size).collect()
    want = near_dups.slow_components(docs, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    texts = near_texts()
    rng = random.Random(8)
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(i, texts[i]) for i in range(0, 60, 7)] + [(i, rng.choice(texts)) for i in range(0, len(texts), 5)] + [(3, t) for t in texts[90:140]] + [(2, None)]
    docs += [(7, "one two three"), (4, "one two three"), (4, "four five six"), (9, "four five six")]
    a, b = thue_morse(2048)
    docs += [(5000, f"{a} x {b}"), (5001, f"{b} x {a}"), (5002, f"{a} x {b}")]
    rows = spark.createDataFrame([*docs, (None, texts[0]), (None, texts[0]), (None, None)], "doc_id bigint, text string")
    found = near_dups.near_duplicates(rows, size=2).collect()
    named = [r for r in found if r.doc_id is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in named} == near_dups.slow_components(docs, 2) and len(named) == len({i for i, _ in docs})
    rest = [r for r in found if r.doc_id is None]
    assert len(rest) == 3 and all(r.kept and r.component_id is None for r in rest) and sorted(r.n_shingles for r in rest)[0] == 0


def test_near_duplicates_of_long_lists(spark, monkeypatch):
    """Many texts that share a passage and are linked only here and there: lists beyond SHORT, strays of several sizes, several blocks."""
    monkeypatch.setattr(near_dups, "ROWS", 20)
    monkeypatch.setattr(near_dups, "BLOCK", 2000)
    rng = random.Random(5)
    common, voc, docs = [f"c{i}" for i in range(40)], [f"v{i}" for i in range(3000)], []
    for k in range(60):
        own = common + [rng.choice(voc) for _ in range(rng.choice([4, 9, 14, 25, 60]))]
        for _ in range(rng.randint(1, 4)):
            w = own[:]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(voc)
            docs.append((len(docs), " ".join(w)))
    found = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_dups.slow_components(docs, 2)


def test_full_sets_move_only_where_sketches_are_alike(spark, monkeypatch):
    """Texts that share a frequent phrase, and little else, don't meet by full sets; near copies among them do, whatever component they are in."""
    monkeypatch.setattr(near_dups, "SKETCHES", 16)
    asked, whole = [], near_dups.full_sets
    monkeypatch.setattr(near_dups, "full_sets", lambda docs, ids, *a: asked.append({r.id for r in ids.collect()}) or whole(docs, ids, *a))
    rng = random.Random(5)
    docs = [(i, "so it is " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for i in range(200)]
    docs += [(i + 200, docs[i][1] + " more") for i in range(10)]
    found = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_dups.slow_components(docs, 2)
    assert set().union(*asked) == {*range(10), *range(200, 210)}


def test_near_copies_meet_one_copy_each(spark, monkeypatch):
    """Each copy of a group is verified against one, not against all; only pairs that those links leave apart are verified besides."""
    monkeypatch.setattr(near_dups, "PORTION", 4)
    asked, whole = [], near_dups.verified
    monkeypatch.setattr(near_dups, "verified", lambda pairs, *a: asked.extend(tuple(r) for r in pairs.collect()) or whole(pairs, *a))
    rng = random.Random(11)
    base = [" ".join(f"g{g}w{rng.randrange(10**6)}" for _ in range(60)) for g in range(6)]
    docs = [(100 * g + k, f"{text} end{k}") for g, text in enumerate(base) for k in range(12)]
    # 900 is like 901 and 901 like 902, but 900 is not like 902: the least candidate of 902 isn't linked to it
    w = [f"c{i}" for i in range(60)]
    docs += [(900 + k, " ".join(w[4 * k : 4 * k + 48])) for k in range(3)]
    found = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_dups.slow_components(docs, 2)
    assert not [p for p in asked if p[0] < 900]


@pytest.mark.parametrize("bits", [1 << 25, 8])
def test_documents_are_picked_in_place_or_by_a_join(spark, monkeypatch, bits):
    monkeypatch.setattr(near_dups, "BITS", bits)
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("text"))
    ids = spark.range(5000).where("id % 9 = 0").union(spark.range(-3, 0))
    got = {r.id for r in near_dups._picked(rows, ids, lambda batch: batch.select([0]), "id bigint").collect()}
    assert {*range(0, 5000, 9)} <= got and len(got) < 1000 and near_dups._picked(rows, ids.limit(0), lambda batch: batch.select([0]), "id bigint").count() == 0


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 0)
    test_components(spark)


def test_near_duplicates_odd_rows(spark, odd, none):
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(odd, size=2).collect()}
    assert found[5] == 4 and found[11] == 10 and found[0] == 0 and found[1] == 1 and found[2] == 2
    kept = near_dups.keep_one(odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))))
    assert kept.columns == odd.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, i) for i in range(len(ODD)) if i not in (5, 11)]
    assert kept.where("doc_id is null").count() == 1
    assert near_dups.near_duplicates(none).count() == 0 and near_dups.keep_one(none).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rows = [(i, " ".join(["w"] * 50), "big" if i % 20 else f"s{i % 60}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = mixing.sized(df)
    shares = sizes.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    t = mixing.exponent(shares, 300_000, 300_000)
    p = np.array([r.tokens / 300_000 for r in shares.collect()])
    w = p**t / (p**t).sum()
    entropy = -(w * np.log(w)).sum() / np.log(len(p))
    assert 0 < t < 1 and ((w / p).max() <= mixing.MAX_PASSES + 1e-3) and (entropy <= mixing.ENTROPY + 1e-3)
    out = mixing.assignments(sizes).toPandas()
    by = out.groupby("source").n_tokens.sum()
    for k, want in zip([r.key for r in shares.collect()], w * 300_000, strict=True):
        assert by[k] <= want + 1 and by[k] >= want * 0.98 - 600
    assert out.groupby(["doc_id", "pass_no"]).size().max() == 1 and (out.groupby("doc_id").size() > 1).any()
    assert mixing.exponent(shares, 300_000, 300_000, entropy=0.1) >= t


def test_mixing_goes_on_past_a_block_that_is_too_large(spark):
    docs = [(0, "w " * 60_000, "a")] + [(i, "w " * 300, "a") for i in range(1, 51)] + [(i, "w " * 300, "b") for i in range(100, 280)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    found = mixing.mixed(rows, budget=60_000).where("source = 'a'").groupBy().agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).first()
    assert found.first > 0 and found.n > 40


def test_mixing_odd_rows(spark, odd, none):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.where("doc_id = 0").count() >= 1
    assert mixing.assignments(mixing.sized(odd)).count() == out.count()
    assert mixing.mixed(none).count() == 0 and mixing.assignments(mixing.sized(none)).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=80))
def test_pack_respects_all_limits(items):
    d = np.array([(max(a, 0), 1, min(a, b)) for a, b in items], np.int64)
    bins, places = packing.pack(d, np.array([50, 6, 40]) if max(x[2] for x in d.tolist()) <= 40 else np.array([50, 6, 50]))
    limit = np.array([50, 6, 40]) if d[:, 2].max() <= 40 else np.array([50, 6, 50])
    for k in range(3):
        assert (np.bincount(bins, d[:, k]) <= limit[k]).all()
    assert len({*zip(bins.tolist(), places.tolist(), strict=True)}) == len(d) and {*bins.tolist()} == {*range(bins.max() + 1)}


def direct_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_library_s(text):
    assert np.frombuffer(tokens.encoder(tokens.default_path()).encode(text), "<u4").tolist() == direct_ids([text])[0]


_CASES = st.sampled_from(["<|startoftext|>", "<|endoftext|>"]).flatmap(lambda x: st.lists(st.booleans(), min_size=len(x), max_size=len(x)).map(lambda up: "".join(c.upper() if u else c for c, u in zip(x, up, strict=True))))


@settings(max_examples=200, deadline=None)
@given(st.lists(_CASES | st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>"]) | st.text(alphabet="aB É é\u0130\u4e00'1.<|>\n", max_size=8), max_size=6).map("".join))
def test_ids_of_special_strings_in_any_case(text):
    assert np.frombuffer(tokens.encoder(tokens.default_path()).encode(text), "<u4").tolist() == direct_ids([text])[0]


def test_ids_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    monkeypatch.setattr(tokens, "TOGETHER", 50)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Ab.", "straße", "xyz!", "1a", "ÉTÉ", "q" * 60, "İx", "don't", "ΣΑΣ"]) + rng.choice(["", "b", "c,"]) for _ in range(20)) for _ in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(tokens.default_path()).encode_all(texts)] == direct_ids(texts)


def test_words_of_a_large_vocabulary_are_encoded_once(monkeypatch):
    e, asked = tokens.Encoder(tokens.default_path()), []
    monkeypatch.setattr(e, "_word_ids", lambda words: asked.append(len(words)) or [b"" for _ in words])
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(a + b + c + d for c in letters for d in letters) for a in letters for b in letters] * 2
    texts += [t.replace(" ", "x ") for t in texts]
    list(e.encode_all(texts))
    assert sum(asked) < 1.01 * len({w for t in texts for w in t.split()})


def test_packing_odd_rows(spark, odd, none):
    rows = packing.pack_documents(odd, with_ids=True).collect()
    want = [x + [1] for x in direct_ids(ODD)]
    for doc in range(len(ODD)):
        own = sorted({(r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows if r.doc_id == doc})
        ids = [x for r in own for x in np.frombuffer(r[3], "<u4").tolist()]
        assert ids == want[doc] and all(zlib.crc32(r[3]) == r[2] and r[1] == len(r[3]) // 4 for r in own)
        assert {r.doc_tokens for r in rows if r.doc_id == doc} == {len(ids)}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and len(own) <= packing.SEGMENTS
    assert packing.pack_documents(none).count() == 0
    lossy = packing.pack_documents(odd.withColumn("bears", F.col("doc_id") % 2 == 0), loss_col="bears", loss_limit=100, length=512)
    per = lossy.groupBy("sequence_id").agg(F.sum("loss_tokens").alias("l"), F.sum("length").alias("n")).toPandas()
    assert per.n.max() <= 512 and per.l.max() <= 100


# -- 6 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 576, 577, 5000])
def test_jpeg_round_trip_fast_and_slow(n):
    data = progressive_jpeg.padded(random.Random(n).randbytes(n))
    media = progressive_jpeg.encode(data)
    fast, slow = progressive_jpeg.read(media), progressive_jpeg.read(media, fast=False)
    assert progressive_jpeg.payload(fast) == data and media[:2] == b"\xff\xd8" and media[-2:] == b"\xff\xd9"
    assert all((a.blocks == b.blocks).all() for a, b in zip(fast.parts, slow.parts, strict=True))
    rgb = progressive_jpeg.tensor(fast)
    assert rgb.shape == (fast.height, fast.width, 3) and progressive_jpeg.feature(rgb) == progressive_jpeg.feature(progressive_jpeg.tensor(slow))


def test_jpeg_of_many_blocks():
    data = progressive_jpeg.padded(random.Random(1).randbytes(3_500_000))  # runs of more than 32767 blocks
    assert progressive_jpeg.payload(progressive_jpeg.read(progressive_jpeg.encode(data))) == data


def test_jpeg_general_scans():
    """A hand-made file with zero runs, ends of blocks, refinement of new coefficients and restarts, against the coefficients that it stands for."""
    P = progressive_jpeg
    dc = P.Huffman((0, 3) + (0,) * 14, bytes([0, 3, 5]))
    ac = P.Huffman((0, 0, 6) + (0,) * 13, bytes([0x00, 0x01, 0x21, 0x02, 0xF0, 0x10]))
    code_dc, code_ac = ({s: f"{c:0{n}b}" for s, c, n in t.codes()} for t in (dc, ac))

    def stream(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    head = b"\xff\xd8" + P._segment(0xDB, b"\x00" + bytes([2] * 64)) + P._segment(0xC2, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00") + P._table(0, 0, dc) + P._table(1, 0, ac)
    restart = P._segment(0xDD, b"\x00\x01")
    # DC, shifted by 1: 5 in the first block, then after a restart -20 in the second
    first = stream(code_dc[3] + "101") + b"\xff\xd0" + stream(code_dc[5] + "01011")
    low = stream("1") + b"\xff\xd1" + stream("0")
    no_restart = P._segment(0xDD, b"\x00\x00")
    # AC, shifted by 1: block 0: 1 at 1, two zeros, -1 at 4, end; block 1: 16 zeros, 3 at 17, end of block
    bands = stream(code_ac[0x01] + "1" + code_ac[0x21] + "0" + code_ac[0x00] + code_ac[0xF0] + code_ac[0x02] + "11" + code_ac[0x00])
    # refinement: block 0: correct 1 -> 3, new +1 at 2 (no zeros before), then end with a correction of -2 -> -3; block 1: end, correction 0
    fine = stream(code_ac[0x01] + "1" + "1" + code_ac[0x10] + "0" + "1" + "0")
    body = restart + P._scan([(1, 0, 0)], 0, 0, 0, 1) + first + P._scan([(1, 0, 0)], 0, 0, 1, 0) + low + no_restart
    data = head + body + P._scan([(1, 0, 0)], 1, 63, 0, 1) + bands + P._scan([(1, 0, 0)], 1, 63, 1, 0) + fine + b"\xff\xd9"
    image = P.read(data)
    want = np.zeros((2, 64), int)
    want[0, [0, 1, 2, 4]] = [11, 3, 1, -3]
    want[1, [0, 17]] = [-40, 6]
    assert (image.parts[0].blocks == want).all()
    rgb = P.tensor(image)
    k = np.arange(8)
    c = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    natural = np.zeros(64)
    natural[P.ZIGZAG] = 2 * want[0]
    assert np.abs(rgb[:, :8, 0] - np.rint(128 + c.T @ natural.reshape(8, 8) @ c)).max() <= 1
    with pytest.raises(ValueError):
        P.read(b"nothing")


def general_file(rng, blocks, restart):
    """A 4:2:0 file of given coefficients in the scans that common encoders write, coded by the book, symbol after symbol."""
    P = progressive_jpeg
    short = [0x00, 0x01, 0x11, 0xF0, 0x10, 0x02]
    ac = P.Huffman((0, 0, 6, 0, 0, 0, 0, 0, 0, 250) + (0,) * 6, bytes(short + [x for x in range(256) if x not in short]))
    dcs = [P.Huffman((0, 2, 0, 0, 12) + (0,) * 11, bytes([1, 0, *range(2, 14)])), P.Huffman((0, 0, 4, 8) + (0,) * 12, bytes(range(12)))]
    codes = [{s: f"{c:0{n}b}" for s, c, n in t.codes()} for t in (ac, *dcs)]
    rows, cols = 2, 3

    def scan(parts, first, last, high, low, tables, segments):
        packed = [bytes(int(x[i : i + 8], 2) for i in range(0, len(x), 8)).replace(b"\xff", b"\xff\x00") for x in (x + "1" * (-len(x) % 8) for x in segments)]
        data = packed[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + x for k, x in enumerate(packed[1:]))
        return P._scan([(c + 1, *tables[k]) for k, c in enumerate(parts)], first, last, high, low) + data

    def cut(units, per):
        return [units[i : i + restart * per] for i in range(0, len(units), restart * per)] if restart else [units]

    def number(v, size):
        return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    mcus = [(c, k) for m in range(rows * cols) for c, k in [*((0, (m // cols * 2 + y) * 2 * cols + m % cols * 2 + x) for y in (0, 1) for x in (0, 1)), (1, m), (2, m)]]

    def dc_first(units):
        out, last = "", [0, 0, 0]
        for c, k in units:
            step, last[c] = (int(blocks[c][k, 0]) >> 1) - last[c], int(blocks[c][k, 0]) >> 1
            size = abs(step).bit_length()
            out += codes[1 + (c > 0)][size] + number(step, size)
        return out

    def ac_bits(rows_, high, low):
        out, run, held = "", 0, ""

        def flush():
            nonlocal out, run, held
            while run:
                n = min(run.bit_length() - 1, 14)
                take = min(run, (2 << n) - 1)
                out, run = out + codes[0][n << 4] + (f"{take - (1 << n):0{n}b}" if n else ""), run - take
                assert not run
            out, held = out + held, ""

        for row in rows_.tolist():
            mags = [abs(v) >> low for v in row]
            fresh = [k for k, m in enumerate(mags) if (m == 1 if high else m)]
            zeros, fix = 0, ""
            for k, (v, m) in enumerate(zip(row, mags, strict=True)):
                if not m:
                    zeros += 1
                    continue
                while zeros > 15 and fresh and k <= fresh[-1]:
                    flush()
                    out, zeros, fix = out + codes[0][0xF0] + fix, zeros - 16, ""
                if high and m > 1:
                    fix += str(m & 1)
                    continue
                flush()
                size = 1 if high else m.bit_length()
                out += codes[0][zeros << 4 | size] + (str(int(v > 0)) if high else number(m if v > 0 else -m, size)) + fix
                zeros, fix = 0, ""
            if zeros or fix:
                run, held = run + 1, held + fix
        flush()
        return out

    out = b"\xff\xd8" + P._segment(0xDB, b"\x00" + bytes([3] * 64)) + P._segment(0xC2, b"\x08" + struct.pack(">HH", 16 * rows, 16 * cols) + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    out += P._table(0, 0, dcs[0]) + P._table(0, 1, dcs[1]) + P._table(1, 0, ac) + P._segment(0xDD, struct.pack(">H", restart))
    out += scan([0, 1, 2], 0, 0, 0, 1, [(0, 0), (1, 0), (1, 0)], [dc_first(u) for u in cut(mcus, 6)])
    for high, low in ((0, 2), (2, 1), (1, 0)):
        for c in range(3):
            for first, last in ((1, 5), (6, 63)):
                out += scan([c], first, last, high, low, [(0, 0)], [ac_bits(u[:, first : last + 1], high, low) for u in cut(blocks[c], 1)])
    out += scan([0, 1, 2], 0, 0, 1, 0, [(0, 0)] * 3, ["".join(str(int(blocks[c][k, 0]) & 1) for c, k in u) for u in cut(mcus, 6)])
    return out + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(12))
def test_jpeg_of_common_scans(seed, monkeypatch):
    """Interleaved scans under two tables, zero runs, runs of ends of blocks, refinements and restarts: by tables, in short stretches, and symbol by symbol."""
    rng = np.random.default_rng(seed)
    dense = (0.02, 0.3, 0.9)[seed % 3]
    blocks = [np.where(rng.random((n, 64)) < dense, rng.integers(-60, 61, (n, 64)), 0) for n in (24, 6, 6)]
    media = general_file(rng, blocks, (0, 0, 2, 1)[seed % 4])
    slow = progressive_jpeg.read(media, fast=False)
    assert all((p.blocks == b).all() for p, b in zip(slow.parts, blocks, strict=True))
    for stretch in (1 << 15, 7):
        monkeypatch.setattr(progressive_jpeg, "STRETCH", stretch)
        assert all((p.blocks == b).all() for p, b in zip(progressive_jpeg.read(media).parts, blocks, strict=True))
    with monkeypatch.context() as m:
        m.setattr(progressive_jpeg, "_slow_scan", None)  # whole data never need it
        progressive_jpeg.read(media)

    def outcome(data, fast):
        try:
            return [p.blocks.tolist() for p in progressive_jpeg.read(data, fast=fast).parts]
        except (ValueError, IndexError, struct.error) as e:
            return type(e)

    for n in rng.integers(600, len(media), 6):  # cut off anywhere: as symbol by symbol
        assert outcome(media[:n], True) == outcome(media[:n], False)


def test_jpeg_columns(spark, odd, none):
    stored = progressive_jpeg.store_texts(odd)
    rows = progressive_jpeg.read_back(stored).collect()
    for r in rows:
        raw = (ODD[r.doc_id] or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert len(rows) == odd.count() and len({r.media_sha256 for r in rows if r.doc_id in (10, 11)}) == 1 and len({r.feature for r in rows if r.doc_id in (0, 1)}) == 1
    shapes = progressive_jpeg.decode_media(stored, "doc_id").collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in shapes)
    assert progressive_jpeg.read_back(progressive_jpeg.store_texts(none)).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------------


SENTENCES = {
    "you are an idiot.": "targeted_insult", "He was not an idiot, friend": "negated", "she said idiot": "reported", "a moron\nyou": "insult", "I will kill you": "targeted_threat",
    "nothing here": None, "You idiot, I kill you!": "insult_and_threat", "": None,
    "he said: you are an idiot": "reported", 'he said, "you are an idiot"': "reported", "You are an idiot, he said": "reported", '"you idiot," she wrote.': "reported",
    "you are not, I think, an idiot": "negated", "not now, you idiot": "targeted_insult", "he said you are an idiot": "reported", "I said you are an idiot": "targeted_insult",
    "he said nice things, you idiot": "targeted_insult", "no: you idiot": "targeted_insult", "kill the process": "threat", '"You idiot!" he shouted.': "reported",
    "not today, you idiot, you moron": "targeted_insult", "You are an idiot, and everybody in the whole town said so": "targeted_insult",
}


@pytest.mark.parametrize("text", SENTENCES)
def test_grammar_kinds(text):
    assert [k for k, _ in toxicity.Grammar(toxicity.seed_lexicon()).clauses(text)] == [SENTENCES[text]] * (SENTENCES[text] is not None)


def test_grammar_over_sentences():
    g = toxicity.Grammar(toxicity.seed_lexicon())
    assert [k for k, _ in g.clauses('She wrote: "you idiot. You moron." That day ended. You scum.')] == ["reported", "reported", "targeted_insult"]
    assert [k for k, _ in g.clauses("You idiot! You did not say so; a moron.\nshe said\nidiot")] == ["targeted_insult", "insult", "insult"]
    one, two = g.features(["you idiot"])[0], g.features(["you idiot moron"])[0]
    assert two[0] > one[0] > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["you", "idiot", "Idiot,", "not", "not,", "said", "said,", "said:", '"you', 'moron"', 'kill,"', "I", "kill", "x", "y,", "end.", "sturdy", "„ein", "scum”"]), max_size=14))
def test_composed_machine_is_the_three_in_turn(words):
    lexicon = toxicity.Lexicon({**toxicity.seed_lexicon().whole, "moro": (toxicity.INSULT, 0.3)}, {"stu": 0.4})
    scope, clause = toxicity.scope_grammar(), toxicity.clause_grammar()
    a = b = 0
    total, want = 0.0, []
    for x, own in [*(p for w in words for p in lexicon.write(w)), (toxicity.END, 0.0)]:
        if x == toxicity.END:
            kind = clause.finals.get(b, (None,))[0]
            want += [(kind, total)] if kind else []
            total = 0.0
        a, x, weight = scope.arcs[a][x]
        b, _, more = clause.arcs[b][x]
        total += own + weight + more
    found = toxicity.Grammar(lexicon).clauses(" ".join(words))
    # a line without an insult or a threat is not read
    assert found == want


def test_lexicon_reads_longest_weight():
    lexicon = toxicity.Lexicon({"stupid": (toxicity.INSULT, 0.2), "the": (toxicity.TARGET, 0.0)}, {"stu": 0.4, "stupe": 0.9})
    assert [lexicon.symbol(w) for w in ("stupid", "stupendous", "st", "the", "then", "stu")] == [(toxicity.INSULT, 0.4), (toxicity.INSULT, 0.9), (0, 0.0), (toxicity.TARGET, 0.0), (0, 0.0), (toxicity.INSULT, 0.4)]
    sums = {"kill": [40.0, 0.0], "idiot": [0.0, 30.0]}
    seeds = toxicity.seed_weights(sums, [100.0, 50.0])
    assert seeds["kill"][1] < 0.1 < 0.9 < seeds["idiot"][1] and seeds["murder"] == (toxicity.THREAT, 1.0)


def test_a_shared_passage_makes_no_copies():
    rng = np.random.default_rng(2)
    low = rng.integers(0, 1 << 62, (12, 8)).astype(np.int64)
    low[:6, 3], low[6:9, :2], low[10, 2:7] = 7, 9, low[11, 2:7]
    assert toxicity.document_weights(low).tolist() == [1.0] * 10 + [0.5] * 2


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op7_finite_state_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    own = found[found.held_out]
    assert own[own.toxic == 1].predicted.mean() > 0.85 and own[own.toxic == 0].predicted.mean() < 0.03
    assert ((found.score >= 0.5) == (found.predicted == 1)).all()


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 0), (3, 1), (3, 0), (99, 1), (5, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(odd, labels, "toxic", F.lit(True))
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.id == 4}) == 1
    plain = toxicity.learn(none, labels.limit(0), "toxic", F.lit(True))
    assert plain.score(["you idiot", "good day"]).round().tolist() == [1, 0] and toxicity.scored(none, plain).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------


def test_shards_round_trip_and_lookup(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 300)
    rng = np.random.default_rng(1)
    entries = [(sstable.key_of(int(i)), rng.integers(0, 49_000, rng.integers(0, 50))) for i in np.unique(rng.integers(-(10**6), 10**6, 500))]
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = sstable.Writer(f)
        for k, ids in entries:
            w.add(k, ids)
        with pytest.raises(ValueError):
            w.add(entries[0][0], entries[0][1])
        w.close()
    with path.open("rb") as f:
        r = sstable.Reader(f, path.stat().st_size)
        got = [*r]
        assert [k for k, _, _ in got] == [k for k, _ in entries] and all((a[2] == b[1]).all() for a, b in zip(got, entries, strict=True))
        assert [at for _, at, _ in got] == [0, *np.cumsum([len(x) for _, x in entries])[:-1]] and len(r.index) > 10
        assert all((r.get(k) == ids).all() for k, ids in entries[::7])
        have = {k for k, _ in entries}
        absent = [k for k in map(sstable.key_of, range(0, 4000)) if k not in have]
        assert all(r.get(k) is None for k in absent[:500])
        assert sum(bool(r.bloom[sstable._bloom_at([k], r.bits, r.hashes)].all()) for k in absent) < 0.05 * len(absent)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_of_a_table(spark, odd, none, shards):
    rows = odd.select("doc_id", "text").unionByName(odd.where("doc_id < 9").select(F.lit(3).cast("bigint").alias("doc_id"), "text"))
    rows = rows.unionByName(odd.where("doc_id > 8").select(F.lit(None).cast("bigint").alias("doc_id"), "text"))
    folder = sstable.new_folder(rows)
    first = spark.createDataFrame(sstable.write_shards(rows, folder, shards=shards).collect())
    again = spark.createDataFrame(sstable.write_shards(rows, folder, shards=shards).collect())  # as a repeated task would
    found = sorted(sstable.read_shards(first).collect(), key=lambda r: r.start)
    assert sorted(map(tuple, sstable.read_shards(again).collect()), key=lambda r: r[1]) == [tuple(r) for r in found]
    assert first.select("uri").intersect(again.select("uri")).count() == 0
    ids, at, own = [r.doc_id for r in found], 0, []
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == rows.count()
    for r in found:
        assert r.start == at
        at += r.n_tokens
        own.append((r.doc_id, r.n_tokens, r.ids_crc32))
    texts = [r for r in rows.collect()]
    want = [(r.doc_id, np.array(x + [1], "<u4")) for r, x in zip(texts, direct_ids([r.text for r in texts]), strict=True)]
    assert sorted(own, key=repr) == sorted([(i, len(x), zlib.crc32(x.tobytes())) for i, x in want], key=repr)
    assert sstable.write_shards(none, sstable.new_folder(none)).count() == 0


def test_one_id_fills_several_shards(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i, f"text {i}") for i in range(900)], "doc_id bigint, text string")
    manifest = spark.createDataFrame(sstable.write_shards(rows, sstable.new_folder(rows), shards=9).collect())
    assert max(r.n_docs for r in manifest.collect()) < 250
    found = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found) and len(found) == 900


# -- 9 ---------------------------------------------------------------------------------------------------------------


def slow_base(texts, train):
    from collections import Counter
    import re

    split = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for t in texts]
    c = Counter(w for s, use in zip(split, train, strict=True) if use for w in s)
    n, v = sum(c.values()), len(c)
    return [(len(s), sum(c[w] > 0 for w in s), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in s)) for s in split], n


def test_class_model(spark):
    rng = random.Random(8)
    langs = [[f"{p}{i}" for i in range(300)] for p in "abc"]
    texts = [" ".join(rng.choice(langs[k % 3][: 20 if rng.random() < 0.6 else 300]) for _ in range(40)) for k in range(200)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    rows = class_lm.score(df, F.col("doc_id") % 7 != 2, F.col("doc_id") % 4).orderBy("doc_id").collect()
    want, n = slow_base(texts, [i % 7 != 2 for i in range(200)])
    for r, (tokens_, known, base) in zip(rows, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens_, known, n, r.doc_id % 7 == 2) and abs(r.base_score - base) < 1e-6
    assert sum(r.score for r in rows if r.held_out) > 0.95 * sum(r.base_score for r in rows if r.held_out)


@pytest.mark.parametrize("crowded", [False, True])
def test_index_finds_what_a_search_finds(crowded):
    rng = np.random.default_rng(4)
    top = np.uint64(2**64 - 1)
    for n in (0, 1, 5, 3000):
        h = rng.integers(0, 2**64, n, np.uint64)
        h = np.unique(h >> np.uint64(44) if crowded else np.r_[h, h[:9] + np.uint64(1)])  # crowded: all with the same leading bits
        keys = np.r_[h, h + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64), np.uint64(0), class_lm.END, top]
        for values in (h, np.unique(np.r_[h, top])):
            want = [int(np.searchsorted(values, k)) if k in values else len(values) for k in keys]
            assert class_lm.Index(values).places(keys).tolist() == want


def test_votes_are_shuffled_once(spark):
    texts = spark.createDataFrame([("x a b c",), ("x a x",), ("y a c",), (None,), ("",)], "text string")
    x, y, a, b, c = (next(class_lm._documents(pa.array([w], pa.large_string())))[0][0] for w in "xyabc")
    head = np.sort(np.array([x, y], np.uint64))
    votes = class_lm.tail_votes(texts, head, np.where(head == x, 3, 5))
    want = {(a, 3): 2, (a, 5): 1, (b, 3): 1, (c, 3): 1, (c, 5): 1}
    assert {(np.int64(r.h).view(np.uint64), r.g): r.n for r in votes.collect()} == want
    plan = votes.groupBy("h").agg(F.max("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # not by word and group, then by word again


def test_chunk_files_give_back_the_words_of_any_chunk(spark):
    rows = [(chunk, h, (h + 7) % 58, h % 1000 + 1) for chunk in (-(2**62) - 5, -13, -1, 0, 1, 12, 2**61 + 3) for h in range(-20, 30, 3)]
    known = spark.createDataFrame(rows + rows[:40], "chunk bigint, h bigint, class int, n bigint")
    for counts in (False, True):
        files = class_lm.ChunkFiles(known, len(rows), counts)
        for chunk in {r[0] for r in rows}:
            index, kind, n = files.get(chunk)
            own = sorted((int(np.int64(h).view(np.uint64)), k, m) for c, h, k, m in rows if c == chunk)
            assert index.values.tolist() == [h for h, _, _ in own] and kind.tolist() == [k for _, k, _ in own]
            assert n is None if not counts else n.tolist() == [m for _, _, m in own]
        assert not len(files.get(99)[0].values)
        files.drop(spark)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    n = 20
    c = np.zeros((n, n))
    for _ in range(5000):
        a = rng.integers(0, 10)
        b = 10 + rng.integers(0, 10)
        c[a, b] += 1
        c[b, rng.integers(0, 10)] += 1
    label = class_lm.exchange(c, 2)
    assert len({*label[:10]}) == 1 and len({*label[10:]}) == 1 and label[0] != label[10]


def test_words_outside_the_head_are_exchanged(spark):
    rng = random.Random(5)
    sides = [[f"{p}{i}" for i in range(60)] for p in "ab"]
    # what comes before a word tells nothing of it; what comes after does, as it does of the common words u0 and u1
    texts = [" ".join(w for _ in range(25) for k in [rng.randrange(2)] for w in (f"x{rng.randrange(4)}", f"u{k}" if rng.random() < 0.4 else rng.choice(sides[k]), f"y{k}")) for _ in range(150)]
    docs = spark.createDataFrame([(i % 3, t, False) for i, t in enumerate(texts)], "chunk bigint, text string, held_out boolean")
    own = common.stored(class_lm.chunk_words(docs), "words")
    plain, found = (class_lm.vocabulary(docs, own, head_size=8, rounds=r) for r in (0, 2))
    pairs = [class_lm.class_bigrams(class_lm.neighbours(docs, own, words)) for words in (plain, found)]
    assert all(p.sum() == sum(len(t.split()) + 1 for t in texts) for p in pairs)
    assert class_lm.likelihood(pairs[1]) > class_lm.likelihood(pairs[0]) + 500

    def right(words):
        kinds = {r.h: r["class"] for r in words.collect()}
        hashes = [[next(class_lm._documents(pa.array([w], pa.large_string())))[0].view(np.int64)[0] for w in ws] for ws in sides]
        a, b = ([kinds[h] for h in hs if h in kinds] for hs in hashes)
        return sum(max(a.count(k), b.count(k)) for k in {*a, *b}) / (len(a) + len(b))

    assert right(plain) < 0.8 and right(found) > 0.95


def test_neighbours_are_summed_in_parts(monkeypatch):
    rng, c = np.random.default_rng(4), class_lm
    chunks = [rng.integers(0, 50_000, (100, 1500)).astype("U") for _ in range(3)]
    texts = [[" ".join(t) for t in chunk] for chunk in chunks]
    hashes = [np.concatenate([h for h, _, _ in c._documents(pa.array(t, pa.large_string()))]) for t in texts]
    known = {h: int(h % 48) for h in np.unique(np.concatenate(hashes)).tolist() if h % 5}
    words = [np.array([h for h in np.unique(h).tolist() if h in known], np.uint64) for h in hashes]
    files = [(c.Index(w), np.array([known[h] for h in w.tolist()]), None) for w in words]
    monkeypatch.setattr(c, "ChunkFiles", lambda known, rows: SimpleNamespace(get=files.__getitem__, drop=lambda spark: None))
    monkeypatch.setattr(c, "stored", lambda df, what: df)
    monkeypatch.setattr(c, "F", SimpleNamespace(col=lambda name: 0))
    monkeypatch.setattr(c, "_HELD", 1 << 18)
    monkeypatch.setattr(c, "_PART", 1 << 14, raising=False)
    docs = mock.MagicMock()
    c.neighbours(docs, mock.MagicMock(), mock.MagicMock())
    count = docs.select().mapInArrow.call_args[0][0]  # what a task runs
    batches = [pa.RecordBatch.from_arrays([pa.array([i] * len(t)), pa.array(t)], ["chunk", "text"]) for i, t in enumerate(texts)]
    del texts
    tracemalloc.start()
    found, held = [], 0
    for b in count(iter(batches)):
        held = max(held, tracemalloc.get_traced_memory()[1])
        found.append(pa.RecordBatch.from_arrays([x.take(pa.array(range(len(x)))) for x in b.columns], b.schema.names))
    tracemalloc.stop()
    want = Counter()
    for h in hashes:
        for t in h.reshape(100, 1500).tolist():
            t = [int(c.END), *(w if w in known else int(c.RARE) for w in t), int(c.END)]
            kind = [c.END_CLASS if w == c.END else known.get(w, c.RARE_CLASS) for w in t]
            for a, b, i, j in zip(t, t[1:], kind, kind[1:], strict=False):
                want.update([(a, c._SELF)] if a == b else [(b, i), (a, c._AFTER + j)])
    got = Counter()
    for b in found:
        h = b.column(0).to_numpy()
        assert (h[1:] > h[:-1]).all()
        h = h.view(np.uint64)
        for i, code, n in zip(*(x.tolist() for x in c._unpacked(b.column(2))), strict=True):
            got[int(h[i]), code] += n
    assert got == want
    assert held < 35e6  # bytes; 60 million if all codes are taken apart at once


def slow_scores(texts, train, words):
    """The model's scores by plain Python, from the classes of the words' hashes."""
    import re

    def h(w):
        return next(class_lm._documents(pa.array([w], pa.large_string())))[0].view(np.int64)[0]

    split = [[*map(h, re.findall(r"[^\x20\x09-\x0D]+", t)), int(class_lm.END)] for t in texts]
    n, kind = {r.h: r.n for r in words}, {r.h: r["class"] for r in words}
    total = {}
    for w, k in kind.items():
        total[k] = total.get(k, 0) + n[w]
    once, twice = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
    unknown = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.9
    unseen = max(1, once * (once - 1) / (2 * (twice + 1)))

    def emission(w):
        if w not in n:
            return unknown / unseen
        return (1 - unknown) / total[kind[w]] if kind[w] == class_lm.RARE_CLASS else n[w] / total[kind[w]]

    steps = [[(a, b) for a, b in zip([class_lm.END_CLASS, *ks], ks)] for s in split for ks in [[kind.get(w, class_lm.RARE_CLASS) for w in s]]]
    counts = np.zeros((class_lm.ALL_CLASSES, class_lm.ALL_CLASSES))
    for own, use in zip(steps, train, strict=True):
        for a, b in own if use else ():
            counts[a, b] += 1
    share = (counts.sum(0) + 0.5) / (counts.sum(0) + 0.5).sum()
    moved = np.log10((counts + 2.0 * share) / (counts.sum(1, keepdims=True) + 2.0))
    # all that the model can say after a class is 1: the words of each class, with the unknown ones
    mass = {k: sum(emission(w) for w in n if kind[w] == k) for k in total}
    mass[class_lm.RARE_CLASS] = mass.get(class_lm.RARE_CLASS, 0) + unknown
    assert all(abs(m - 1) < 1e-9 or k == class_lm.RARE_CLASS and not once for k, m in mass.items()) and np.allclose((10**moved).sum(1), 1)
    return [sum(moved[a, b] for a, b in own) + sum(np.log10(emission(w)) for w in s) for own, s in zip(steps, split, strict=True)]


def test_class_scores_against_plain_python(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) if rng.random() < 0.8 else f"z{rng.randrange(400)}" for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [" ".join(thue_morse(2048)), "a " * 70_000]
    train = [i % 5 != 1 for i in range(len(texts))]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    use, chunk = F.col("doc_id") % 5 != 1, class_lm.chunk_of([F.lit("x")], F.col("doc_id"), F.col("text"))
    found = [r.score for r in class_lm.score(df, use, chunk).orderBy("doc_id").collect()]
    docs = df.select(chunk.alias("chunk"), "text", (~use).alias("held_out"))
    assert docs.select("chunk").distinct().count() == 2
    own = common.stored(class_lm.chunk_words(docs), "words")
    words = class_lm.vocabulary(docs.where("not held_out").select("chunk", "text"), own).collect()
    assert np.allclose(found, slow_scores(texts, train, words), atol=1e-6)


def test_best_classes_against_whole_likelihoods():
    rng = np.random.default_rng(1)
    pairs = rng.integers(500, 3000, (class_lm.ALL_CLASSES, class_lm.ALL_CLASSES))
    codes = [(3, 4), (20, 1), (class_lm._AFTER + 7, 5), (class_lm._AFTER + class_lm.END_CLASS, 2), (class_lm._SELF, 2)]
    for kind in (9, 30):
        got = class_lm.best_classes(np.array([kind]), np.zeros(5, int), np.array([c for c, _ in codes]), np.array([n for _, n in codes]), pairs)[0]

        def moved(b):
            p = pairs.copy()
            for where, sign in ((kind, -1), (b, 1)):
                for c, n in codes:
                    at = (where, where) if c == class_lm._SELF else (where, c - class_lm._AFTER) if c >= class_lm._AFTER else (c, where)
                    p[at] += sign * n
            return class_lm.likelihood(p)

        gains = np.array([moved(b) for b in range(class_lm.END_CLASS)])
        assert gains[got] > gains.max() - 0.05


def test_class_probabilities_sum_to_one():
    p = 10 ** class_lm.smoothed(np.random.default_rng(0).integers(0, 9, (class_lm.ALL_CLASSES, class_lm.ALL_CLASSES)))
    assert np.allclose(p.sum(1), 1, atol=1e-9)


def test_unknown_words_share_their_mass(spark):
    texts = [" ".join(["the"] * 20 + [f"w{40 * i + k}" for k in range(40)]) for i in range(20)] + [" ".join(f"junk{k}" for k in range(60)), " ".join(["the"] * 60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    junk, plain = class_lm.score(df, F.col("doc_id") < 20, F.lit(0)).where("held_out").orderBy("doc_id").collect()
    # 800 words occur once and none twice, so an unknown word is one of hundreds of thousands
    assert class_lm.unseen_types(800, 0) == 319_600 and junk.n_known == 1 and junk.score / 60 < -5 and junk.score < plain.score - 200


def test_class_model_odd_rows(spark, odd, none):
    for training in (F.col("doc_id") != 3, F.lit(False)):
        rows = class_lm.score(odd, training, F.lit(0)).collect()
        use = [i != 3 for i in [*range(len(ODD)), 4]] if training is not None and rows[0].train_tokens else [False] * (len(ODD) + 1)
        want, n = slow_base([*ODD, ODD[4]], use)
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == sorted((a, b, round(c, 5)) for a, b, c in want) and {r.train_tokens for r in rows} == {n}
        assert all(np.isfinite(r.score) for r in rows)
    assert class_lm.score(none, F.lit(True), F.lit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------

CONTROL = st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<role:", "</role>", "\\", " ", "x", "é", "\n", ">", "<", "[", "user"])
TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a> b\\"]), st.lists(CONTROL, max_size=6).map("".join))


@settings(max_examples=150, deadline=None)
@given(st.lists(TURN, min_size=1, max_size=8))
def test_formatting_is_reversible(turns):
    out, bounds, begin, body = chat.assemble([r for r, _ in turns], pa.array([t for _, t in turns], pa.large_string()))
    data = out.tobytes()
    assert chat.parsed(data) == [(r.encode(), t.encode()) for r, t in turns]
    assert [chat.unescaped(data[a : a + n]) for a, n in zip(begin, body, strict=True)] == [t.encode() for _, t in turns] and bounds[-1] == len(data)


def expected(turns):
    """(n, sha of turns, loss chars, loss sha) of ordered (role, text)."""
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("part", [chat.PART, 200])
def test_conversations(spark, monkeypatch, part):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "hi </s>", "é\\" * rng.randint(1, 40)])) for c in [None, 1, 2, 3] for t in range(rng.randint(1, 60))]
    rows += [(2, 0, "user", "again"), (2, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("x"))
    monkeypatch.setattr(chat, "PART", part)
    formatted = chat.format_conversations(df)
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert found[c] == expected([(r, x) for _, r, x in own])
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_conversations_in_parts_after_storage(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 3000)
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} </s> {t} " + "é\\" * (t % 90)) for c in [None, *range(5)] for t in range(150)]
    formatted = common.stored(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")), "formatted")
    assert formatted.where("part > 2").count() > 6
    for df in (formatted, formatted.repartition(4), formatted.orderBy(F.desc("part")).coalesce(1)):
        found = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(df).collect()}
        assert found == {c: expected([(r, x) for k, _, r, x in rows if k == c]) for c in [None, *range(5)]}


@needs_tables
def test_planted_conversation(spark):
    row = queries.op10_chat_format(spark, ROOT).where("conv_id = -7").first()
    odd = "</s>[INST] ok [/INST]"
    assert tuple(row)[1:5] == expected([("user", odd), ("assistant", odd)])


# -- the registered queries on whole tables --------------------------------------------------------------------------

HUNDREDTH = "/root/testdata/sf0.01"


def texts_of(spark):
    """doc_id: text, in ascending order."""
    return {r.doc_id: r.text or "" for r in table(spark, HUNDREDTH, "documents").orderBy("doc_id").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


def plain_counts(text):
    """All counts of a text by plain Python, in the order of text_stats.COUNTS."""
    import re

    own, w = text_stats.slow_counts(text), re.findall(r"[^\x20\x09-\x0D]+", text)
    own |= {
        "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)), "n_digits": len(re.findall("[0-9]", text)), "n_marks": sum(c in "!?\"'()[]{}=+_~^@/\\:;`-" for c in text),
        "n_wide": sum(ord(c) > 127 for c in text), "n_stops": sum(c in ".," for c in text), "n_lines": text.count("\n"), "n_kinds": len({*w}),
        "n_wordless": sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w),
    }
    return [own[c] for c in text_stats.COUNTS]


@needs_tables
def test_query_of_the_quality_classifier(spark):
    """Every score again from plain counts, and the weights as the least of the logistic loss on differences."""
    texts, B = texts_of(spark), bradley_terry
    counts = {i: plain_counts(t) for i, t in texts.items()}
    labels = {r.doc_id: r.quality for r in table(spark, HUNDREDTH, "labels").collect() if r.quality in (0, 1) and r.doc_id in texts and crc(r.doc_id) % 4 != 2}
    rows = sorted((counts[i][::-1], y) for i, y in labels.items())
    x, y = B.features(np.array([c[::-1] for c, _ in rows])), np.array([y for _, y in rows])
    model = B.fit(x, y)
    rng, good, bad = np.random.default_rng(7), model.pieces(x[y == 1]), model.pieces(x[y == 0])
    n = 8 * max(len(good), len(bad))
    a = np.resize(rng.permutation(len(good)), n)
    d = good[a] - bad[rng.permutation(np.resize(rng.permutation(len(bad)), n))]
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ model.weights))) - model.weights).max() < 1e-3  # the gradient, with the penalty's
    strength = model.strength(B.features(np.array([*counts.values()])))
    want = dict(zip(counts, 1 / (1 + np.exp(-np.clip(np.log(7 / 3) + strength - model.threshold, -30, 30))), strict=True))
    got = queries.op1_bradley_terry(spark, HUNDREDTH).collect()
    assert len(got) == len(texts) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == (r.score >= 0.7) for r in got)


@needs_tables
def test_query_of_near_duplicates(spark):
    found = queries.op3_bottom_k_near_dups(spark, HUNDREDTH).collect()
    want = near_dups.slow_components([*texts_of(spark).items()], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and len(found) == len(want) and all(r.kept == (r.doc_id == r.component_id) for r in found)


@needs_tables
def test_queries_of_token_ids(spark):
    texts = texts_of(spark)
    ids = dict(zip(texts, ([*x, 1] for x in direct_ids([*texts.values()])), strict=True))
    at, want = 0, set()
    for i, own in ids.items():
        want.add((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    found = queries.op8_sorted_string_tables(spark, HUNDREDTH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want

    pieces, bins = queries.op5_vector_packing(spark, HUNDREDTH).collect(), {}
    ends = {i: [] for i in ids}
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        ends[r.doc_id].append((r.start, r.start + r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for i, own in ends.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == len(ids[i]) and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert at > 0.98 * 2048 * (len(bins) - 8)  # each partition may end with a sequence that isn't full


@needs_tables
def test_query_of_media(spark):
    texts, found = texts_of(spark), queries.op6_progressive_jpeg(spark, HUNDREDTH).collect()
    assert len(found) == len(texts)
    for r in found[::9]:
        raw = texts[r.doc_id].encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = progressive_jpeg.encode(full)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({r.payload_sha256 for r in found}) == len({(r.payload_sha256, r.media_sha256, r.feature) for r in found})


@needs_tables
def test_query_of_toxicity(spark):
    """Every score again: learned on the driver, each sentence by the three machines one after the other."""
    X, texts = toxicity, texts_of(spark)
    labels = {r.doc_id: r.toxic for r in table(spark, HUNDREDTH, "labels").collect() if r.toxic in (0, 1) and r.doc_id in texts and crc(r.doc_id) % 5 != 0}
    sample, y = [texts[i] for i in labels], np.array([*labels.values()])
    w = X.document_weights(X.minima(sample).view(np.int64))
    sums = {t: [round(a, 6), round(b, 6)] for t, (a, b) in X.term_sums(sample, y.tolist(), w.tolist()).items()}
    lexicon = X.lexicon_of(sums, [float(w[y == 0].sum()), float(w[y == 1].sum())])
    scope, clause, paths = X.scope_grammar(), X.clause_grammar(), {}

    def features(text):
        out = dict.fromkeys(X.KINDS, 0.0)
        for line in text.split("\n"):
            a = b = 0
            total = 0.0
            for x, own in [*(p for word in line.split() for p in (paths.get(word) or paths.setdefault(word, lexicon.write(word)))), (X.END, 0.0)]:
                if x == X.END:
                    if kind := clause.finals.get(b, (None,))[0]:
                        out[kind] += total
                    total = 0.0
                a, x, one = scope.arcs[a][x]
                b, _, two = clause.arcs[b][x]
                total += own + one + two
        whole = sum(out.values())
        return [min(v, 6.0) for v in (*out.values(), 100 * whole / (50 + text.count(" ") + text.count("\n")))]

    x = {i: features(t) for i, t in texts.items()}
    model = X.fit(None, np.array([x[i] for i in labels]), y)
    p = 1 / (1 + np.exp(-(np.array([x[i] for i in labels]) @ model.weights + model.bias)))
    each = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    slope = np.array([x[i] for i in labels]).T @ (each * (y - p)) - 0.5 * (model.weights - np.array([*X.KINDS.values(), 0.0]))
    assert np.abs(slope).max() < 1e-3
    found = queries.op7_finite_state_toxicity(spark, HUNDREDTH).collect()
    want = {i: 1 / (1 + np.exp(-np.clip(np.dot(v, model.weights) + model.bias, -30, 30))) for i, v in x.items()}
    assert len(found) == len(texts) and all(r.held_out == (crc(r.doc_id) % 5 == 0) and abs(r.score - want[r.doc_id]) < 1e-5 for r in found)
    assert any(r.predicted for r in found) and not all(r.predicted for r in found)


@needs_tables
def test_query_of_the_class_model(spark):
    texts = texts_of(spark)
    train = [crc(i) % 7 != 2 for i in texts]
    want, n = slow_base([*texts.values()], train)
    found = {r.doc_id: r for r in queries.op9_class_ngram_scores(spark, HUNDREDTH).collect()}
    assert len(found) == len(texts)
    for i, use, (tokens_, known, base) in zip(texts, train, want, strict=True):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not use, tokens_, known, n) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    docs = table(spark, HUNDREDTH, "documents").select(F.xxhash64("doc_id").bitwiseAND(3).alias("chunk"), F.coalesce("text", F.lit("")).alias("text"), (remainder("doc_id", 7) == 2).alias("held_out"))
    words = class_lm.vocabulary(docs.where("not held_out").select("chunk", "text"), common.stored(class_lm.chunk_words(docs), "words")).collect()
    assert np.allclose([found[i].score for i in texts], slow_scores([*texts.values()], train, words), rtol=1e-9, atol=1e-6)


# -- the pipeline ----------------------------------------------------------------------------------------------------


@needs_tables
def test_pipeline_against_plain_steps(spark):
    import corpus_pipeline

    docs = table(spark, ROOT, "documents")
    kept = {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()}
    model = bradley_terry.learn(bradley_terry.counted(docs, "doc_id", "text"), table(spark, ROOT, "labels"), "quality", remainder("id", 4) != 2)
    kept &= {r.id for r in bradley_terry.scored(docs, model, "doc_id", "text").where("score >= 0.7").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    kept = {i for i, (_, c) in near_dups.slow_components(rows, 5).items() if i == c}
    one = spark.createDataFrame([(i,) for i in kept], "doc_id bigint")
    want = mixing.assignments(mixing.sized(docs.join(one, "doc_id"))).groupBy("doc_id").count()
    found = corpus_pipeline.run(spark, ROOT).where("start = 0").groupBy("doc_id").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert len(corpus_pipeline.STAGES) == 5
