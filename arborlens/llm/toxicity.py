"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers are composed. The lexical one reads a word's characters, a trie with arcs for the marks at its edges, and
writes symbols: insult, threat, target, negation, report (said, wrote), first person, quotation marks, comma, colon, end of a sentence, else nothing. The
scope one rewrites insults and threats as negated or reported. The clause one collects what a sentence holds, and accepts with the
sentence's kind and a weight. The last two are composed beforehand, the first with them as words come, a word's path being kept.
A sentence ends at . ! ? ; or at a line's end; not at a mark before the end of a quotation.

Negation holds to the end of its sentence, over what stands between two commas, in which it doesn't hold ("not, I think, an idiot", but "not now, you idiot").
A report holds for what follows it: after a colon or without a mark to the sentence's end, after a comma where that comes at once, in
quotation marks to their end, over several sentences too. It holds for what stands before it if no more than three words lie between it and a comma or the end of a
quotation ("you idiot," she wrote). One's own report (I said) is none. A document's features are the sums of weights by kind; a logistic model
turns them into a score.

Insults are learned from the labelled rows: words, and word beginnings of 3 to 8 letters, that toxic documents have far
more often than others (a likelihood ratio well beyond chance, and 8 times the odds). The log of the odds is the weight of the
lexical transducer's arc, so a doubtful word counts less than a plain one; the seed words of insults and threats have weights between their prior and that log,
by how often the labels show them. What targets, negations and reports count is learned as the weights of the kinds. Near copies in the sample count
once together: a document weighs one over the size of its largest group that agrees in COPIED of eight minima of shingle hashes. Model weights
start from priors for kinds that the labels don't show. The fit uses at most TOXIC rows labelled 1 and CLEAN rows
labelled 0, those with the smallest hashes of their ids; scoring covers every whole text.

Cases: a null text is an empty one, whose score is that of no clause; texts of any length are read whole, line by line; labels other
than 0 and 1 are ignored, of several the largest counts; repeated rows get the same score, and of labelled rows with one id the one whose text has the
smallest hash is learned from; rows without an id are scored, not learned from; ties of hashes go by id; other columns don't matter, whatever their names; without labels the seed words and priors remain;
empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import map_batches, stored, text_of

TOXIC, CLEAN, ODDS = 4_000, 12_000, 8.0
#: Equal minima of near copies, of eight; a shared passage gives fewer.
COPIED = 5
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, SELF, OPEN, CLOSE, COMMA, COLON, END, NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, REPORTED_THREAT, BACK = range(17)
SYMBOLS = range(17)

#: Seed words; what the labels teach comes on top.
SEEDS = {
    INSULT: ("idiot", "idiots", "moron", "morons", "imbecile", "scum", "scumbag", "bastard", "bastards", "asshole", "bitch"),
    THREAT: ("kill", "murder", "strangle", "stab", "shoot", "hurt", "destroy", "crush", "matar", "asesinar", "tuer", "assassiner", "umbringen", "töten"),
    TARGET: (
        "you", "your", "yours", "yourself", "u", "him", "her", "them", "he", "she", "they", "tú", "usted", "ustedes", "vosotros", "toi", "vous", "du", "dich", "dir", "euch", "ihr",
    ),
    NEGATION: (
        "not", "never", "no", "neither", "nor", "don't", "won't", "isn't", "aren't", "doesn't", "didn't", "cannot", "can't", "nunca", "jamás", "pas", "jamais", "nicht", "kein", "keine",
        "niemals",
    ),
    REPORT: (
        "said", "says", "told", "wrote", "writes", "quoted", "quoting", "called", "reported", "claims", "claimed", "replied", "shouted", "dijo", "dice", "dit", "écrit", "sagte", "sagt",
        "schrieb",
    ),
    SELF: ("i", "we", "yo", "je", "ich", "wir", "nous"),
}
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Marks at a word's end, and quotation marks at either.
_MARKS = {",": COMMA, ":": COLON, ".": END, "!": END, "?": END, ";": END}
_QUOTES = frozenset("\"'“”„«»‘’‚")
#: Letters of the beginnings that are learned.
LENGTHS = range(3, 9)


# -- transducers -----------------------------------------------------------------------------------------------------


@dataclass
class Transducer:
    """A deterministic transducer over small alphabets: arcs[state][symbol] = (next state, output, weight). finals: state -> (kind, weight)."""

    arcs: list[list[tuple[int, int, float]]]
    finals: dict[int, tuple[str, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, start, step, final=lambda state: None) -> Transducer:
        """The machine over the states that step(state, symbol) = (state, output, weight) reaches."""
        number, queue, arcs = {start: 0}, [start], []
        for state in queue:  # grows
            row = []
            for x in SYMBOLS:
                to, out, weight = step(state, x)
                if to not in number:
                    number[to] = len(queue)
                    queue.append(to)
                row.append((number[to], out, weight))
            arcs.append(row)
        return cls(arcs, {number[state]: (final(state), 0.0) for state in queue if final(state)})

    def compose(self, after: Transducer) -> Transducer:
        """What this one's output gives in `after`, as one machine over pairs of states that can be reached from (0, 0)."""

        def step(pair: tuple[int, int], x: int) -> tuple[tuple[int, int], int, float]:
            to, out, weight = self.arcs[pair[0]][x]
            to2, out2, weight2 = after.arcs[pair[1]][out]
            return (to, to2), out2, weight + weight2

        return Transducer.of((0, 0), step, lambda pair: after.finals.get(pair[1], (None,))[0])

    def run(self, symbols: list[tuple[int, float]]) -> list[tuple[str, float]]:
        """The kind and the weight of each accepted sentence of a line: symbols and the weights that they bring."""
        state, total, out = 0, 0.0, []
        for x, own in (*symbols, (END, 0.0)):
            if x == END:
                kind, weight = self.finals.get(state, (None, 0.0))
                if kind:
                    out.append((kind, total + weight))
                total = 0.0
            state, _, weight = self.arcs[state][x]
            total += own + weight
        return out


#: States of a report: none; its verb has just been; words have followed; a colon has; a quotation has.
_JUST, _LOOSE, _AFTER_COLON, _QUOTED = 1, 2, 3, 4


def _scope(state: tuple[int, int, int, int], x: int) -> tuple[tuple[int, int, int, int], int, float]:
    """state: negation (1, or 2 between commas), report, words that a report may still come after to hold for what was before, first person."""
    negation, report, back, first = state
    if x == END:
        return ((0, report if report == _QUOTED else 0, 0, 0), x, 0.0)
    if x == COMMA:
        return ((0, 2, 1)[negation], 0 if report == _LOOSE else report, 3, 0), x, 0.0
    if x == COLON:
        return (0, _AFTER_COLON if report in (_JUST, _LOOSE) else report, 0, 0), x, 0.0
    if x == OPEN:
        return (negation, _QUOTED if report else 0, back, 0), x, 0.0
    if x == CLOSE:
        return (negation, 0 if report == _QUOTED else report, 3, 0), x, 0.0
    if x == REPORT and not first and report != _QUOTED:
        return (negation, _JUST, 0, 0), BACK if back else REPORT, 0.0
    out = x
    if x in (INSULT, THREAT):
        if report:
            out = REPORTED_INSULT if x == INSULT else REPORTED_THREAT
        elif negation == 1:
            out = NEGATED_INSULT if x == INSULT else NEGATED_THREAT
        else:
            negation = 0
    return (1 if x == NEGATION else negation, _LOOSE if report == _JUST else report, max(back - 1, 0), int(x == SELF)), out, 0.0


def scope_grammar() -> Transducer:
    return Transducer.of((0, 0, 0, 0), _scope)


#: The kinds of sentences, in the order of the features, and the weights that they have before any label is seen.
KINDS = {"targeted_insult": 3.0, "insult": 3.0, "targeted_threat": 3.0, "threat": 0.2, "insult_and_threat": 4.0, "negated": 0.2, "reported": 0.2}
_HOLDS = {INSULT: 1, THREAT: 2, TARGET: 4, NEGATED_INSULT: 8, NEGATED_THREAT: 8, REPORTED_INSULT: 16, REPORTED_THREAT: 16}


def _clause(held: int, x: int) -> tuple[int, int, float]:
    """States are sets of what the sentence has held: insult 1, threat 2, target 4, negated 8, reported 16. A target beside an insult adds a quarter."""
    if x == END:
        return 0, x, 0.0
    if x == BACK:
        return (held & ~3 | 16 if held & 3 else held), x, 0.0
    return held | _HOLDS.get(x, 0), x, 0.25 if x == TARGET and held & 5 == 1 or x == INSULT and held & 5 == 4 else 0.0


def _kind(held: int) -> str | None:
    if held & 3:
        return "insult_and_threat" if held & 3 == 3 else ("targeted_" if held & 4 else "") + ("insult" if held & 1 else "threat")
    return "reported" if held & 16 else "negated" if held & 8 else None


def clause_grammar() -> Transducer:
    return Transducer.of(0, _clause, _kind)


@cache
def sentences() -> Transducer:
    """The scope and the clause grammar as one machine."""
    return scope_grammar().compose(clause_grammar())


# -- the lexical transducer ------------------------------------------------------------------------------------------


def stripped(word: str) -> str:
    return _EDGE.sub("", word.lower())


class Lexicon:
    """A trie over the characters of words. whole: words to (symbol, weight); beginnings: insult beginnings to weights."""

    def __init__(self, whole: dict[str, tuple[int, float]], beginnings: dict[str, float] | None = None):
        self.whole, self.beginnings = whole, beginnings or {}
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float]] = [(NONE, 0.0)]
        self.begun: list[float] = [0.0]
        for word, end in self.whole.items():
            self.ends[self._state(word)] = end
        for word, weight in self.beginnings.items():
            self.begun[self._state(word)] = weight

    def _state(self, word: str) -> int:
        at = 0
        for c in word:
            if c not in self.arcs[at]:
                self.arcs[at][c] = len(self.arcs)
                self.arcs.append({})
                self.ends.append((NONE, 0.0))
                self.begun.append(0.0)
            at = self.arcs[at][c]
        return at

    def symbol(self, word: str) -> tuple[int, float]:
        """The symbol of a word without marks and its weight: the trie's, or an insult if a beginning on the path weighs more."""
        at, best = 0, 0.0
        for c in word:
            at = self.arcs[at].get(c, -1)
            if at < 0:
                break
            best = max(best, self.begun[at])
        x, weight = self.ends[at] if at >= 0 else (NONE, 0.0)
        return (INSULT, best) if x in (NONE, INSULT) and best > weight else (x, weight)

    def write(self, word: str) -> list[tuple[int, float]]:
        """The symbols of a word with its marks, and their weights."""
        low = word.lower()
        m = _EDGE.match(low)
        head = low[: m.end()] if m else ""
        core = stripped(word)
        tail = low[len(head) + len(core) :]
        out = [(OPEN, 0.0)] if not _QUOTES.isdisjoint(head) else []
        if core:
            out.append(self.symbol(core))
        closed = not _QUOTES.isdisjoint(tail)
        marks = [x for c in (tail if core else "".join(c for c in head if c in _MARKS)) if (x := CLOSE if c in _QUOTES else _MARKS.get(c)) is not None]
        return out + [(x, 0.0) for x in dict.fromkeys(marks) if not (closed and x == END)]


def seed_weights(sums: dict[str, list[float]], total: list[float]) -> dict[str, tuple[int, float]]:
    """The seed words; of insults and threats with weights between 1, which counts as four documents, and what the labels say."""
    out = {w: (kind, 0.0) for kind, words in SEEDS.items() for w in words}
    for kind in (INSULT, THREAT):
        for w in SEEDS[kind]:
            b, a = sums.get(w, (0.0, 0.0))
            out[w] = kind, (4 + (a + b) * min(max(_odds(a, b, total) / 5, 0.0), 1.5)) / (4 + a + b)
    return out


def _odds(a: float, b: float, total: list[float]) -> float:
    return math.log((a + 0.5) / (total[1] - a + 0.5)) - math.log((b + 0.5) / (total[0] - b + 0.5))


def seed_lexicon() -> Lexicon:
    return Lexicon(seed_weights({}, [0.0, 0.0]))


class Grammar:
    """The lexicon composed with the sentences' machine; features of texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, sentences()
        self.known: dict[str, bool] = {}
        self.paths: dict[str, list[tuple[int, float]]] = {}
        self.places = {k: i for i, k in enumerate(KINDS)}

    def __getstate__(self):
        return self.lexicon.whole, self.lexicon.beginnings

    def __setstate__(self, state):
        self.__init__(Lexicon(*state))

    def _learn(self, words: list[str]) -> None:
        """Keep the paths of new words, and whether they hold an insult or a threat; a word of nothing has no path."""
        for w in words:
            if w not in self.known:
                path = self.lexicon.write(w)
                self.known[w] = any(x in (INSULT, THREAT) for x, _ in path)
                if path != [(NONE, 0.0)]:
                    self.paths[w] = path

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """(kind, weight) of each sentence that holds an insult or a threat."""
        out, plain = [], [(NONE, 0.0)]
        if len(self.known) > 400_000:
            self.known, self.paths = {}, {}
        known = self.known
        for line in text.split("\n"):
            ws = line.split()
            try:
                hit = any([known[w] for w in ws])
            except KeyError:
                self._learn(ws)
                hit = any([known[w] for w in ws])
            if hit:
                out += self.machine.run([x for w in ws for x in self.paths.get(w, plain)])
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the sum of weights of each kind, to 6 at most, and the density, 100 times all of them over 50 more than the words."""
        x = np.zeros((len(texts), len(KINDS) + 1))
        for i, t in enumerate(texts):
            if found := self.clauses(t):
                for kind, weight in found:
                    x[i, self.places[kind]] += weight
                x[i, -1] = 100 * x[i].sum() / (50 + t.count(" ") + t.count("\n"))
        return np.minimum(x, 6.0)


# -- learning --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of the clause kinds and of the density, and a bias."""

    grammar: Grammar
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.grammar.features(texts) @ self.weights, -30, 30)))


def terms(text: str) -> set[str]:
    """A text's words, and their beginnings of 3 to 8 letters as beginning + '*'."""
    ws = {stripped(w) for w in set(text.split())} - {""}
    return {w for w in ws if len(w) >= 3} | {f"{w[:k]}*" for w in ws for k in LENGTHS if len(w) >= k}


def minima(texts: list[str], n: int = 8) -> np.ndarray:
    """The least of n hashes over each text's runs of four words: near copies agree in most of them, other texts in none."""
    salts = kernels.mix(np.arange(1, n + 1, dtype=np.uint64))
    low = np.zeros((len(texts), n), np.uint64)
    data, offsets = kernels.buffers(pa.array(texts, pa.large_string()))
    for i in range(len(texts)):
        h = kernels.words(data[offsets[i] : offsets[i + 1]], np.zeros(1, np.int64), fold=True, key=kernels.FIXED)[2]
        h = kernels.shingles(h, np.zeros(len(h), np.int64), 4)[0]
        low[i] = [kernels.mix(h ^ s).min() if len(h) else 0 for s in salts]
    return low


def document_weights(low: np.ndarray) -> np.ndarray:
    """One over the size of each document's largest group whose members all agree in the same COPIED minima."""
    sizes = np.ones(len(low))
    for some in combinations(range(low.shape[1]), COPIED):
        h = np.zeros(len(low), np.uint64)
        for k in some:
            h = kernels.mix(h ^ low[:, k].view(np.uint64)) + np.uint64(k)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        sizes = np.maximum(sizes, n[back])
    return 1 / sizes


def term_sums(texts: list[str], y: list[int], weights: list[float]) -> dict[str, list[float]]:
    """term: [summed weights of the documents labelled 0 that have it, and of those labelled 1]."""
    out: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for text, label, w in zip(texts, y, weights, strict=True):
        for t in terms(text):
            out[t][label] += w
    return out


def lexicon_of(sums: dict[str, list[float]], total: list[float], least: float = 28.0, odds: float = ODDS) -> Lexicon:
    """The seed words and the terms that set the documents labelled 1 apart. A beginning goes if one longer
    beginning or word stands for nine tenths of what it finds, or plainer ones of one more letter for eight tenths; a longer one goes if a
    shorter one that stays has its weight."""
    good = {}
    for t, (b, a) in sums.items():
        gain = _odds(a, b, total)
        if a >= 2 and gain >= math.log(odds) and _ratio(a, total[1], b, total[0]) >= least:
            good[t] = (a, min(gain / 5, 1.5))
    longer: dict[str, float] = defaultdict(float)  # the most that one extension of a beginning finds
    for t, (a, _) in good.items():
        for k in LENGTHS:
            if k < len(t.rstrip("*")) or (k == len(t) and t[-1] != "*"):
                longer[t[:k]] = max(longer[t[:k]], a)
    plainer: dict[str, float] = defaultdict(float)
    for t, (a, weight) in good.items():
        if t[-1] == "*" and weight >= good.get(f"{t[:-2]}*", (0, 9.0))[1] + 0.1:
            plainer[t[:-2]] += a
    whole, beginnings = seed_weights(sums, total), {}
    for t in sorted(good, key=lambda t: (len(t.rstrip("*")), t)):
        a, weight = good[t]
        if t[-1] != "*":
            whole.setdefault(t, (INSULT, weight))
        elif longer[t[:-1]] < 0.9 * a and plainer[t[:-1]] < 0.8 * a and not any(beginnings.get(t[:k], 0) >= weight for k in LENGTHS if k < len(t) - 1):
            beginnings[t[:-1]] = weight
    return Lexicon(whole, beginnings)


def _ratio(a: float, n: float, b: float, m: float) -> float:
    """The log-likelihood ratio of a of n against b of m."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k > 0 else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    def share(k: float, n: float) -> float:
        return min(max(k / n, 1e-12), 1 - 1e-12)

    p = share(a + b, n + m)
    return 2 * (part(a, n, share(a, n)) + part(b, m, share(b, m)) - part(a, n, p) - part(b, m, p))


def fit(grammar: Grammar, x: np.ndarray, y: np.ndarray) -> Model:
    """Weights of clause kinds from features x and labels y, near the priors where the rows say little."""
    prior = np.array([*KINDS.values(), 0.0])
    if not (y == 1).any() or not (y == 0).any():
        return Model(grammar, prior, -2.0)
    x = np.c_[x, np.ones(len(x))]
    mean, hold = np.r_[prior, -2.0], np.r_[np.full(len(prior), 0.5), 0.05]
    w = mean.copy()
    each = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())

    def loss(w: np.ndarray) -> float:
        z = np.where(y == 1, x @ w, -(x @ w))
        return float(each @ np.logaddexp(0, -z) + 0.5 * hold @ (w - mean) ** 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (each * (y - p)) - hold * (w - mean))
        now, size = loss(w), 1.0
        while loss(w + size * step) > now and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return Model(grammar, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows that are allowed (a condition on `id`). Texts stay on the executors; the driver gets, of
    at most TOXIC + CLEAN documents, eight hashes and a few features each, and the terms that pass a first test."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(allowed & F.col("y").isin(0, 1) & F.col("id").isNotNull())
    marks = marks.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    some = None
    for y, most in ((1, TOXIC), (0, CLEAN)):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        some = part if some is None else some.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = stored(rows.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")  # TOXIC + CLEAN ids at most are broadcast

    def low_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = minima(text_of(batch.column(2)).to_pylist()).view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1) * low.shape[1], pa.int32()), pa.array(low.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["id", "y", "low"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = sorted(map(tuple, map_batches(sample, low_of, f"id {kind}, y int, low array<bigint>").collect()), key=repr)
    ys = np.array([r[1] for r in found], int)
    w = document_weights(np.array([r[2] for r in found], np.int64).reshape(len(found), -1)) if found else np.zeros(0)
    by_id = {r[0]: float(x) for r, x in zip(found, w, strict=True)}
    total = [float(w[ys == 0].sum()), float(w[ys == 1].sum())]

    def sums_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = term_sums(text_of(batch.column(2)).to_pylist(), batch.column(1).to_pylist(), [by_id[i] for i in batch.column(0).to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1] for v in sums.values()], pa.float64())], ["term", "w0", "w1"])

    lexicon = seed_lexicon()
    if total[0] and total[1]:
        sums = map_batches(sample, sums_of, "term string, w0 double, w1 double").groupBy("term").agg(F.round(F.sum("w0"), 6).alias("w0"), F.round(F.sum("w1"), 6).alias("w1"))
        seeds = [w for kind in (INSULT, THREAT) for w in SEEDS[kind]]
        sums = sums.where(F.col("term").isin(seeds) | F.expr(f"w1 >= 2 and (w1 + 0.5) * ({total[0]!r} - w0 + 0.5) >= {ODDS} * (w0 + 0.5) * ({total[1]!r} - w1 + 0.5)"))
        lexicon = lexicon_of({r["term"]: [r["w0"], r["w1"]] for r in sums.collect()}, total)
    grammar = Grammar(lexicon)

    def features_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = grammar.features(text_of(batch.column(2)).to_pylist())
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(1), flat], ["y", "x"])

    seen = sorted(map(tuple, map_batches(sample, features_of, "y int, x array<double>").collect()))
    return fit(grammar, np.array([r[1] for r in seen], float).reshape(len(seen), len(KINDS) + 1), np.array([r[0] for r in seen], int))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(text_of(batch.column(1)).to_pylist()))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double")
