"""Brown class-based bigram model: P(word | previous) = P(class | class of the previous) * P(word | class).

Counts cover all words of all training documents, by 64-bit hash. The HEAD most frequent words are clustered by exchange: each in turn
moves to the class with the highest likelihood of the class bigrams, until nothing moves. Their bigrams (a dense table of
bounded size) are counted over all training documents. Every other word starts in the tail class that most of its occurrences vote
for, an occurrence's vote being the group (of GROUPS, by exchange over the classes) of the nearest head word before it, else after
it. Then all words seen twice or more outside the head are exchanged ROUNDS times, in parallel: each moves to the class, of the head's
and the tail's alike, with the highest likelihood of the current class bigrams, from the counts of its neighbours' classes on both
sides; a round that lowers the likelihood is taken back. Words that occur once stay together, as they stand for unknown words, whose
neighbours no count tells; the two share a class, in which the unknown ones have the share that once-words have among words seen once
or twice, in equal parts for as many unknown words as those counts let expect (the base has one unknown word). The end of a document is a class of its own, and stands before its first word too. Class transitions are smoothed by class
frequencies.

The vocabulary is never gathered, and texts are never shuffled: each pass reads them in place, chunk by chunk, with the classes of the chunk's own
distinct words, which executors write to files in the shared folder and read there (ChunkFiles). Only tables of bounded size (head words, classes, transitions, a file
name a gigabyte of such words) are held by the driver or by closures.

Cases: a null text is an empty one and has its end only; texts of any length are read whole, a long one in a chunk of its own; repeated rows are scored
one by one, and count as often as they come, whatever their ids, null ones too; words with equal counts are ordered by hash, under a fixed key, so that scores don't differ
between runs; columns besides the id and the text don't matter; without training documents every word is unknown and the score is the base's; an
empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop, map_batches, new_path, place_of, remove, return_memory, stored, text_of

HEAD, CLASSES, GROUPS, SWEEPS, SMOOTH = 1023, 48, 8, 6, 2.0
#: The end of a document in place of a word's hash.
END = np.uint64(1)
END_CLASS, RARE_CLASS, ALL_CLASSES = CLASSES + GROUPS, CLASSES + GROUPS + 1, CLASSES + GROUPS + 2
#: Rounds of exchange over all words outside the head.
ROUNDS = 2
#: In place of the hash of a word that occurs once. Codes of a word's neighbours: the class before it, _AFTER and the class after it, _SELF.
RARE, _AFTER, _SELF = np.uint64(2), 64, 127
_HELD = 1 << 21
#: Codes of neighbours that are taken apart at once.
_PART = 1 << 18
#: Words of chunks in a file beyond the session's number of shuffle partitions.
_IN_FILE = 1 << 26


def _documents(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word hashes, document indexes, documents) for runs of documents."""
    data, offsets = K.buffers(texts)
    for i, j in K.units(offsets):
        _, _, _, _, h, doc = K.unit_words(data, offsets, i, j, fold=True, key=K.FIXED)
        yield h, doc, j - i


def with_ends(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of n documents, each followed by END, and the bounds of documents."""
    counts = np.bincount(doc, minlength=n)
    bounds = np.r_[0, np.cumsum(counts + 1)]
    out = np.full(bounds[-1], END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, bounds


class Index:
    """Places in a sorted array of hashes: the leading bits tell where to look, and the few keys that aren't there within STEPS are searched for."""

    STEPS = 4

    def __init__(self, values: np.ndarray):
        bits = min(22, len(values).bit_length() + 2)
        self.values, self.shift = values, np.uint64(64 - bits)
        self.padded = np.r_[values, np.uint64(2**64 - 1)]
        below = np.cumsum(np.bincount((values >> self.shift).astype(np.int64), minlength=1 << bits))
        self.first = np.r_[0, below[:-1]].astype(np.int32 if len(values) < 1 << 31 else np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, len(values) for those that aren't there."""
        at = self.first[(keys >> self.shift).astype(np.int64)].astype(np.int64)
        low = np.flatnonzero(self.padded[at] < keys)
        for _ in range(self.STEPS):
            if not len(low):
                break
            at[low] += 1
            low = low[self.padded[at[low]] < keys[low]]
        if len(low):
            at[low] = np.searchsorted(self.values, keys[low])
        at[self.padded[at] != keys] = len(self.values)
        return at


def _summed_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(counts[order], heads)


class _Tally:
    """Counts of 64-bit keys in sorted arrays, merged as they grow; gives back what exceeds the bound."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def put(self, keys: np.ndarray) -> bool:
        """Count keys, and give nothing back; whether all had to be merged."""
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if full := self.size > _HELD:
            self.merge()
        return full

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(keys) and self.put(keys) and self.size > _HELD // 2:
            yield from self.drain()

    def merge(self) -> None:
        if len(self.keys) > 1:
            k, n = _summed_by(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [k], [n], len(k)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.merge()
        if self.keys:
            yield self.keys[0], self.counts[0].astype(np.int64)
        self.keys, self.counts, self.size = [], [], 0


def _batches(key: np.ndarray, n: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 18)].view(np.int64)), pa.array(n[a : a + (1 << 18)])], names)


def _symbols(tokens: np.ndarray, head: Index) -> np.ndarray:
    """Place in the head, len(head) for other words, len(head) + 1 for the end."""
    at = head.places(tokens)
    at[tokens == END] = len(head.values) + 1
    return at


def head_bigrams(texts: DataFrame, head: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbols over a one-column table of texts: a square table of len(head) + 2."""
    k = len(head) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size, index = np.zeros(k * k, np.int64), [], 0, Index(head)
        for batch in batches:
            for h, doc, n in _documents(text_of(batch.column(0))):
                tokens, _ = with_ends(h, doc, n)
                s = _symbols(tokens, index)
                held.append(np.r_[k - 1, s[:-1]] * k + s)  # an end stands before each document
                size += len(s)
                if size > _HELD:
                    table += np.bincount(np.concatenate(held), minlength=k * k)
                    held, size = [], 0
        if held:
            table += np.bincount(np.concatenate(held), minlength=k * k)
        at = np.flatnonzero(table)
        yield from _batches(at.astype(np.uint64), table[at], ["pair", "n"])

    found = texts.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # k * k rows at most
    out = np.zeros(k * k, np.int64)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300)) * (x > 0)


def exchange(counts: np.ndarray, classes: int, fixed: int = 0, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each row of a square table of bigram counts; the last `fixed` words have classes of their own, from `classes` on.

    A word moves to the class that gives the class bigrams the highest likelihood, sum of n log n over class pairs less
    those of both margins; ties go to the lowest class.
    """
    n = len(counts)
    free = n - fixed
    c = counts.astype(float)
    order = np.argsort(-(c.sum(0) + c.sum(1))[:free], kind="stable")
    label = np.r_[np.zeros(free, np.int64), classes + np.arange(fixed)]
    label[order] = np.arange(free) % classes
    k = classes + fixed
    member = np.zeros((n, k))
    member[np.arange(n), label] = 1
    pairs = member.T @ c @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a = label[w]
            out, into, own = c[w] @ member, c[:, w] @ member, c[w, w]
            out[a] -= own
            into[a] -= own
            # the table without w
            pairs[a] -= out
            pairs[:, a] -= into
            pairs[a, a] -= own
            rows, cols = pairs.sum(1), pairs.sum(0)
            base_row, base_col = _xlogx(pairs).sum(1), _xlogx(pairs).sum(0)
            new_rows, new_cols = pairs[:classes] + out, pairs[:, :classes] + into[:, None]
            r, q = _xlogx(new_rows), _xlogx(new_cols)
            i = np.arange(classes)
            corner = pairs[i, i] + out[:classes] + into[:classes] + own
            gain = (r.sum(1) - base_row[:classes]) + (q.sum(0) - base_col[:classes])
            gain += _xlogx(corner) - r[i, i] - q[i, i] + _xlogx(pairs[i, i])
            gain -= _xlogx(rows[:classes] + out.sum() + own) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + into.sum() + own) - _xlogx(cols[:classes])
            # into and out also change the margins of the other classes, alike for every choice
            best = int(np.argmax(gain > gain.max() - 1e-9))
            b = best if gain[best] > gain[a] + 1e-9 else a
            pairs[b] += out
            pairs[:, b] += into
            pairs[b, b] += own
            if b != a:
                member[w, a], member[w, b], label[w] = 0, 1, b
                moved += 1
        if not moved:
            break
    return label


def tail_votes(texts: DataFrame, head: np.ndarray, group: np.ndarray) -> DataFrame:
    """(h, g, n): how often each other word stands nearest to a head word of group g. group: of each head word."""
    lookup = np.r_[group, -1, -1].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, index = [_Tally() for _ in range(GROUPS)], Index(head)
        words, votes, size = [], [], 0

        def out(g: int, found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for b in _batches(*found, ["h", "n"]):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, g, np.int32)), b.column(1)], ["h", "g", "n"])

        def settle() -> Iterator[pa.RecordBatch]:
            if words:
                h, vote = np.concatenate(words), np.concatenate(votes)
                for g in range(GROUPS):
                    for found in tallies[g].add(h[vote == g]):
                        yield from out(g, found)

        for batch in batches:
            for h, doc, _ in _documents(text_of(batch.column(0))):
                if not len(h):
                    continue
                s = _symbols(h, index)
                known = lookup[s]
                at = np.arange(len(h))
                before = np.maximum.accumulate(np.where(known >= 0, at, -1))
                after = np.minimum.accumulate(np.where(known >= 0, at, len(h))[::-1])[::-1]
                left = np.where((before >= 0) & (doc[before] == doc), known[before], -1)
                right = np.where(after < len(h), known[np.minimum(after, len(h) - 1)], -1)
                right = np.where(doc[np.minimum(after, len(h) - 1)] == doc, right, -1)
                vote = np.where(left >= 0, left, np.where(right >= 0, right, 0))
                other = s == len(head)
                words.append(h[other])
                votes.append(vote[other].astype(np.int8))
                size += len(words[-1])
                if size > _HELD // 2:
                    yield from settle()
                    words, votes, size = [], [], 0
        yield from settle()
        for g in range(GROUPS):
            for found in tallies[g].drain():
                yield from out(g, found)

    return texts.mapInArrow(run, "h bigint, g int, n bigint").repartition("h").groupBy("h", "g").agg(F.sum("n").alias("n"))  # tasks have summed up already


# -- words of chunks -------------------------------------------------------------------------------------------------


def chunk_of(place: list[Column], row: Column, text: Column) -> Column:
    """A chunk's number from what tells a file (or another lasting group of rows) and a row's number in it: 2048 rows below 64 kB, 64 below 1 MB, else one."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    rows = F.when(size < 1 << 16, 2048).when(size < 1 << 20, 64).otherwise(1)
    return F.xxhash64(*place, rows, F.floor(row / rows))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows): runs of rows of one chunk, which the first column tells."""
    for batch in batches:
        if batch.num_rows:
            chunks = batch.column(0).to_numpy()
            heads = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
            for a, b in zip(heads, np.r_[heads[1:], len(chunks)], strict=True):
                yield int(chunks[a]), batch.slice(a, b - a)


def chunk_words(docs: DataFrame) -> DataFrame:
    """(chunk, h, n) from (chunk, text, held_out): each chunk's words and its end, and how often they stand in documents that aren't held out; a
    chunk that several partitions or batches share can have a word several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def settle(raw: tuple[list[np.ndarray], list[np.ndarray]], parts: list) -> int:
            """Counts of the words to learn from, and zeros for the others; how many they are."""
            for words, learned in zip(raw, (1, 0), strict=True):
                k, n = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_counts=True)
                parts.append((k, n * learned))
            return len(parts[-1][0]) + len(parts[-2][0])

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, parts in held.items():
                k, n = _summed_by(*(np.concatenate([p[c] for p in parts]) for c in (0, 1)))
                for b in _batches(k, n, ["h", "n"]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, chunk, np.int64)), *b.columns], ["chunk", "h", "n"])

        for chunk, rows in _runs(batches):
            use, at, parts = ~rows.column(2).to_numpy(zero_copy_only=False), 0, held.setdefault(chunk, [])
            raw, waiting = ([], []), 0
            for h, doc, m in _documents(text_of(rows.column(1))):
                learned = use[at + doc]
                raw[0].append(h[learned])
                raw[1].append(h[~learned])
                at, waiting = at + m, waiting + len(h)
                if waiting > _HELD // 2:
                    size += settle(raw, parts)
                    raw, waiting = ([], []), 0
            size += settle(raw, parts)
            parts.append((np.array([END], np.uint64), np.array([use.sum()])))
            if size > _HELD:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()
        return_memory()

    return docs.mapInArrow(run, "chunk bigint, h bigint, n bigint")


class ChunkFiles:
    """Words of chunks with their classes, and their counts if asked for, in files that each hold the chunks of one remainder.

    A file holds, a chunk after another, the hashes in ascending order, the counts and the classes; then chunks, offsets and lengths as an index, and
    the number of chunks. Executors write files under names of their own, so those of a repeated task are in nobody's way.
    """

    def __init__(self, known: DataFrame, rows: int, counts: bool = False):
        """known: (chunk, h, class, n), of about as many rows; several of a word in a chunk are one."""
        spark = known.sparkSession
        self.folder, self.counts = new_path(spark, "chunks"), counts
        self.n_files = n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // _IN_FILE)
        what = F.shiftleft("n", 8).bitwiseOR(F.col("class").cast("bigint")) if counts else F.col("class").cast("bigint")
        # a partition is a file; one long to sort by is sorted by its digits
        placed = known.select("chunk", "h", what.alias("what")).repartitionById(n_files, F.pmod(F.col("chunk"), F.lit(n_files)).cast("int")).sortWithinPartitions("chunk")
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = place_of(folder)
            fs.create_dir(root, recursive=True)
            stream = number = name = chunk = None
            index, parts, at = [], [], 0

            def end_chunk() -> None:
                nonlocal at
                h, what = (np.concatenate([p[c] for p in parts]) for c in range(2))
                h = h.view(np.uint64)
                order = np.argsort(h)
                h = h[order]
                first = np.r_[True, h[1:] != h[:-1]]
                h, what = h[first], what[order[first]]
                stream.write(h.tobytes() + ((what >> 8).tobytes() if counts else b"") + (what & 255).astype(np.uint8).tobytes())
                index.append((chunk, at, len(h)))
                at += len(h) * (17 if counts else 9)

            for batch in batches:
                if not batch.num_rows:
                    continue
                chunks, h, what = (batch.column(c).to_numpy() for c in range(3))
                if stream is None:
                    number = int(chunks[0]) % n_files
                    name = f"{number:06d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(f"{root}/{name}")
                if (chunks % n_files != number).any():
                    raise ValueError("a partition holds chunks of several files")
                heads = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
                for a, b in zip(heads, np.r_[heads[1:], len(chunks)], strict=True):
                    if parts and chunks[a] != chunk:
                        end_chunk()
                        parts = []
                    chunk = int(chunks[a])
                    parts.append((h[a:b], what[a:b]))
            if stream:
                end_chunk()
                stream.write(np.array(index, np.int64).T.tobytes() + struct.pack("<Q", len(index)))
                stream.close()
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name])], ["file", "name"])
            return_memory()

        self.names = {r["file"]: r["name"] for r in stored(placed.mapInArrow(run, "file bigint, name string"), "names").collect()}  # a row a file
        self.indexes, self.held = {}, {}

    def __getstate__(self):
        return {**self.__dict__, "indexes": {}, "held": {}}

    def drop(self, spark) -> None:
        remove(spark, self.folder)

    def get(self, chunk: int) -> tuple[Index, np.ndarray, np.ndarray | None]:
        """(index of the hashes, classes, counts) of a chunk; the last few are kept."""
        if chunk not in self.held:
            if len(self.held) > 3:
                self.held.pop(next(iter(self.held)))
            h, *rest = self._read(chunk)
            self.held[chunk] = Index(h), *rest
        return self.held[chunk]

    def _read(self, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        name = self.names.get(chunk % self.n_files)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64) if self.counts else None
        if name is None:
            return none
        fs, root = place_of(self.folder)
        with fs.open_input_file(f"{root}/{name}") as stream:
            if name not in self.indexes:
                if len(self.indexes) > 63:
                    self.indexes.clear()
                size = stream.size()
                n = struct.unpack("<Q", stream.read_at(8, size - 8))[0]
                self.indexes[name] = np.frombuffer(stream.read_at(24 * n, size - 8 - 24 * n), np.int64).reshape(3, n)
            chunks, at, sizes = self.indexes[name]
            i = int(np.searchsorted(chunks, chunk))
            if i == len(chunks) or chunks[i] != chunk:
                return none
            m = int(sizes[i])
            data = stream.read_at(m * (17 if self.counts else 9), int(at[i]))
        kind = np.frombuffer(data, np.uint8, m, len(data) - m).astype(np.int64)
        return np.frombuffer(data, np.uint64, m), kind, np.frombuffer(data, np.int64, m, 8 * m) if self.counts else None


# -- exchange over the whole vocabulary ------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, own: DataFrame, *, head_size: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(h, n, class) of all words of the training documents (chunk, text), stored. own: the stored table of chunk_words()."""
    texts = docs.select("text")
    counts = stored(own.groupBy("h").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    top = counts.where((F.col("h") != int(END)) & (F.col("n") > 1)).orderBy(F.desc("n"), "h").limit(head_size).select("h").collect()
    head = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    bigrams = head_bigrams(texts, head)
    label = exchange(bigrams, CLASSES, fixed=2)
    member = np.zeros((len(label), CLASSES + 2), np.int64)
    member[np.arange(len(label)), label] = 1
    group = exchange(member.T @ bigrams @ member, GROUPS, fixed=2)[:CLASSES]
    votes = tail_votes(texts, head, group[label[: len(head)]])
    first = F.max(F.col("n") * GROUPS + (GROUPS - 1) - F.col("g"))  # of the groups with most votes
    chosen = votes.groupBy("h").agg((CLASSES + GROUPS - 1 - first % GROUPS).cast("int").alias("class"))
    spark = texts.sparkSession
    heads = spark.createDataFrame(pa.table({"h": head.view(np.int64), "head_class": label[: len(head)].astype(np.int32)}))
    out = counts.join(F.broadcast(heads), "h", "left").join(chosen, "h", "left")  # head_size rows at most
    kind = F.when(F.col("h") == int(END), END_CLASS).when(F.col("n") == 1, RARE_CLASS).otherwise(F.coalesce("head_class", "class", F.lit(CLASSES)))
    words, before, most = stored(out.select("h", "n", kind.cast("int").alias("class")), "vocabulary"), None, -np.inf
    drop(counts)
    for _ in range(rounds):
        found = neighbours(docs, own, words)
        pairs = class_bigrams(found)
        if (now := likelihood(pairs)) < most:
            drop(found)
            drop(words)
            return before
        if before is not None:
            drop(before)
        before, most = words, now
        moved = words.join(exchanged(found, pairs, head), "h", "left").select("h", "n", F.coalesce("moved", "class").alias("class"))
        words = stored(moved, "vocabulary")
        drop(found)
    return words


def neighbours(docs: DataFrame, own: DataFrame, words: DataFrame) -> DataFrame:
    """(h, class, codes): how often the words seen twice, the end and all rare words together stand beside each class, as count * 128 + code; stored.

    docs: (chunk, text) of the training documents; own: the stored table of chunk_words(); words: (h, n, class).
    """
    some = words.where((F.col("n") > 1) & (F.col("h") != int(END))).select("h", "n", "class")
    files = ChunkFiles(own.where("n > 0").select("chunk", "h").join(some.hint("shuffle_hash"), "h"), own.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def keep(h: np.ndarray, kind: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for key, n in found:
                held.append(_packed(h, kind, key, n))
                size += len(key)
            if size > 2 * _HELD:
                yield from flush()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            for part in _by_word(held):
                yield from _summed(part).to_batches()

        for chunk, rows in _runs(batches):
            index, kind, _ = files.get(chunk)
            k, tally, raw, waiting = len(index.values), _Tally(), [], 0
            h, kind = np.r_[index.values, END, RARE], np.r_[kind, END_CLASS, RARE_CLASS]
            for g, doc, m in _documents(text_of(rows.column(1))):
                t, _ = with_ends(g, doc, m)
                at = index.places(t)
                at[(at == k) & (t != END)] = k + 1
                before = np.r_[k, at[:-1]]  # an end stands before each document
                same = before == at
                x = np.r_[at[~same] * 128 + kind[before[~same]], before[~same] * 128 + _AFTER + kind[at[~same]], at[same] * 128 + _SELF]
                raw.append(x)
                waiting += len(x)
                if waiting > _HELD // 4:
                    yield from keep(h, kind, tally.add(np.concatenate(raw)))
                    raw, waiting = [], 0
            if raw:
                yield from keep(h, kind, tally.add(np.concatenate(raw)))
            yield from keep(h, kind, tally.drain())
        if held:
            yield from flush()
        return_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            h = held.column("h").to_numpy()
            if h[0] != h[-1]:  # the last word may go on in the next batch
                cut = int(np.searchsorted(h, h[-1]))
                yield from _summed(held.slice(0, cut)).to_batches()
                held = held.slice(cut)
            elif held.num_rows > 4096:
                held = _summed(held)
        if held is not None:
            yield from _summed(held).to_batches()
        return_memory()

    schema = "h bigint, class int, codes binary"
    out = stored(docs.select("chunk", "text").mapInArrow(count, schema).repartition("h").sortWithinPartitions("h").mapInArrow(merge, schema), "neighbours")
    files.drop(docs.sparkSession)
    return out


def _by_word(tables: list[pa.Table]) -> Iterator[pa.Table]:
    """The rows of neighbours() in the order of h, in parts of about _PART codes, between which no word is divided; the list is emptied."""
    rows = pa.concat_tables(tables).combine_chunks()
    tables.clear()
    order = np.argsort(rows.column("h").to_numpy(), kind="stable")
    h = rows.column("h").to_numpy()[order]
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = pc.binary_length(rows.column("codes")).to_numpy()[order] // 8
    before = np.r_[0, np.cumsum(sizes, dtype=np.int64)][heads]
    cuts = heads[np.flatnonzero(np.diff(before // _PART, prepend=-1))]
    for a, b in zip(cuts, np.r_[cuts[1:], len(h)], strict=True):
        yield rows.take(pa.array(order[a:b]))


def _packed(h: np.ndarray, kind: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.Table:
    """Rows of neighbours() from sorted keys, word * 128 + code, and their counts."""
    word = key >> 7
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    at = word[heads]
    codes = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.r_[heads, len(key)] * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(n << 7 | key & 127))])
    return pa.table([pa.array(h[at].view(np.int64)), pa.array(kind[at].astype(np.int32)), codes], ["h", "class", "codes"])


def _unpacked(codes: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of a column of codes."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    data, offsets = K.buffers(codes.cast(pa.large_binary()))
    x = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64)
    return np.repeat(np.arange(len(codes)), np.diff(offsets) // 8), x & 127, x >> 7


def _summed(rows: pa.Table) -> pa.Table:
    """Rows of neighbours(), in the order of h, with one row a word."""
    h, kind = rows.column("h").to_numpy(), rows.column("class").to_numpy()
    first = np.r_[True, h[1:] != h[:-1]]
    heads, place = np.flatnonzero(first), np.cumsum(first) - 1
    row, code, n = _unpacked(rows.column("codes"))
    return _packed(h[heads].view(np.uint64), kind[heads], *_summed_by(place[row] * 128 + code, n))


def class_bigrams(found: DataFrame) -> np.ndarray:
    """Counts of class pairs from neighbours()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ALL_CLASSES**2, np.int64)
        for batch in batches:
            if batch.num_rows:
                row, code, n = _unpacked(batch.column(1))
                own = batch.column(0).to_numpy().astype(np.int64)[row]
                after = code >= _AFTER
                to = np.where(code == _SELF, own, code - _AFTER)
                table += np.bincount((own * ALL_CLASSES + to)[after], n[after], minlength=len(table)).astype(np.int64)
        at = np.flatnonzero(table)
        yield from _batches(at.astype(np.uint64), table[at], ["pair", "n"])

    pairs = found.select("class", "codes").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # ALL_CLASSES**2 rows at most
    out = np.zeros(ALL_CLASSES**2, np.int64)
    out[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return out.reshape(ALL_CLASSES, ALL_CLASSES)


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood of the class bigrams that depends on the classes."""
    pairs = pairs.astype(float)
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def best_classes(kind: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of highest likelihood for each word, all others staying: kind is the words' classes, (row, code, n) their neighbours by row.

    A word's counts are taken out of its own class before that is compared with the others; ties stay. An empty class takes none, since every word gains by a class of its own and all would move there together.
    """
    free, pairs = END_CLASS, pairs.astype(float)
    key, back = np.unique(n << 7 | code, return_inverse=True)
    c, m = key & 127, (key >> 7).astype(float)[:, None]
    # the cell of a neighbour of each code in each class: before, after, or the corner for the word itself
    cell = np.zeros((_SELF + 1, free))
    cell[:ALL_CLASSES], cell[_AFTER : _AFTER + ALL_CLASSES], cell[_SELF] = pairs[:, :free], pairs[:free].T, np.diag(pairs)[:free]
    held = _xlogx(cell)
    into = _xlogx(cell[c] + m) - held[c]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    own = kind[row]
    stay = held[code, own] - _xlogx(np.maximum(cell[code, own] - n, 0))
    gain, bounds, a = np.empty((len(heads), free)), np.r_[heads, len(row)], 0
    while a < len(heads):  # words of about 4,096 neighbours, whose table the caches hold
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 4096, "right")) - 1)
        p, q = bounds[a], bounds[b]
        part = into[back[p:q]]
        part[np.arange(q - p), own[p:q]] = stay[p:q]
        np.add.reduceat(part, heads[a:b] - p, axis=0, out=gain[a:b])
        a = b
    for side, total in ((code >= _AFTER, pairs.sum(1)[:free]), ((code < _AFTER) | (code == _SELF), pairs.sum(0)[:free])):
        w = np.add.reduceat(np.where(side, n, 0), heads).astype(float)[:, None]
        less = _xlogx(total + w) - _xlogx(total)
        at = np.arange(len(kind))
        less[at, kind] = (_xlogx(total) - _xlogx(np.maximum(total - w, 0)))[at, kind]
        gain -= less
    gain[:, (pairs.sum(0) + pairs.sum(1))[:free] == 0] = -np.inf
    best = gain.argmax(1)
    at = np.arange(len(kind))
    return np.where(gain[at, best] > gain[at, kind] + 1e-9, best, kind)


def exchanged(found: DataFrame, pairs: np.ndarray, head: np.ndarray) -> DataFrame:
    """(h, moved): the new classes of the words of neighbours() outside the sorted head."""
    fixed = np.r_[head, END, RARE].view(np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), fixed)))
        if not batch.num_rows:
            return None
        best = best_classes(batch.column(1).to_numpy().astype(np.int64), *_unpacked(batch.column(2)), pairs)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32))], ["h", "moved"])

    return map_batches(found, run, "h bigint, moved int")


def unseen_types(once: int, twice: int) -> float:
    """How many words the training documents lack, at least one: Chao's estimate from the words seen once and twice."""
    return max(1.0, once * (once - 1) / (2 * (twice + 1)))


def encoded(docs: DataFrame, files: ChunkFiles, kind_of: str, tokens: int, kinds: int, class_total: np.ndarray, unknown: float, unseen: float) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, emission, classes): all of a document's score but the transitions.

    docs: (chunk, text, held_out, id); files: each chunk's known words with classes and counts. unknown: what the unknown words have of the
    rare class; each of the `unseen` ones that are estimated has an equal part of it.
    """
    floor = np.log10(1 / (tokens + kinds + 1))
    total = np.maximum(class_total.astype(float), 1)
    rare = class_total[RARE_CLASS]
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "emission", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches):
            index, kind, n = files.get(chunk)
            base = np.r_[np.log10((n + 1) / (tokens + kinds + 1)), floor]
            own = np.where(kind == RARE_CLASS, (1 - unknown) / max(rare, 1), n / total[kind])
            emission = np.r_[np.log10(np.maximum(own, 1e-300)), np.log10(unknown / unseen)]
            kind = np.r_[kind, RARE_CLASS].astype(np.uint8)
            out = [[] for _ in range(5)]
            for g, doc, m in _documents(text_of(rows.column(1))):
                t, bounds = with_ends(g, doc, m)
                at = index.places(t)
                starts = bounds[:-1]
                out[0].append(np.diff(bounds))
                out[1].append(np.add.reduceat((at < len(index.values)).astype(np.int64), starts))
                out[2].append(np.add.reduceat(base[at], starts))
                out[3].append(np.add.reduceat(emission[at], starts))
                k = kind[at].tobytes()
                out[4] += [k[a:b] for a, b in zip(starts, bounds[1:], strict=True)]
            parts = [pa.array(np.concatenate(x)) for x in out[:4]]
            yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(2), *parts, pa.array(out[4], pa.binary())], names)
        return_memory()

    return docs.mapInArrow(run, f"id {kind_of}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, classes binary")


def _steps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the class pair of each token, bounds of documents) of a column of class sequences; an end stands before the first."""
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    data, offsets = K.buffers(column)
    k = data[offsets[0] : offsets[-1]].astype(np.int64)
    bounds = offsets - offsets[0]
    before = np.r_[END_CLASS, k[:-1]]
    before[bounds[:-1]] = END_CLASS
    return before * ALL_CLASSES + k, bounds


def transitions(sequences: DataFrame) -> np.ndarray:
    """Counts of class pairs over a one-column table of class sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ALL_CLASSES**2, np.int64)
        for batch in batches:
            if batch.num_rows:
                table += np.bincount(_steps(batch.column(0))[0], minlength=len(table))
        at = np.flatnonzero(table)
        yield from _batches(at.astype(np.uint64), table[at], ["pair", "n"])

    found = sequences.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # ALL_CLASSES**2 rows at most
    out = np.zeros(ALL_CLASSES**2, np.int64)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(ALL_CLASSES, ALL_CLASSES)


def smoothed(counts: np.ndarray, weight: float = SMOOTH) -> np.ndarray:
    """log10 P(class | class before): counts with `weight` more of the class frequencies (and a little of all classes)."""
    share = counts.sum(0) + 0.5
    share = share / share.sum()
    return np.log10((counts + weight * share) / (counts.sum(1, keepdims=True) + weight))


def score(docs: DataFrame, training: Column, chunk: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out (not in training), n_tokens, n_known, train_tokens, base_score, score.

    training: a condition on docs' columns. chunk: an expression that gives each row the number of its chunk, always the
    same one; rows of a chunk should stand together (see chunk_of).
    """
    kind_of = docs.schema[id_col].dataType.simpleString()
    training = F.coalesce(training, F.lit(False))
    chunk = F.coalesce(chunk.cast("bigint"), F.lit(0).cast("bigint"))
    chunked = docs.select(chunk.alias("chunk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~training).alias("held_out"), F.col(id_col).alias("id"))
    own = stored(chunk_words(chunked.select("chunk", "text", "held_out")), "words")
    words = vocabulary(chunked.where("not held_out").select("chunk", "text"), own)
    totals = {r["class"]: (r["t"], r["v"]) for r in words.groupBy("class").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect()}
    tokens, kinds = sum(t for t, _ in totals.values()), sum(v for _, v in totals.values())
    class_total = np.array([totals.get(c, (0, 0))[0] for c in range(ALL_CLASSES)], np.int64)
    twice = words.where("n = 2").count()
    once = int(class_total[RARE_CLASS])
    unknown = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.9

    files = ChunkFiles(own.select("chunk", "h").join(words.hint("shuffle_hash"), "h"), own.count(), counts=True)
    rows = stored(encoded(chunked, files, kind_of, tokens, kinds, class_total, unknown, unseen_types(once, twice)), "encoded")
    files.drop(docs.sparkSession)
    drop(own)
    drop(words)
    table = smoothed(transitions(rows.where("not held_out").select("classes"))).reshape(-1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                steps, bounds = _steps(batch.column(6))
                moved = np.add.reduceat(table[steps], bounds[:-1])
                total = pa.array(batch.column(5).to_numpy() + moved) if tokens else batch.column(4)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(4)], pa.array(np.full(batch.num_rows, tokens)), batch.column(4), total], names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(finish, f"`{id_col}` {kind_of}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
