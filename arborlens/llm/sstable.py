"""Token ids in sorted-string tables: shards keyed by document id, for binary-search lookup.

A shard holds blocks, then a sparse index, a Bloom filter and a footer:

    block   zstd of: u32 entries, then per entry varint shared, varint rest, the rest of the key, varint ids, and after all
            keys the ids as little-endian u16 or u32 (the footer says which). Every RESTART-th key shares nothing.
    index   per block: u32 key length, first key, u64 offset, u32 size, u64 ids before the block's first in the shard
    bloom   u32 hashes, u64 bits, the bits
    footer  u64 index offset, u64 bloom offset, u32 blocks, u64 entries, u64 ids, u8 bytes an id, magic (8 bytes)

A key is a byte (0 without an id, else 1), the id, 8 bytes big-endian with the sign bit flipped (so byte order is numeric order), the hash of the text
in the same form, and 4 bytes that number equal texts. Shards cover ranges of ids; where one id fills several, ranges of its texts' hashes. Their number follows from the
input's bytes. Each attempt of a task writes files of its own name, in one go and without renaming, so any store will do; the manifest names
those of the attempt that succeeded, others are never read. Only one block is held at a time on writing and reading.

Cases: a null text is an empty one; an empty document still has its end id; texts of any length are one entry; repeated ids are kept side by side, in the
order of their texts' hashes, and equal rows by number; rows without an id come before all others, in the same order; columns besides the two that
are named don't matter; an empty table gives no shard.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import new_path, place_of, text_of

MAGIC, BLOCK, RESTART, BITS = b"ARBSST02", 1 << 18, 16, 10
#: Bytes of input for each shard beyond the session's number of shuffle partitions.
SHARD = 1 << 30
_FOOTER = struct.Struct("<QQIQQB8s")
_KEY = struct.Struct(">BQQI")


def key_of(doc_id: int | None, text_hash: int = 0, copy: int = 0) -> bytes:
    return _KEY.pack(doc_id is not None, (doc_id or 0) + (1 << 63), text_hash + (1 << 63), copy)


def id_of(key: bytes) -> int | None:
    known, doc_id, _, _ = _KEY.unpack(key)
    return doc_id - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, p: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[p] & 127) << shift
        p += 1
        if b[p - 1] < 128:
            return n, p
        shift += 7


def _bloom_at(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Bit positions of the keys, by double hashing."""
    h = np.array([(zlib.crc32(k), zlib.adler32(k[::-1]) * 2654435761 + zlib.crc32(k[::-1])) for k in keys], np.uint64).reshape(len(keys), 2)
    i = np.arange(hashes, dtype=np.uint64)
    return ((h[:, :1] + i * (h[:, 1:] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Appends (key, ids) in ascending order of keys to a stream."""

    def __init__(self, stream, width: int = 2):
        self.stream, self.width, self.at = stream, width, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.marks: list[bytes] = []
        self.entries = self.ids = 0
        self._new()

    def _new(self) -> None:
        self.keys, self.values, self.first, self.count, self.last, self.size, self.before = bytearray(), [], b"", 0, b"", 0, self.ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key <= self.newest:
            raise ValueError("keys must ascend")
        self.newest = key
        shared = 0
        if self.count % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.first = self.first if self.count else key
        self.keys += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids))
        self.values.append(ids.astype(f"<u{self.width}").tobytes())
        self.last, self.count, self.size = key, self.count + 1, self.size + len(self.values[-1])
        self.entries, self.ids = self.entries + 1, self.ids + len(ids)
        self.marks.append(key)
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            block = zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", self.count) + bytes(self.keys) + b"".join(self.values))
            self.stream.write(block)
            self.index.append((self.first, self.at, len(block), self.before))
            self.at += len(block)
        self._new()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QIQ", at, size, before) for k, at, size, before in self.index)
        bits, hashes = max(64, len(self.marks) * BITS), 7
        field = np.zeros((bits + 7) // 8 * 8, bool)
        if self.marks:
            field[_bloom_at(self.marks, bits, hashes)] = True
        bloom = struct.pack("<IQ", hashes, bits) + np.packbits(field, bitorder="little").tobytes()
        self.stream.write(index + bloom + _FOOTER.pack(self.at, self.at + len(index), len(self.index), self.entries, self.ids, self.width, MAGIC))


class Reader:
    """A shard behind a random-access file (pyarrow's, or any with seek and read)."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - _FOOTER.size)
        at, bloom, blocks, self.entries, self.ids, self.width, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        stream.seek(at)
        tail = stream.read(size - _FOOTER.size - at)
        self.index, p = [], 0
        for _ in range(blocks):
            n = struct.unpack_from("<I", tail, p)[0]
            key = tail[p + 4 : p + 4 + n]
            self.index.append((key, *struct.unpack_from("<QIQ", tail, p + 4 + n)))
            p += 4 + n + 20
        self.hashes, self.bits = struct.unpack_from("<IQ", tail, bloom - at)
        self.bloom = np.unpackbits(np.frombuffer(tail, np.uint8, offset=bloom - at + 12), bitorder="little")

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of the entries of block k."""
        _, at, size, start = self.index[k]
        self.stream.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read(size))
        count, p, key, heads = struct.unpack_from("<I", raw)[0], 4, b"", []
        for _ in range(count):
            shared, p = _read_varint(raw, p)
            rest, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + rest]
            n, p = _read_varint(raw, p + rest)
            heads.append((key, n))
        for key, n in heads:
            yield key, start, np.frombuffer(raw, f"<u{self.width}", n, p)
            p += n * self.width
            start += n

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of a key: Bloom filter, then a binary search of the index, then one block."""
        if not self.bloom[_bloom_at([key], self.bits, self.hashes)].all():
            return None
        k = bisect.bisect_right(self.index, key, key=lambda x: x[0]) - 1
        return next((ids for found, _, ids in self.block(k) if found == key), None) if k >= 0 else None


def _input_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of the input's files; of the texts, where Spark doesn't know the files."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def _places(cuts: np.ndarray):
    """The number of each row's shard, from ids and hashes; a cut that occurs n times parts its id's rows in n + 1 by hash."""

    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        i, h = ids.fillna(0).to_numpy().astype(np.int64), hashes.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        low, high = np.searchsorted(cuts, i, "left"), np.searchsorted(cuts, i, "right")
        n = (high - low).astype(np.uint64)
        # one occurrence is where the id's shard begins; more are whole shards of the id
        inside = (h >> np.uint64(32)) * np.maximum(n, np.uint64(1)) >> np.uint64(32)
        return pd.Series(np.where(known, np.where(n > 1, low + 1 + inside.astype(np.int64), high), 0).astype(np.int32))

    return F.pandas_udf(place, "int")


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Write the shards; a row each: shard, uri, n_docs, n_tokens. The result must be stored by the caller: computing it writes.

    Ranges come from quantiles of the id column alone, so texts are read and shuffled once.
    """
    spark, path = docs.sparkSession, path or tokens.default_path()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_input_bytes(docs, text_col) // SHARD))
    cuts = np.sort(np.array(rows.approxQuantile("id", [k / shards for k in range(1, shards)], 0.2 / shards) if shards > 1 else [])).astype(np.int64)
    rows = rows.withColumn("h", F.xxhash64("text"))
    part = _places(cuts)("id", "h") if len(cuts) else F.lit(0)
    placed = rows.withColumn("part", part).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = tokens.encoder(path), np.array([end_id], "<u4").tobytes()
        fs, root = place_of(folder)
        fs.create_dir(root, recursive=True)
        writer = stream = shard = name = None
        last, copy, out = None, 0, []

        def close() -> None:
            writer.close()
            stream.close()
            out.append((shard, f"{folder}/{name}", writer.entries, writer.ids))

        for batch in batches:
            texts = text_of(batch.column(1))
            for doc, h, here, ids in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), encoder.encode_all(t.as_py() for t in texts), strict=True):
                if here != shard:
                    if writer:
                        close()
                    shard, name = here, f"shard-{here:06d}-{uuid.uuid4().hex}.sst"
                    stream = fs.open_output_stream(f"{root}/{name}")
                    writer = Writer(stream, encoder.width)
                copy = copy + 1 if (doc, h) == last else 0
                last = doc, h
                writer.add(key_of(doc, h, copy), np.frombuffer(ids + tail, "<u4"))
        if writer:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["shard", "uri", "n_docs", "n_tokens"])

    return placed.mapInArrow(run, "shard bigint, uri string, n_docs bigint, n_tokens bigint")


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row a shard; their token counts are summed on the driver, a number for each shard.
    """
    spark = manifest.sparkSession
    rows, before = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r["uri"], before))
        before += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = place_of(uri)
                with fs.open_input_file(place) as stream:
                    reader = Reader(stream, stream.size())
                    for k in range(len(reader.index)):
                        out = [(id_of(key), start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in reader.block(k)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], [id_col, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "uri string, start bigint")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(docs: DataFrame) -> str:
    return new_path(docs.sparkSession, "sst")
