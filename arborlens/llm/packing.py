"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

A document's ids are cut into pieces of `length` ids and a remainder. Full pieces are sequences by themselves. Remainders
are packed by the dot-product heuristic: a bin takes, among the pieces that fit, the one with the largest product of its
demands (tokens, segments, loss tokens, each as a share of the limit) with the bin's remaining room; when none
fits, the next bin opens with the piece of most tokens. Pieces with equal demands are interchangeable, so a choice costs one
product over the distinct demands, not over the pieces.

Rows are packed in windows of at most WINDOW pieces of one partition, in one pass over the input and without a shuffle: memory is
bounded, no group is gathered, and a lost executor repeats its partitions only. A sequence id is the partition's number times
2**32 plus the sequence's number there.

Cases: a null text is an empty one; a document without ids, or an empty one with an end id, still has one piece; texts of any length
are cut into as many pieces as they need; null ids are kept as they are; repeated rows are packed one by one; a piece with more loss tokens than the limit is cut further; of pieces with
equal products the first in the order of demands is taken; other columns don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import return_memory, text_of

LENGTH, SEGMENTS, WINDOW = 2048, 64, 16_384


def pack(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in the bin) of each row of integer demands; every demand is within the limits. Ties go to the larger first demand."""
    kinds, back = np.unique(demands, axis=0, return_inverse=True)
    back = back.reshape(-1)
    order = np.argsort(back, kind="stable")
    heads = np.searchsorted(back[order], np.arange(len(kinds) + 1))
    left = np.diff(heads).copy()
    taken = np.zeros(len(kinds), np.int64)
    share = kinds / limits
    bins, places = np.zeros(len(demands), np.int64), np.zeros(len(demands), np.int64)
    number = -1
    for k in np.flatnonzero((kinds[:, 0] == limits[0])):  # these leave no room for tokens
        if not (kinds[:, 0] == 0).any():
            bins[order[heads[k] : heads[k + 1]]] = number + 1 + np.arange(left[k])
            number, left[k] = number + left[k], 0
    live = np.flatnonzero(left)
    while len(live):
        number += 1
        room, place = limits.astype(np.int64).copy(), 0
        fit = live
        while len(fit):
            if place:
                value = share[fit] @ (room / limits)
                k = fit[len(value) - 1 - int(value[::-1].argmax())]
            else:
                k = fit[-1]  # kinds ascend by tokens
            item = order[heads[k] + taken[k]]
            taken[k] += 1
            left[k] -= 1
            bins[item], places[item] = number, place
            place += 1
            room -= kinds[k]
            fit = fit[: np.searchsorted(kinds[fit, 0], room[0], "right")]  # kinds ascend by tokens
            fit = fit[(left[fit] > 0) & (kinds[fit, 1:] <= room[1:]).all(1)]
        live = live[left[live] > 0]
    return bins, places


def cut(n: int, loss: np.ndarray | None, length: int, loss_limit: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of n ids; loss marks the loss-bearing ones (None: all)."""
    if n == 0:
        return [(0, 0)]
    if loss is None:
        step = min(length, loss_limit)
        return [(a, min(step, n - a)) for a in range(0, n, step)]
    run, out, a = np.r_[0, np.cumsum(loss)], [], 0
    while a < n:
        b = min(n, a + length, int(np.searchsorted(run, run[a] + loss_limit, "right")) - 1)
        out.append((a, max(1, b - a)))
        a += max(1, b - a)
    return out


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, *, length: int = LENGTH, segments: int = SEGMENTS,
    loss_limit: int = LENGTH, end_id: int | None = 1, path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset (and ids, if asked for).

    loss_col: a boolean column, whether a row's ids bear loss (null: no); without it, all do.
    """
    path = path or tokens.default_path()
    limits = np.array([length, segments, loss_limit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, base, done = tokens.encoder(path).encode_all, TaskContext.get().partitionId() << 32, 0
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        pieces: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal done, pieces
            bins, places = pack(np.array([(p[2], 1, p[5]) for p in pieces], np.int64), limits)
            order = np.lexsort((places, bins))
            size = np.array([p[2] for p in pieces])[order]
            head = np.r_[True, bins[order][1:] != bins[order][:-1]]
            run = np.cumsum(size) - size
            offset = np.zeros(len(pieces), np.int64)
            offset[order] = run - run[head][np.cumsum(head) - 1]
            columns = [pa.array(x) for x in zip(*[p[:6] for p in pieces], strict=True)]
            columns = [columns[0].cast(kind), *[c.cast(pa.int64()) for c in columns[1:]], pa.array(base + done + bins), pa.array(offset)]
            if with_ids:
                columns.append(pa.array([p[6] for p in pieces], pa.binary()))
            done += int(bins.max()) + 1
            pieces = []
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            bears = batch.column(2).to_pylist() if loss_col else None
            texts = text_of(batch.column(1))
            for row, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), encode_all(t.as_py() for t in texts), strict=True)):
                ids += tail
                n, lossy = len(ids) // 4, not loss_col or bool(bears[row])
                for start, size in cut(n, None if lossy else np.zeros(n, np.int8), length, loss_limit):
                    blob = ids[4 * start : 4 * (start + size)]
                    pieces.append((doc, start, size, zlib.crc32(blob), n, size if lossy else 0, blob if with_ids else None))
                    if len(pieces) >= WINDOW:
                        yield flush()
        if pieces:
            yield flush()
        return_memory()

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kind_of = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind_of}, " + ", ".join(f"{c} bigint" for c in names[1:8]) + (", ids binary" if with_ids else "")
    columns = [F.col(id_col).alias("a"), F.col(text_col).alias("b"), *([F.coalesce(F.col(loss_col), F.lit(False)).alias("c")] if loss_col else [])]
    return docs.select(*columns).mapInArrow(run, schema)
