"""Chat formatting by columnar byte assembly.

A turn is a header, the escaped text and a trailer:

    system     <<SYS>>\\n text \\n<</SYS>>\\n
    user       [INST] text [/INST]\\n
    assistant  <s> text </s>\\n
    other      <role:name> text </role>\\n

In texts a backslash goes before every backslash and before every control string, so no control string of the template occurs
in a text, and dropping one backslash of each pair gives the text back. For a batch of turns the segment lengths,
their cumulative offsets and the scatter indices come from numpy; headers, texts and trailers are copied into one preallocated buffer,
which is the result's Arrow buffer.

Turns are dealt by conversation and sorted within partitions, then streamed: a conversation is one row, or several
numbered parts if it is longer than PART bytes, so that one of any length takes bounded memory, formatted or read back. The loss mask is the byte ranges of
the assistant's texts.

Cases: a null text is an empty one, and so is a null role; turns with one number are ordered by role and text; repeated
rows are turns of their own; rows without a conversation id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART, SLICE = 4 << 20, 1 << 22
HEADERS = {"system": (b"<<SYS>>\n", b"\n<</SYS>>\n"), "user": (b"[INST] ", b" [/INST]\n"), "assistant": (b"<s> ", b" </s>\n")}
OTHER = b" </role>\n"
_CONTROL = r"(\\|<</?SYS>>|\[/?INST\]|</?s>|<role:|</role>)"
_UNESCAPE = re.compile(rb"\\(.)", re.S)
_ROLE = re.compile(rb"<role:((?:[^\\>]|\\.)*)> ", re.S)


def escaped(texts: pa.Array) -> pa.Array:
    """large_string without nulls, with control strings and backslashes escaped."""
    return pc.replace_substring_regex(texts, _CONTROL, r"\\\1")


def unescaped(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", text) if b"\\" in text else text


def frame(role: str) -> tuple[bytes, bytes]:
    """Header and trailer of a role."""
    if role in HEADERS:
        return HEADERS[role]
    return b"<role:" + re.sub(rb"([\\>])", rb"\\\1", role.encode()) + b"> ", OTHER


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """out[to[i] : to[i] + length[i]] = source[start[i] : ...] for all i, by scatter indices over slices of bounded size."""
    ends = np.cumsum(length)
    a = 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        n = length[a:b]
        if b == a + 1:
            out[to[a] : to[a] + n[0]] = source[start[a] : start[a] + n[0]]
        else:
            run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[a:b], n) + run] = source[np.repeat(start[a:b], n) + run]
        a = b


def assemble(roles: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds of turns, starts of texts, lengths of texts) of formatted turns; texts: large_string without nulls."""
    clean = escaped(texts)
    kinds = list(dict.fromkeys(roles))
    number = {r: k for k, r in enumerate(kinds)}
    which = np.array([number[r] for r in roles], np.int64)
    heads, tails = zip(*[frame(r) for r in kinds], strict=True)
    offsets = np.frombuffer(clean.buffers()[1], np.int64)[clean.offset : clean.offset + len(clean) + 1]
    data = np.frombuffer(clean.buffers()[2] or b"", np.uint8)
    body = np.diff(offsets)
    total = np.zeros(len(roles) + 1, np.int64)
    sizes = []
    for parts in (heads, tails):
        sizes.append((np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])[:-1], np.array([*map(len, parts)])))
    (head, head_at, head_n), (tail, tail_at, tail_n) = sizes
    np.cumsum(head_n[which] + body + tail_n[which], out=total[1:])
    out = np.empty(total[-1], np.uint8)
    begin = total[:-1] + head_n[which]
    _copy(out, total[:-1], head, head_at[which], head_n[which])
    _copy(out, begin, data, offsets[:-1], body)
    _copy(out, begin + body, tail, tail_at[which], tail_n[which])
    return out, total, begin, body


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, n_turns, formatted, mask): mask holds start and length of each range of bytes under the loss, flat. The parts of a conversation
    are numbered from 0; their formatted bytes in that order are the conversation's."""
    kind_of = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = 0

        def emit(rows: pa.Table, first: int) -> pa.RecordBatch:
            ids = rows.column(0).combine_chunks()
            roles = rows.column(1).to_pylist()
            texts = rows.column(2).combine_chunks().cast(pa.large_string())
            out, bounds, begin, body = assemble(roles, texts)
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            heads = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = np.r_[heads[1:], len(codes)]
            parts = np.zeros(len(heads), np.int32)
            parts[0] = first
            loss = np.array([r == "assistant" for r in roles], bool)
            rel = begin - np.repeat(bounds[heads], ends - heads)
            flat = np.stack([rel[loss], body[loss]], 1).reshape(-1)
            per = 2 * np.add.reduceat(loss.astype(np.int64), heads)
            offsets = pa.py_buffer(bounds[np.r_[heads, len(codes)]].astype(np.int64).tobytes())
            blob = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, offsets, pa.py_buffer(out)])
            mask = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), pa.array(flat, pa.int64()))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(heads)), pa.array(parts), pa.array(ends - heads), blob.cast(pa.binary()), mask], ["conv", "part", "n_turns", "formatted", "mask"])

        open_conv: list = []  # the conversation that earlier parts belong to
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = batch.num_rows - at  # rows of PART bytes at most, or one turn
                while n > 1 and _text_bytes(batch, at, n) > PART:
                    n = n // 2
                rows = pa.Table.from_batches([*held, batch.slice(at, n)])
                at += n
                if open_conv and open_conv[0] != rows.column(0)[0].as_py():
                    part, open_conv = 0, []
                ids = rows.column(0).to_pylist()
                cut = len(ids)
                while cut and ids[cut - 1] == ids[-1]:
                    cut -= 1
                if cut:
                    yield emit(rows.slice(0, cut), part)
                    part, open_conv, rows = 0, [], rows.slice(cut)
                if rows.nbytes > PART:
                    yield emit(rows, part)
                    part, open_conv, held = part + 1, [ids[-1]], []
                else:
                    held = rows.combine_chunks().to_batches()
        if held:
            yield emit(pa.Table.from_batches(held), part)

    rows = turns.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(turn_col).alias("turn")
    )
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(run, f"conv {kind_of}, part int, n_turns bigint, formatted binary, mask array<bigint>")


def parsed(data: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of formatted bytes."""
    out, at = [], 0
    known = [(h, t, r.encode()) for r, (h, t) in HEADERS.items()]
    while at < len(data):
        for head, tail, role in known:
            if data.startswith(head, at):
                start = at + len(head)
                break
        else:
            m = _ROLE.match(data, at)
            if not m:
                raise ValueError(f"no turn at byte {at}")
            role, start, tail = unescaped(m[1]), m.end(), OTHER
        end = data.find(tail, start)
        if end < 0:
            raise ValueError(f"an open turn at byte {at}")
        out.append((role, unescaped(data[start:end])))
        at = end + len(tail)
    return out


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row a conversation, from the formatted bytes and their mask alone, in whatever order the rows come; streams the parts of each in the order of
    their numbers."""
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind_of = formatted.schema["conv"].dataType.simpleString()

    def chars(b: bytes) -> int:
        return int(np.count_nonzero((np.frombuffer(b, np.uint8) & 0xC0) != 0x80))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, kind = None, [], None

        def close() -> None:
            conv, n, turns, loss_n, loss, total = state
            out.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), total))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else None) for k, c in enumerate(zip(*out, strict=True))], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in range(batch.num_rows):
                conv, part, data, mask = (batch.column(c)[row].as_py() for c in range(4))
                if part == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(data):
                    state[1] += 1
                    state[2].update(role + b"\n" + text + b"\n")
                for start, n in zip(mask[::2], mask[1::2], strict=True):
                    text = unescaped(data[start : start + n])
                    state[3] += chars(text)
                    state[4].update(text)
                state[5] += chars(data)
            if len(out) > 5000:
                yield batch_of()
                out.clear()
        if state:
            close()
        if out:
            yield batch_of()

    parts = formatted.select("conv", "part", "formatted", "mask").repartition("conv").sortWithinPartitions("conv", "part")
    return parts.mapInArrow(run, f"`{conv_col}` {kind_of}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _text_bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return int(pc.sum(pc.binary_length(batch.column(2).slice(at, n))).as_py() or 0)
