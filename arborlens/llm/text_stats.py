"""Counts of a text that the quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernels as K

#: The counts, in this order, as 64-bit integers.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_digits", "n_marks",
    "n_wide", "n_stops", "n_lines", "n_kinds", "n_wordless",
)


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _MARK, _STOP = _set("#*$%&|<>"), _set("!?\"'()[]{}=+_~^@/\\:;`-"), _set(".,")


def counts(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text of a large_string array without nulls. Nothing of a text is skipped.

    n_upper, n_lower, n_digits: ASCII letters and digits; n_marks: other ASCII marks; n_wide: code points beyond ASCII;
    n_stops: full stops and commas; n_lines: line feeds; n_kinds: distinct words; n_wordless: words without a letter.
    An empty text has zeros.
    """
    data, offsets = K.buffers(texts)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for i, j in K.units(offsets):
        d, starts, s, e, h, doc = K.unit_words(data, offsets, i, j)
        n = j - i
        if not len(d):
            continue
        lead = (d & 0xC0) != 0x80
        space = K.SPACE[d]
        upper, lower, wide = (d >= 65) & (d <= 90), (d >= 97) & (d <= 122), d >= 0xC0
        _, bounds = K.distinct_sets(h, doc, n)
        letters = np.zeros(len(d) + 1, np.int64)
        np.cumsum(upper | lower | wide, out=letters[1:])
        blank = letters[e] == letters[s]
        out[i:j] = np.stack(
            [
                np.bincount(doc, minlength=n), K.per_doc(lead & ~space, starts), K.per_doc(_SYMBOL[d], starts), K.repeated_lines(d, starts),
                K.repeated_words(h, doc, n), K.per_doc(upper, starts), K.per_doc(lower, starts), K.per_doc((d >= 48) & (d <= 57), starts),
                K.per_doc(_MARK[d], starts), K.per_doc(wide, starts), K.per_doc(_STOP[d], starts), K.per_doc(d == 10, starts), np.diff(bounds),
                np.bincount(doc[blank], minlength=n),
            ],
            1,
        )
    return out


def slow_counts(text: str | None) -> dict[str, int]:
    """The counts of the contract by plain Python, for tests."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines, seen, twice = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        twice += x in seen
        seen.add(x)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": twice, "n_repeat_words": len(hit)}
