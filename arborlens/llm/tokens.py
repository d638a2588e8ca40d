"""Token ids of whole texts with the tokenizers library, through a bounded cache of the pieces between spaces.

The vocabulary's normaliser and splitter never join what a space, tab, line feed or carriage return separates, so a text's ids are
the ids of its pieces in order. A piece of letters is one word to the splitter, and a mark after it another; new words of letters
are encoded together in one call, whose result is cut at the tokens that end words. All other new pieces are encoded one by one.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces that a worker keeps in each of two generations; the longest that it keeps; characters that are encoded together.
CACHE, LONGEST, TOGETHER = 1_000_000, 48, 1 << 18
_MARKS = frozenset(".,!?;:")
_loaded: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # what is used stays, what isn't goes when the younger generation is full
        self.pieces: list[dict[str, bytes]] = [{"": b""}, {}]
        vocabulary = self.tokenizer.get_vocab()
        #: The special strings, in small letters; the library looks for them in texts as they are, before it lowers them.
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes that hold any id.
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._ids([m])[0] for m in _MARKS}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        bounds = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(bounds) != len(words) + 1 or bounds[-1] != 4 * len(ids):
            return self._ids(words)
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _split(self, text: str) -> list[str]:
        """The text's pieces; in small letters, if that is the vocabulary's own lowering (below U+0100, where nothing composes) and makes
        no special string."""
        low = text.isascii()
        if not low:
            try:
                text.encode("latin-1")
                low = True
            except UnicodeEncodeError:
                pass
        if low:
            small = text.lower()
            if not any(x in small for x in self.special):
                text = small
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _learn(self, pieces: list[str], old: dict[str, bytes], young: dict[str, bytes]) -> None:
        """Put the ids of new pieces into the younger generation."""
        marked, rest, wanted, marks = [], [], set(), self.marks
        for p in pieces:
            if p in old:
                young[p] = old[p]
            elif p.isalpha():
                (wanted.add if p.isascii() or p.lower().isalpha() else rest.append)(p)
            elif p[-1] in marks and (word := p[:-1]).isalpha() and (word.isascii() or word.lower().isalpha()):
                marked.append(p)
                if word not in young:
                    if word in old:
                        young[word] = old[word]
                    else:
                        wanted.add(word)
            else:
                rest.append(p)
        words = [*wanted]
        for k in range(0, len(words), 16384):
            part = words[k : k + 16384]
            young.update(zip(part, self._word_ids(part), strict=True))
        for p in marked:
            young[p] = young[p[:-1]] + marks[p[-1]]
        for k in range(0, len(rest), 1024):
            young.update(zip(rest[k : k + 1024], self._ids(rest[k : k + 1024]), strict=True))

    def _together(self, texts: list[str]) -> list[bytes]:
        lists = [self._split(t) for t in texts]
        young, old = self.pieces
        if len(young) > CACHE:
            self.pieces = young, old = [{"": b""}, young]
        new = [p for p in set().union(*lists) if p not in young]
        self._learn(new, old, young)
        get = young.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in lists]
        for p in new:
            if len(p) > LONGEST:
                young.pop(p, None)
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; runs of texts of TOGETHER characters share the work."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)

    def encode(self, text: str) -> bytes:
        return self._together([text])[0]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; one a process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
