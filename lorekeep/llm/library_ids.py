"""Ids as the tokenizers library gives them for a lower-casing vocabulary with word ends, one library call per new word.

The vocabulary's normaliser (NFC, white space, lower case) and its pattern work within words between white
space, so a text's ids are its words' ids joined. A text is normalised once; each word met first then goes through the
library without its normaliser. Texts where that cutting could differ from the library's (special strings, rare
separators) go through it whole.
"""

from __future__ import annotations

import os
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .char_classes import code_points, unknown_to_python
from .wordwise import paused_gc, slices, spread, words_of

#: Words that a worker remembers before it starts anew, and characters of text that it takes together.
REMEMBERED, SLICE = 300_000, 4_000_000
#: White space by Python's or the library's reckoning alone, and the start of special strings.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u180e", "<|")


class LibraryIds:
    def __init__(self, path: str, remembered: int = REMEMBERED, slice_chars: int = SLICE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.remembered, self.slice_chars = Tokenizer.from_file(path), Tokenizer.from_file(path), remembered, slice_chars
        self.normalizer = self.tokenizer.normalizer
        self.words.normalizer = None
        self.known: dict[str, bytes] = {"": b""}

    def _call(self, texts: list[str], whole: bool = False) -> list[bytes]:
        """Ids of normalised words, or of whole texts as they are."""
        tokenizer = self.tokenizer if whole else self.words
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _normal(self, text: str) -> str:
        """As the library has it: texts with characters that Python doesn't know go through its own normaliser."""
        if not text.isascii() and unknown_to_python()[code_points(text)].any():
            return self.normalizer.normalize_str(text)
        return normal(text)

    def _call_joined(self, words: list[str]) -> list[bytes]:
        """As _call, for words of letters alone: each is one word to the library too, so one call serves many."""
        e = self.words.encode(" ".join(words), add_special_tokens=False)
        ids, ends = np.array(e.ids, dtype="<u4").tobytes(), (4 * np.searchsorted(e.word_ids, np.arange(1, len(words) + 1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, new: list[str]) -> None:
        """Marks behind a letter are cut off, so that a word costs one library call however it is followed."""
        known, plain, odd, marked = self.known, set(), set(), []
        for w in new:
            if w.isalpha():
                plain.add(w)
                continue
            core = w.rstrip(string.punctuation)
            if len(core) < len(w) and core and core[-1].isalpha():
                marked.append((w, core, w[len(core) :]))
                for x in marked[-1][1:]:
                    if x not in known:
                        (plain if x.isalpha() else odd).add(x)
            else:
                odd.add(w)
        for some, call in ((list(plain), self._call_joined), (list(odd), self._call)):
            for at in range(0, len(some), 1000):
                known.update(zip(some[at : at + 1000], call(some[at : at + 1000])))
        for w, core, mark in marked:
            known[w] = known[core] + known[mark]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges a, b of texts: their ids joined, and how many each has. A null text is empty."""
        with paused_gc():
            for a, b in slices(texts, self.slice_chars):
                if len(self.known) > self.remembered:
                    self.known = {"": b""}
                part = [t or "" for t in texts[a:b]]
                whole = {i: t for i, t in enumerate(part) if any(map(t.__contains__, WHOLE))}
                words, at, starts = words_of([self._normal(t) if i not in whole else "" for i, t in enumerate(part)])
                values = list(map(self.known.get, words))
                if missing := [i for i, v in enumerate(values) if v is None]:
                    self._learn([words[i] for i in missing])
                    for i in missing:
                        values[i] = self.known[words[i]]
                ids, counts = spread(values, at, starts)
                if whole:
                    pieces = np.split(ids, np.cumsum(counts)[:-1])
                    for i, got in zip(whole, self._call(list(whole.values()), True)):
                        pieces[i] = np.frombuffer(got, dtype="<u4")
                    ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
                yield a, b, ids, counts

    def encode_each(self, texts: list[str | None], end_id: int | None = None) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, with end_id behind them if given."""
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for _, _, ids, counts in self.encode(texts):
            data, ends = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(counts)).tolist()
            yield from (data[x:y] + end for x, y in zip([0, *ends], ends))


def normal(text: str) -> str:
    """NFC and lower case letter by letter (Python alone looks at a sigma's neighbours)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=2)
def library_ids(path: str, remembered: int = REMEMBERED, slice_chars: int = SLICE) -> LibraryIds:
    return LibraryIds(path, remembered, slice_chars)
