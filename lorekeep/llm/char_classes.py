"""Classes of characters as the tokenizers library sees them, read from the library itself once per worker.

Its Unicode tables are of another version than Python's, so that newer letters would be cut in other places.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
CODES = 0x110000
#: A character of each class that every Unicode version knows.
STAND_IN = {SPACE: " ", LETTER: "ǀ", NUMBER: "٠", OTHER: "★"}
#: Code points that may be letters, numbers or spaces: the planes in use (no surrogates).
IN_USE = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]


@lru_cache(maxsize=1)
def library_classes() -> np.ndarray:
    """Class of each code point by the library's regular expressions."""
    from tokenizers import Regex, pre_tokenizers

    every, codes = "".join(map(chr, IN_USE)), np.array(IN_USE)
    out = np.full(CODES, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[codes[a:b]] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def as_class(codes: np.ndarray, escape: str = "\\U{:08x}") -> str:
    """A regular expression for one of the code points (sorted, at least one), each written by an escape."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(codes) > 1]))
    ends = np.append(starts[1:], len(codes)) - 1
    return "[" + "".join(f"{escape.format(codes[a])}-{escape.format(codes[b])}" for a, b in zip(starts, ends)) + "]"


@lru_cache(maxsize=1)
def unknown_to_python() -> np.ndarray:
    """Whether Python's tables lack a code point: its normal form and lower case are the library's to say."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(CODES)), dtype=bool, count=CODES)
