"""BPE encoding and decoding: a segment tree over adjacent pair ranks.

Every leaf of the tree stands for a symbol and its right neighbour and holds ``rank * width + position`` of
that pair, or INF where no merge exists. An inner node holds the minimum of its children, so the root is the
leftmost pair of the lowest rank. A merge changes three leaves: the pair itself, the one before it, and the
one that vanished; each is a point update along a path to the root, until the root is INF.

Many short words are merged in lockstep, one row of a numpy tree for each; a long one has a tree of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .char_classes import CODES, IN_USE, LETTER, NUMBER, OTHER, SPACE, STAND_IN, as_class, library_classes
from .wordwise import paused_gc, slices, spread, words_of

INF = np.int64(1) << 60
#: Longest word that is merged in lockstep; above it a tree of its own is faster.
LOCKSTEP = 64
#: Words that a worker remembers; then it starts anew.
REMEMBERED = 300_000
#: Characters of text that are encoded together; their ids and decoded texts are held at once.
SLICE = 3_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge table of a tokenizer file, ready for lookups by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        self.ranks = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            self.bytes_of[i] = bytes(byte_of[c] for c in body) if all(c in byte_of for c in body) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, INF where there is no merge or either side is missing (-1)."""
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], INF)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers. Empty words have none."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = 2
        while width <= LOCKSTEP:
            low = 0 if width == 2 else width // 2
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            step = max(1, 250_000 // width)
            for some in (at[i : i + step] for i in range(0, len(at), step)):
                for i, ids in zip(some.tolist(), self._lockstep([words[i] for i in some.tolist()], sizes[some], width)):
                    out[i] = ids
            width *= 2
        for i in np.flatnonzero(sizes > LOCKSTEP):
            out[i] = self._alone(words[i])
        return out

    def _lockstep(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n, spot = len(words), np.arange(width)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        symbol = self.first[flat]
        rows = np.arange(n)
        symbol[rows, sizes - 1] = self.last[flat[rows, sizes - 1]]
        symbol[spot >= sizes[:, None]] = -1
        # one cell more on either side stands for "no neighbour"
        sym = np.full((n, width + 2), -1, dtype=np.int64)
        sym[:, 1:-1] = symbol
        after = np.minimum(np.arange(1, width + 3), width + 1) * np.ones((n, 1), dtype=np.int64)
        before = np.maximum(np.arange(-1, width + 1), 0) * np.ones((n, 1), dtype=np.int64)
        tree = np.full((n, 2 * width), INF, dtype=np.int64)
        rank = self.rank(sym[:, 1 : width + 1].ravel(), sym[:, 2 : width + 2].ravel()).reshape(n, width)
        tree[:, width:] = np.where(rank < INF, rank * width + spot, INF)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            best = tree[live, 1]
            at, made = best % width + 1, self.made[best // width]
            gone = after[live, at]
            follow = after[live, gone]
            sym[live, at], sym[live, gone] = made, -1
            after[live, at], before[live, follow] = follow, at
            left = before[live, at]
            for spot_at, a, b in ((left, sym[live, left], made), (at, made, sym[live, follow]), (gone, None, None)):
                leaf = np.maximum(spot_at - 1, 0)
                if a is None:
                    value = np.full(len(live), INF)
                else:
                    r = self.rank(a, b)
                    value = np.where(r < INF, r * width + leaf, INF)
                    value = np.where(spot_at == 0, tree[live, width + leaf], value)
                node = width + leaf
                tree[live, node] = value
                while width > 1 and node[0] > 1:
                    node = node >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            live = live[tree[live, 1] < INF]
        kept = sym[:, 1:-1] >= 0
        flat_ids = sym[:, 1:-1][kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends)]

    def _alone(self, word: bytes) -> bytes:
        n, ranks, made = len(word), self.ranks, self.made
        sym = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        width = 1 << max(1, (n - 1).bit_length())
        inf = int(INF)

        def value(i: int, j: int) -> int:
            r = ranks.get(sym[i] << 16 | sym[j]) if i >= 0 and j < n else None
            return inf if r is None else r * width + i

        tree = [inf] * (2 * width)
        tree[width : width + n - 1] = [value(i, i + 1) for i in range(n - 1)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def put(i: int, v: int) -> None:
            i += width
            tree[i] = v
            while i > 1:
                i >>= 1
                v = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == v:
                    break
                tree[i] = v

        while tree[1] < inf:
            r, at = divmod(tree[1], width)
            gone = after[at]
            sym[at], sym[gone] = int(made[r]), -1
            after[at] = follow = after[gone]
            if follow < n:
                before[follow] = at
            put(gone, inf)
            put(at, value(at, follow))
            if before[at] >= 0:
                put(before[at], value(before[at], at))
        return np.array([s for s in sym if s >= 0], dtype="<u4").tobytes()


#: The published pattern that cuts text before byte-level merges (fixed value).
CUT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Where two white spaces meet, or special strings may start, cutting at single spaces first isn't safe (RE2).
UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|<\|"


@lru_cache(maxsize=1)
def odd_characters() -> re.Pattern:
    """One of the odd codes."""
    return re.compile(as_class(odd_codes()) if len(odd_codes()) else r"(?!)")


@lru_cache(maxsize=1)
def not_at_spaces() -> str:
    """Where a text can't be cut at spaces first, or holds an odd code (RE2)."""
    return UNSAFE + ("|" + as_class(odd_codes(), "\\x{{{:x}}}") if len(odd_codes()) else "")


@lru_cache(maxsize=1)
def odd_codes() -> np.ndarray:
    """Characters that are letters, numbers or spaces to the pattern here or to the library's, but not to both."""
    every, codes, here = "".join(map(chr, IN_USE)), np.array(IN_USE), np.full(CODES, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            here[codes[m.start() : m.end()]] = kind
    return np.flatnonzero(here != library_classes())


class ByteCodec:
    """Encodes and decodes whole texts; cuts at spaces first, so that a chunk met before costs one lookup."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.is_special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None

    def _values(self, chunks: list[str], words: bool = False) -> list[bytes]:
        """Ids of each chunk; new ones are cut by the pattern unless they are words of it, and new words merged."""
        values = list(map(self.chunks.get, chunks))
        if missing := [i for i, v in enumerate(values) if v is None]:
            cut = [(chunks[i],) if words and chunks[i] else CUT.findall(chunks[i]) for i in missing]
            known = self.words
            new = list({w for ws in cut for w in ws} - known.keys())
            known.update(zip(new, self.merges.encode([w.encode() for w in new])))
            for i, ws in zip(missing, cut):
                values[i] = self.chunks[chunks[i]] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
        return values

    def _cut(self, text: str) -> list[str]:
        """Words of the pattern; where its classes of characters aren't the library's, stand-ins are cut in their places."""
        if not odd_characters().search(text):
            return CUT.findall(text)
        kinds = library_classes()
        shown = odd_characters().sub(lambda m: STAND_IN[int(kinds[ord(m[0])])], text)
        return [text[m.start() : m.end()] for m in CUT.finditer(shown)]

    def _whole(self, text: str) -> bytes:
        """A text that can't be cut at spaces first: at its special strings, and then by the pattern at once."""
        parts = self.is_special.split(text) if self.is_special else [text]
        special = {k: np.uint32(v).tobytes() for k, v in self.merges.special.items()}
        return b"".join([special[p] if i % 2 else b"".join(self._values(self._cut(p), True)) for i, p in enumerate(parts)])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges a, b of texts: their ids joined, and how many each has. A null text is empty."""
        with paused_gc():
            for a, b in slices(texts, SLICE):
                if len(self.chunks) > REMEMBERED or len(self.words) > REMEMBERED:
                    self.chunks, self.words = {"": b""}, {}
                part = [t or "" for t in texts[a:b]]
                unsafe = pc.match_substring_regex(pa.array(part, type=pa.large_string()), not_at_spaces()).to_numpy(zero_copy_only=False)
                words, at, starts = words_of(["" if u else t for t, u in zip(part, unsafe.tolist())], " ")
                heads = [words[i] for i in at[starts[:-1]].tolist()]  # a text's first chunk has no space before it
                at[starts[:-1]] = len(words) + np.arange(len(heads))
                ids, counts = spread(self._values([" " + w for w in words]) + self._values(heads), at, starts)
                if unsafe.any():
                    pieces = np.split(ids, np.cumsum(counts)[:-1])
                    for i in np.flatnonzero(unsafe).tolist():
                        pieces[i] = np.frombuffer(self._whole(part[i]), dtype="<u4")
                    ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
                yield a, b, ids, counts

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.merges.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def byte_codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``id_col``, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``, ``decoded``.

    A null text counts as empty and has no ids; ids may be null or repeat; further columns are ignored.
    No shuffle: every task keeps its own table of words seen.
    """

    def run(batches):
        import pandas as pd

        codec = byte_codec(path)
        for pdf in batches:
            keys = pdf["id"].astype("Int64")
            for a, b, ids, counts in codec.encode(pdf["text"].tolist()):
                each = np.split(ids, np.cumsum(counts)[:-1])
                yield pd.DataFrame({"id": keys.iloc[a:b], "ids": [x.astype("<u4").tobytes() for x in each], "n_tokens": counts, "decoded": [codec.decode(x) for x in each]})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "id long, ids binary, n_tokens long, decoded string").withColumnRenamed("id", id_col)
