"""Token counts by a finite-state transducer compiled from a merge table.

The transducer reads the bytes of normalised text; a word's last byte is a symbol of its own, as in the vocabulary.
Which token ends at a position of a word is settled by what came before: it is the one vocabulary entry there that
merges leave apart from the token that ends where it begins. Later bytes may only choose among the positions at which
some entry can still begin. A state holds the bytes since the last position that all of these have on their way, the
token that ends there, and those on the ways; a transition emits as many tokens as it settles, and the last byte of a
word emits the rest and leads back to the start. States and transitions are added when a text first takes them, and
deterministic from then on.

Texts are read in chunks. A chunk's map takes the entering state to the leaving state and the tokens emitted: bytes up
to its first end of word act on the entering state, whatever follows doesn't depend on it. Maps compose associatively,
so the chunks of a text are combined in logarithmically many rounds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .char_classes import LETTER, NUMBER, OTHER, SPACE, code_points, library_classes, unknown_to_python
from .library_ids import normal
from .wordwise import paused_gc, slices

#: Symbols of a chunk, and characters of text that are read together.
CHUNK, SLICE = 1 << 16, 2_000_000
#: Transitions that are held; then compilation starts anew.
COMPILED = 500_000
#: Runs of so many symbols, or so few runs at a time, are read one symbol at a time.
LONG, FEW = 256, 24
#: Symbols since a settled position, beyond which a state isn't worth its memory: the word is merged instead.
PENDING = 400
START = 0
#: The published cut and normal form of the lower-casing vocabulary (fixed values); other files are refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]


class Table:
    """A hash table from transitions (state * 512 + symbol) to (next state * 65536 + tokens emitted), for many at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and not held yet."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            moved = self.keys[old], self.values[old]
            self.__init__(int(2 * (self.size + len(keys))).bit_length() + 1)
            self.put(*moved)
        self.size += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.values[slot[own]] = keys[own], values[own]
            rest = np.ones(len(keys), dtype=bool)
            rest[own] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)


class Transducer:
    """States and transitions of a merge table's automaton, added as texts take them."""

    def __init__(self, path: str):
        self.merges = m = Merges(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if "pretokenizers" in (spec["pre_tokenizer"] or {}) else None
        if cut != PATTERN or [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] != NORMAL or not m.end:
            raise ValueError(f"{path}: not a vocabulary of lower-case words with ends")
        self._load_tokens()
        self.special = re.compile("|".join(map(re.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None
        self.library = None
        self.path = path
        self.restart()

    def _load_tokens(self) -> None:
        """Of each token: its parts and rank, and which bytes it holds; symbols of one byte have no parts."""
        m = self.merges
        n = len(m.bytes_of)
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        for key, rank in m.ranks.items():
            made, a, b = int(m.made[rank]), key >> 16, key & 0xFFFF
            if self.born[made] >= 0 or max(self.born[a], self.born[b]) >= rank:
                raise ValueError("a token is made in two ways, or before its parts")
            self.born[made], self.left[made], self.right[made] = rank, a, b
        ends = set(m.last.tolist())
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.begun: set[bytes] = set()
        ended = [False] * n
        for t in [*m.first.tolist(), *m.last.tolist(), *m.made.tolist()]:
            last = t
            while self.right[last] >= 0:
                last = self.right[last]
            ended[t] = last in ends
            body = m.bytes_of[t]
            (self.final if ended[t] else self.inner)[body] = t
            self.begun.update(body[:i] for i in range(1, len(body)))
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.length = [len(b) for b in m.bytes_of]

    def apart(self, a: int, b: int) -> bool:
        """Whether merges leave tokens a and b apart: merges are undone from the last; none may have joined what then met."""
        ranks, born = self.merges.ranks, self.born
        before = len(self.merges.made)
        while True:
            rank = ranks.get(a << 16 | b)
            if rank is not None and rank < before:
                return False
            if born[a] > born[b]:
                before, a = born[a], self.right[a]
            elif born[b] < 0:
                return True
            else:
                before, b = born[b] + 1, self.left[b]

    def restart(self) -> None:
        # of a state: the token before, the bytes since, and per position among them its token and how many there are
        self.states: list[tuple[int, bytes, tuple, tuple]] = [(-1, b"", (-1,), (0,))]
        self.number = {self.states[0][:3]: START}
        self.table = Table()
        self.moves: dict[int, int] = {}

    def _last_token(self, before: bytes, symbol: int, tokens: tuple) -> tuple[int, int]:
        """The token that ends with symbol, and the position among those since the last settled one where it begins."""
        ended, text = symbol >= 256, before + bytes([symbol & 255])
        known = self.final if ended else self.inner
        for at in range(max(0, len(text) - self.longest), len(text)):
            t = known.get(text[at:])
            if t is not None and tokens[at] is not None and (tokens[at] < 0 or self.apart(tokens[at], t)):
                return t, at
        raise ValueError("no token ends here")

    def _move(self, key: int) -> int:
        """Compile one transition."""
        before, text, tokens, counts = self.states[key >> 9]
        symbol = key & 511
        token, at = self._last_token(text, symbol, tokens)
        emitted = counts[at] + 1
        if symbol >= 256:
            return START << 16 | emitted
        text, tokens, counts = text + bytes([symbol]), (*tokens, token), (*counts, emitted)
        n = len(text)
        live = [p for p in range(max(0, n - self.longest + 1), n) if tokens[p] is not None and text[p:] in self.begun]
        # live positions' ways back meet where everything before is settled now; way: the positions above that
        settled, way = n, {n}
        for p in live:
            while p != settled:
                if p > settled:
                    way.add(p)
                    p -= self.length[tokens[p]]
                else:
                    settled -= self.length[tokens[settled]]
                    way.add(settled)
        base = counts[settled]
        tokens = tuple([tokens[p] if p in way or p == settled else None for p in range(settled, n + 1)])
        state = (tokens[0], text[settled:], tokens)
        new = self.number.get(state)
        if new is None:
            if n - settled > PENDING:
                raise OverflowError
            new = self.number[state] = len(self.states)
            self.states.append((*state, tuple([c - base for c in counts[settled:]])))
        return new << 16 | base

    def run(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaving states of runs of symbols from given states, and the tokens emitted. Runs end with a word or before its end."""
        states, emitted = states.copy(), np.zeros(len(starts), dtype=np.int64)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        sizes = size[order]
        # longest first: those still going are a head of the order
        going = np.searchsorted(-sizes, -np.arange(1, (int(sizes[0]) if len(sizes) else 0) + 1), side="right")
        step = 0
        at, state, total = starts[order], states[order], emitted[order]
        while step < len(going) and going[step] > FEW and step < LONG:
            n = going[step]
            key = state[:n] << 9 | symbols[at[:n] + step]
            value = self.table.get(key)
            missing = np.flatnonzero(value < 0)
            if len(missing):
                new, back = np.unique(key[missing], return_inverse=True)
                made = np.array([self._compiled(k) for k in new.tolist()])
                fine = made >= 0
                self.table.put(new[fine], made[fine])
                value[missing] = made[back]
                if not fine.all():
                    raise OverflowError
            state[:n], total[:n] = value >> 16, total[:n] + (value & 0xFFFF)
            step += 1
        if step < len(going):
            for i in range(going[step]):
                s, t = int(state[i]), int(total[i])
                for symbol in symbols[at[i] + step : at[i] + sizes[i]].tolist():
                    key = s << 9 | symbol
                    value = self.moves.get(key)
                    if value is None:
                        value = self.moves[key] = self._move(key)
                    s, t = value >> 16, t + (value & 0xFFFF)
                state[i], total[i] = s, t
        states[order], emitted[order] = state, total
        return states, emitted

    def _compiled(self, key: int) -> int:
        try:
            return self._move(key)
        except OverflowError:
            return -1

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of normalised text (a byte, and 256 more for the last of a word), and where each character's begin (one more at the end)."""
        codes = code_points(text)
        kind = library_classes()[codes]
        other, letter, space = kind == OTHER, kind == LETTER, kind == SPACE
        pad = lambda x, n: np.concatenate([x[n:], np.zeros(min(n, len(x)), dtype=x.dtype)])
        begins = np.ones(len(codes), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        mark = (codes == 0x27) & begins
        if mark.any():
            one, two = pad(codes, 1), pad(codes, 2)
            single = mark & np.isin(one, [ord(c) for c in "stmd"])
            double = mark & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            for found, size in ((single, 2), (double, 3)):
                at = np.flatnonzero(found)
                for i in range(1, size):
                    begins[at + i] = False
                behind = at + size
                behind = behind[behind < len(codes)]
                begins[behind] = True
        ends = np.ones(len(codes), dtype=bool)
        ends[:-1] = begins[1:]
        if len(text) and int(codes.max()) < 128:
            keep = ~space
            out = (codes + 256 * ends)[keep].astype(np.int64)
            return out, np.concatenate([[0], np.cumsum(keep)])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        last = np.cumsum(width) - 1
        out = data.astype(np.int64)
        out[last[ends]] += 256
        width_kept = np.where(space, 0, width)
        return out[np.repeat(~space, width)], np.concatenate([[0], np.cumsum(width_kept)])

    def maps(self, symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Maps of all chunks of texts (starts: where each text's symbols begin, one more at the end), as columns.

        head_at, head_end: symbols that act on the entering state; emitted: tokens after these; out: the leaving
        state, or -1 where the head is all there is. A text's first chunk enters at START and has no head. The last
        column is the text of each chunk.
        """
        counts = -(-np.diff(starts) // CHUNK)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = starts[:-1][text] + place * CHUNK
        end = np.minimum(begin + CHUNK, starts[1:][text])
        final = np.flatnonzero(symbols >= 256)
        # words and parts of words: cut at ends of words and of chunks
        mark = np.zeros(len(symbols) + 1, dtype=bool)
        mark[final + 1] = mark[begin] = mark[end] = True
        cuts = np.flatnonzero(mark)
        a, b = cuts[:-1], cuts[1:]
        chunk = np.searchsorted(begin, a, side="right") - 1
        first = np.searchsorted(a, begin)
        whole = np.zeros(len(a), dtype=bool)
        whole[first[place > 0]] = True
        head = whole & ~((a > 0) & (symbols[np.maximum(a - 1, 0)] >= 256))
        own = np.flatnonzero(~head)
        state, emitted = self.run(symbols, a[own], b[own], np.zeros(len(own), dtype=np.int64))
        total = np.zeros(len(text), dtype=np.int64)
        np.add.at(total, chunk[own], emitted)
        head_end = begin.copy()
        head_end[chunk[head]] = b[head]
        out = np.full(len(text), -1, dtype=np.int64)
        out[chunk[own]] = state  # segments ascend, so the last of a chunk stays
        out[(head_end > begin) & (symbols[np.maximum(head_end - 1, 0)] >= 256) & (out < 0)] = START
        return [begin, head_end, total, out, text]

    def compose(self, symbols: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
        """Maps of left chunks followed by right ones, place by place."""
        known = left[3] >= 0
        at, end, emitted, out = left[0].copy(), np.where(known, left[1], right[1]), left[2] + right[2], right[3].copy()
        at_known = np.flatnonzero(known)
        state, more = self.run(symbols, right[0][at_known], right[1][at_known], left[3][at_known])
        emitted[at_known] += more
        through = right[3][at_known] < 0
        out[at_known[through]] = state[through]
        return [at, end, emitted, out, left[4]]

    def reduce(self, symbols: np.ndarray, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts, and the tokens that each one's chunks emit together: neighbours are composed until one map is left."""
        while True:
            text = maps[4]
            n = len(text)
            start = np.searchsorted(text, text)
            place = np.arange(n) - start
            left = np.flatnonzero((place % 2 == 0) & (np.concatenate([text[1:], [-1]]) == text)) if n else np.zeros(0, dtype=np.int64)
            if not len(left):
                return text, maps[2]
            joined = self.compose(symbols, [m[left] for m in maps], [m[left + 1] for m in maps])
            alone = np.setdiff1d(np.arange(n), np.concatenate([left, left + 1]))
            order = np.argsort(np.concatenate([left, alone]), kind="stable")
            maps = [np.concatenate([j, m[alone]])[order] for j, m in zip(joined, maps)]

    def _normal(self, piece: str) -> str:
        """NFC and lower case; pieces with characters that Python doesn't know go through the library's own normaliser."""
        if not piece.isascii() and unknown_to_python()[code_points(piece)].any():
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).normalizer
            return self.library.normalize_str(piece)
        return normal(piece)

    def _merged(self, symbols: np.ndarray) -> int:
        """Tokens of symbols by the merge table itself, for words whose states would grow without bound."""
        ends = np.flatnonzero(symbols >= 256) + 1
        data = (symbols & 255).astype(np.uint8).tobytes()
        return sum(len(x) for x in self.merges.encode([data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])) // 4

    def count(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Tokens of each text, for ranges of texts. A null text has none."""
        for a, b in slices(texts, SLICE):
            if self.table.size + len(self.moves) > COMPILED:
                self.restart()
            counts = np.zeros(b - a, dtype=np.int64)
            pieces, owner = [], []
            for i, text in enumerate(texts[a:b]):
                if not text:
                    continue
                parts = [text]
                if "<|" in text and self.special:
                    counts[i] += len(self.special.findall(text))
                    parts = self.special.split(text)
                for part in parts:
                    pieces.append(self._normal(part))
                    owner.append(i)
            if pieces:
                symbols, begins = self.symbols(" ".join(pieces))
                where = np.cumsum([0, *[len(p) + 1 for p in pieces]])
                where[-1] -= 1
                starts = begins[where]
                owner = np.array(owner)
                try:
                    text, emitted = self.reduce(symbols, self.maps(symbols, starts))
                except OverflowError:
                    # only a word longer than what may stay pending can be the cause
                    ends = np.flatnonzero(symbols >= 256) + 1
                    begins = np.concatenate([[0], ends[:-1]])
                    keep = np.ones(len(symbols), dtype=bool)
                    for x, y in zip(*(v[ends - begins > PENDING].tolist() for v in (begins, ends))):
                        keep[x:y] = False
                        counts[owner[np.searchsorted(starts, x, side="right") - 1]] += self._merged(symbols[x:y])
                    starts = np.concatenate([[0], np.cumsum(keep)])[starts]
                    text, emitted = self.reduce(symbols[keep], self.maps(symbols[keep], starts))
                np.add.at(counts, owner[text], emitted)
            yield counts


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens``. No shuffle.

    A null text is empty: no bytes, no tokens. Ids may be null or repeat; further columns are ignored. Memory is
    bounded by a batch of texts and the table of compiled transitions.
    """

    def run(batches):
        machine = transducer(path)
        with paused_gc():
            for pdf in batches:
                counts = np.concatenate([*machine.count(pdf["text"].tolist()), np.zeros(0, np.int64)])
                yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "n_bytes": pdf["n_bytes"], "n_tokens": counts})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInPandas(run, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
