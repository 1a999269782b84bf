"""Cross-tokenizer alignment by label strings.

Two tokenizers cut the same bytes. Every byte has a label: no token ends there, one of A, one of B, or one of both. A
regular expression scans the string of labels for spans up to each byte where both end; such a span is a group, and its
labels count the group's tokens. Each labelled byte is also the end of one overlap of an A and a B token, a link.

Where a space follows a character that isn't white space both tokenizers cut, so a text is taken apart there and each
distinct part is labelled once per worker. Texts go into blocks that hold their parts, and the links of these; links are
counted over all blocks, and the counts come back to the blocks that hold them. No text is sent anywhere.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .char_classes import SPACE, as_class, library_classes
from .storage import materialise
from .wordwise import paused_gc, slices_of, words_of

#: Characters of a block of texts, and parts and their characters that a worker remembers; then it starts anew.
BLOCK, REMEMBERED, REMEMBERED_CHARS = 2_000_000, 100_000, 4_000_000
#: Parts that are labelled together.
TOGETHER = 4096
#: Bytes of blocks that are written, and later read, at once, about; a block has two million.
STORED_BYTES = 4 << 20
NONE, A_END, B_END, BOTH = range(4)
SPAN = re.compile(rb"[\x01\x02]*\x03")
#: What stands for a space in pieces of B, and its pieces for single bytes (fixed by the file format).
PIECE_SPACE, PIECE_BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Aligned:
    """Texts cut by both tokenizers: ids of all texts, tokens in each group, and each text's share of everything."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray  # tokens of A in each group
    in_b: np.ndarray
    ends: np.ndarray  # where each group ends, in bytes of all texts
    links: np.ndarray  # of every overlap of tokens, the id of B in the upper and that of A in the lower 32 bits
    counts: np.ndarray  # of each text: tokens of A and B, groups, links


def align(sizes: np.ndarray, a: np.ndarray, a_sizes: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, b_counts: np.ndarray) -> Aligned:
    """Align texts of so many bytes each, given all ids, the bytes of each, and how many each text has."""
    if not a_sizes.all() or not b_sizes.all():
        raise ValueError("a token without bytes")
    labels = np.zeros(int(sizes.sum()), dtype=np.uint8)
    labels[np.cumsum(a_sizes) - 1] += A_END
    labels[np.cumsum(b_sizes) - 1] += B_END
    marks = labels.tobytes().translate(None, bytes([NONE]))
    spans = np.cumsum(np.fromiter(map(len, SPAN.findall(marks)), dtype=np.int64))
    kinds = np.frombuffer(marks, dtype=np.uint8)
    of_a, of_b = (kinds & A_END).astype(np.int64), (kinds >> 1).astype(np.int64)
    upto_a, upto_b = np.cumsum(of_a), np.cumsum(of_b)
    at, text_ends = np.flatnonzero(labels), np.cumsum(sizes)
    ends = at[spans - 1] + 1
    each = lambda places: np.diff(np.searchsorted(places, text_ends, side="right"), prepend=0)
    return Aligned(
        a, b, np.diff(upto_a[spans - 1], prepend=0), np.diff(upto_b[spans - 1], prepend=0), ends,
        b[upto_b - of_b].astype(np.int64) << 32 | a[upto_a - of_a], np.stack([a_counts, b_counts, each(ends), each(at + 1)], axis=1),
    )


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation(), self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab(True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = [PIECE_BYTE.fullmatch(p) for p in pieces]
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace(PIECE_SPACE, " ").encode() for p, m in zip(pieces, as_byte)]
        if any(re.search(f"[^{PIECE_SPACE}]{PIECE_SPACE}", p) for p in pieces):
            raise ValueError(f"{path_b}: a piece goes on behind a space")
        self.size_a, self.size_b = (np.fromiter(map(len, x), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # ids as they are spelled within a group and at its end
        self.written = [f"{i}{mark}".encode() for n, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for mark in marks]
        self.lone_space = [self.b.piece_to_id(PIECE_SPACE)]
        space = as_class(np.flatnonzero(library_classes() == SPACE))
        self.no_cut, self.cut = re.compile(f"{space} "), re.compile(f"(?<!{space})(?= )")
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.stats = np.zeros((0, 4), dtype=np.int64)  # as in Aligned.counts; zeros for parts that aren't spelled as they are
        self.links, self.first_link = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.strings: list[bytes] = []

    def aligned(self, data: list[bytes], a: list[list[int]], b: list[list[int]]) -> Aligned:
        """Texts (bytes) with both sides' ids; a text that either side's tokens don't spell has no tokens."""
        flat = lambda ids: np.array([i for some in ids for i in some], dtype=np.int64)
        count = lambda xs: np.fromiter(map(len, xs), dtype=np.int64, count=len(xs))
        sides = [(flat(ids), count(ids), size, spelled) for ids, size, spelled in ((a, self.size_a, self.bytes_a), (b, self.size_b, self.bytes_b))]
        sizes, joined = count(data), b"".join(data)
        if any((_sums(size[ids], n) != sizes).any() or b"".join(map(spelled.__getitem__, ids.tolist())) != joined for ids, n, size, spelled in sides):
            like = [all(b"".join(map(spelled.__getitem__, ids)) == d for ids, spelled in ((x, self.bytes_a), (y, self.bytes_b))) for d, x, y in zip(data, a, b)]
            return self.aligned(*([v if good else type(v)() for v, good in zip(xs, like)] for xs in (data, a, b)))
        return align(sizes, *(v for ids, n, size, _ in sides for v in (ids, size[ids], n)))

    def spelled(self, x: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3;`` of each text: the ids of each group."""
        end_a, end_b = np.cumsum(x.in_a), np.cumsum(x.in_b)
        last_a, last_b = np.zeros(len(x.a), dtype=np.int64), np.zeros(len(x.b), dtype=np.int64)
        last_a[end_a - 1] = last_b[end_b - 1] = 1
        out = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        # a token of A follows the tokens of B of the groups before its own, one of B the tokens of A up to its own
        out[np.arange(len(x.a)) + np.repeat(end_b - x.in_b, x.in_a)] = 2 * x.a + last_a
        out[np.arange(len(x.b)) + np.repeat(end_a, x.in_b)] = 2 * (x.b + len(self.bytes_a)) + last_b
        pieces = list(map(self.written.__getitem__, out.tolist()))
        ends = np.cumsum(x.counts[:, 0] + x.counts[:, 1]).tolist()
        return [b"".join(pieces[i:j]) for i, j in zip([0, *ends], ends)]

    def whole(self, text: str | None) -> Aligned:
        """A text's alignment, the text as one."""
        if not text:
            return self.aligned([b""], [[]], [[]])
        return self.aligned([(" " + text).encode()], [self.a.encode(" " + text, add_special_tokens=False).ids], [self.b.encode(text)])

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of parts (each without the space before it); new ones are labelled."""
        numbers = list(map(self.number.get, parts))
        missing = [i for i, n in enumerate(numbers) if n is None]
        if missing:
            new = list(dict.fromkeys(parts[i] for i in missing))
            self.number.update(zip(new, range(len(self.strings), len(self.strings) + len(new))))
            self.chars += sum(map(len, new))
            stats, links = [self.stats], [self.links]
            for some in (new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)):
                spaced = [" " + p for p in some]
                in_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
                in_b = [ids if p else self.lone_space for p, ids in zip(some, self.b.encode(some, num_threads=1))]
                x = self.aligned([p.encode() for p in spaced], in_a, in_b)
                stats.append(x.counts)
                links.append(x.links)
                self.strings += self.spelled(x)
            self.stats, self.links = np.concatenate(stats), np.concatenate(links)
            self.first_link = np.concatenate([[0], np.cumsum(self.stats[:, 3])])
            for i in missing:
                numbers[i] = self.number[parts[i]]
        return np.array(numbers, dtype=np.int64)

    def block(self, texts: list[str | None]) -> dict:
        """What a block holds of texts: per text its counts and digest, its parts, and the links of these."""
        if len(self.strings) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._clear()
        texts = [t or "" for t in texts]
        apart = [" " in t and (t[0] == " " or self.no_cut.search(t) is not None) for t in texts]
        words, at, starts = words_of(["" if x else t for x, t in zip(apart, texts)], " ")
        at, starts = self._numbers(words)[at], starts.tolist()
        of = [at[a:b] for a, b in zip(starts, starts[1:])]
        for i, t in enumerate(texts):
            if not t:
                of[i] = of[i][:0]
            elif apart[i]:
                of[i] = self._numbers([p[1:] for p in self.cut.split(" " + t) if p])
        unlike = self.stats[:, 3] == 0
        counts, digests, own, parts_of_own = np.zeros((len(texts), 4), dtype=np.int64), [], [], len(self.strings)
        for i, parts in enumerate(of):
            if unlike[parts].any():
                x = self.whole(texts[i])
                counts[i], spelled, of[i] = x.counts[0], self.spelled(x)[0], parts[:0]
                if len(x.links):
                    of[i] = np.array([parts_of_own + len(own)])
                    own.append(x.links)
            else:
                counts[i], spelled = self.stats[parts].sum(axis=0), b"".join(map(self.strings.__getitem__, parts.tolist()))
            digests.append(hashlib.sha256(spelled[:-1]).hexdigest() if spelled else "")
        every = np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64)
        parts, place, times = np.unique(every, return_inverse=True, return_counts=True)
        known = parts[parts < parts_of_own]
        sizes = np.concatenate([self.stats[known, 3], np.fromiter(map(len, own), dtype=np.int64, count=len(own))])
        from_ = np.repeat(self.first_link[known] - np.concatenate([[0], np.cumsum(self.stats[known, 3])[:-1]])[: len(known)], self.stats[known, 3])
        flat = np.concatenate([self.links[from_ + np.arange(len(from_))], *own])
        pairs, link = np.unique(flat, return_inverse=True)
        held = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(held, link, np.repeat(times, sizes))
        return {
            "counts": counts.astype("<i8").tobytes(), "digests": digests, "places": _packed(place), "sizes": np.fromiter(map(len, of), dtype="<i8", count=len(of)).tobytes(),
            "part_sizes": _packed(sizes), "part_links": _packed(link), "pairs": pairs, "held": held,
        }


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i4")


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


BLOCK_SCHEMA = "block long, ids array<long>, counts binary, digests array<string>, places binary, sizes binary, part_sizes binary, part_links binary, pairs array<long>, held array<long>"
BLOCK_TYPES = pa.schema({"block": pa.int64(), "ids": pa.list_(pa.int64()), "counts": pa.binary(), "digests": pa.list_(pa.string()), "places": pa.binary(), "sizes": pa.binary(), "part_sizes": pa.binary(), "part_links": pa.binary(), "pairs": pa.list_(pa.int64()), "held": pa.list_(pa.int64())})


def _blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """One row per block of texts; what it holds is bounded by BLOCK and the longest text."""

    def run(batches):
        codec, first, n = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        with paused_gc():
            for batch in batches:  # a block's texts at a time become strings, never a batch's
                for a, b in slices_of(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist(), BLOCK):
                    some = batch.slice(a, b - a)
                    row = {"block": first + n, "ids": some["id"].to_pylist(), **codec.block(some["text"].to_pylist())}
                    n += 1
                    yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, BLOCK_TYPES)
                    del row, some
                    pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    running, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return running[ends] - running[ends - sizes]


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A reads a space and the text, B the text, before which it puts a space itself; special strings are plain text. A
    link's count is how many links of all documents hold the same two ids; n_best are a document's links whose count
    is the highest of their B id, ties included. Texts that are null or empty, or that the tokens of A or B don't
    spell, have no tokens: zeros and ''. Ids may be null or repeat; further columns are ignored; an empty table gives
    an empty result.
    """
    blocks = materialise(_blocks(docs, path_a, path_b, id_col, text_col), "aligned-blocks", STORED_BYTES)
    counted = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    counted = materialise(counted, "link-counts")
    # one row for each id of B
    highest = counted.groupBy(F.shiftright("pair", 32).alias("in_b")).agg(F.max("n").alias("highest"))
    judged = counted.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("in_b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    back = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair")).join(judged.hint("merge"), "pair").select("of", "at", "n", "best")

    def total(held: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in held.itertuples():  # one row
            n, best = np.zeros(len(links), dtype=np.int64), np.zeros(len(links), dtype=np.int64)
            n[links["at"]], best[links["at"]] = links["n"], links["best"]
            link, sizes, places = _unpacked(r.part_links), _unpacked(r.part_sizes).astype(np.int64), _unpacked(r.places)
            docs_sizes, counts = np.frombuffer(r.sizes, "<i8"), np.frombuffer(r.counts, "<i8").reshape(-1, 4)
            of = lambda values: _sums(_sums(values[link], sizes)[places], docs_sizes)
            out.append(pd.DataFrame({
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in r.ids], dtype="Int64"), "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 3],
                "n_best": of(best), "count_sum": of(n), "groups_sha256": list(r.digests),
            }))
        return pd.concat(out) if out else pd.DataFrame({})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("pairs", "held").groupBy("block").cogroup(back.groupBy("of")).applyInPandas(total, schema)


def token_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of each text: ``doc_id, place, start, end, a, b``: bytes of a space and the text, and both sides' ids.

    Documents without tokens have no row. No shuffle.
    """

    def run(batches):
        codec = aligner(path_a, path_b)
        for pdf in batches:
            for key, text in zip(pdf["id"].astype("Int64").tolist(), pdf["text"].tolist()):
                x = codec.whole(text)
                ends, in_a, in_b, a, b = x.ends, np.cumsum(x.in_a), np.cumsum(x.in_b), x.a.tolist(), x.b.tolist()
                if not len(ends):
                    continue
                yield pd.DataFrame({
                    "doc_id": pd.array([key] * len(ends), dtype="Int64"), "place": np.arange(len(ends)), "start": np.concatenate([[0], ends[:-1]]), "end": ends,
                    "a": [a[i:j] for i, j in zip([0, *in_a.tolist()], in_a.tolist())], "b": [b[i:j] for i, j in zip([0, *in_b.tolist()], in_b.tolist())],
                })

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, place long, start long, end long, a array<long>, b array<long>")
