"""Packing token sequences into windows by non-negative least squares.

Lengths are counted in a histogram of at most ``window`` bins, whatever the number of documents. Shallow
combinations of two or three lengths that fill the window exactly are enumerated; how often each is used is the
non-negative least squares fit of their sum to the histogram, rounded down; what is left is packed greedily, a
length at a time with its count. All this happens on the histogram. The rows are then numbered within their
length and look up their place, each on its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .library_ids import REMEMBERED, SLICE, library_ids
from .storage import materialise

WINDOW = 4096
#: Lengths, most tokens first, of which triples are enumerated; pairs are enumerated of all.
TRIPLES_OF = 160
SWEEPS = 30
#: Rows of one length that are numbered in one task, about.
BUCKET_ROWS = 20_000


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, slice_chars: int = SLICE) -> DataFrame:
    """Pieces of at most window ids: ``doc_id, start, length, ids_crc32, doc_tokens``. No shuffle.

    A document is cut only where it is longer than the window. A null text is empty and leaves its end id; null ids
    and repeated rows stay as they are; further columns are ignored.
    """

    def run(batches):
        codec = library_ids(tokenizer_path, remembered, slice_chars)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part, rows = batch.slice(first, 500), []
                for key, ids in zip(part.column(0).to_pylist(), codec.encode_each(part.column(1).to_pylist(), end_id)):
                    data = memoryview(ids)
                    n = len(data) // 4
                    rows += [(key, a, min(window, n - a), zlib.crc32(data[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            pa.default_memory_pool().release_unused()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs, and triples of the lengths that hold the most tokens, which fill the window; each in ascending order."""
    there = np.flatnonzero(counts[:window])
    found = {(int(a), int(window - a)) for a in there if a <= window - a and counts[window - a]}
    top = there[np.argsort(-counts[there] * there, kind="stable")][:TRIPLES_OF]
    for i, a in enumerate(top.tolist()):
        for b in top[i:].tolist():
            c = window - a - b
            if c > 0 and counts[c]:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def solve_counts(combos: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Non-negative least squares of the combinations' uses against the histogram, a coordinate at a time."""
    left, uses = counts.astype(float).tolist(), [0.0] * len(combos)
    parts = [[(n, c.count(n)) for n in dict.fromkeys(c)] for c in combos]
    norms = [sum(m * m for _, m in p) for p in parts]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, p in enumerate(parts):
            new = uses[j] + sum(left[n] * m for n, m in p) / norms[j]
            step = (new if new > 0 else 0.0) - uses[j]
            if step:
                uses[j] += step
                moved = max(moved, abs(step))
                for n, m in p:
                    left[n] -= step * m
        if moved < 0.01:
            break
    return np.array(uses)


def plan_windows(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a window, times it is used) for a histogram indexed by length; every counted length is placed.

    Bounded by the window: at most one combination per length and enumerated combination.
    """
    left, plan = counts.astype(np.int64).copy(), []
    left[0] = 0
    if left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(left, window)
    for c, use in zip(combos, solve_counts(combos, left)):
        n = min([int(use + 1e-9), *(int(left[x]) // c.count(x) for x in set(c))])
        if n > 0:
            plan.append((c, n))
            for x in c:
                left[x] -= n
    there = np.flatnonzero(left).tolist()  # ascending
    while there:
        room, chosen, taken = window, [], {}
        at = len(there) - 1
        while at >= 0:
            x = there[at]
            fit = min(int(left[x]) - taken.get(x, 0), room // x)
            if fit > 0:
                chosen += [x] * fit
                taken[x] = taken.get(x, 0) + fit
                room -= fit * x
            at = min(at, int(np.searchsorted(there, room, side="right"))) - 1
        n = min(int(left[x]) // k for x, k in taken.items())
        plan.append((tuple(chosen), n))
        for x, k in taken.items():
            left[x] -= n * k
        there = [x for x in there if left[x]]
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the rows of a length go: keys (length << 40 | first rank) in order, first window, offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for parts, n in plan:
        offset = 0
        for x in parts:
            rows.append((x << 40 | used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    keys, first, offset = (np.array(x, dtype=np.int64) for x in zip(*sorted(rows)))
    return keys, first, offset


def pack(pieces: DataFrame, window: int = WINDOW, length_col: str = "length", tie_cols: tuple[str, ...] = ("doc_id", "start"), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``; a window's pieces lie gapless from 0.

    pieces must give the same rows whenever it is read (a written table). A length may hold any share of all rows:
    it is numbered in buckets by hash. Only the histogram, one number per length up to window, reaches the driver.
    Raises ValueError where a length is null, below 1 or above window. Repeated rows are placed one by one.
    """
    tally = pieces.groupBy(F.col(length_col).cast("long").alias("n")).count().collect()
    if any(r["n"] is None or not 1 <= r["n"] <= window for r in tally):
        raise ValueError("lengths must lie between 1 and the window")
    columns = pieces.columns
    if not tally:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in tally:
        counts[r["n"]] = r["count"]
    keys, first, offset = slots(plan_windows(counts, window))
    buckets = max(64, int(counts.sum()) // bucket_rows)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*tie_cols), F.lit(buckets)))
    before = Window.partitionBy("_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col(length_col).alias("_n"), F.col("_bucket").alias("_b")).count().select("_n", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(length_col, "_bucket").orderBy(*tie_cols)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    joined = ranked.join(starts, (F.col(length_col) == F.col("_n")) & (F.col("_bucket") == F.col("_b"))).select(*columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches):
        for pdf in batches:
            rank = pdf.pop("_rank").to_numpy()
            key = pdf[length_col].to_numpy() << 40 | rank
            at = np.searchsorted(keys, key, side="right") - 1
            yield pdf.assign(sequence_id=first[at] + rank - (keys[at] & ((1 << 40) - 1)), offset=offset[at])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return joined.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, slice_chars: int = SLICE) -> DataFrame:
    """Tokenise, cut and pack docs: the columns of token_pieces, sequence_id and offset."""
    return pack(materialise(token_pieces(docs, tokenizer_path, end_id, window, id_col, text_col, remembered, slice_chars), "pieces"), window)
