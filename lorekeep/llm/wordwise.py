"""Work on whole texts done once per distinct word of a batch, then dealt back to every place where the word stands."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are taken together; one longer text is taken alone.
BATCH_CHARS = 16_000_000


@contextmanager
def paused_gc() -> Iterator[None]:
    """Without the cycle collector, as it was before afterwards: walking large tables of plain values costs more than the work."""
    was = gc.isenabled()
    gc.collect()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(texts: list, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit characters, or one text."""
    return slices_of([len(t or "") for t in texts], limit)


def slices_of(lengths: list[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """As slices, of texts of these lengths."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n + 1 > limit:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def words_of(texts: list[str], separator: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and the places where each text starts (one more at the end).

    separator: None cuts at any white space; words may then be empty at a text's ends.
    """
    column = pa.array(texts, type=pa.large_string())
    lists = pc.utf8_split_whitespace(column) if separator is None else pc.split_pattern(column, separator)
    coded = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts - starts[0]


def spread(values: list[bytes], at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, joined, and their number per text; values: the ids of each distinct word."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    flat, first = np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(sizes) - sizes
    each = sizes[at]
    ends = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])]
    bounds = ends[starts]
    return ids, np.diff(bounds)
