"""SimHash near-dedup by anchor-point covering.

A text's fingerprint has a bit for each place in which over half of its shingles' 64-bit hashes have one. Fingerprints
link where few bits differ. Equal ones are one point; points are cut into blocks of bits, and each block has a covering
code: a Hamming code over most of its bits and the remaining bits as they are, so that every point lies within RADIUS
of an anchor. A block's threshold t is such that two linked points differ by no more than t bits in one block at least.
A point lives at its nearest anchor and is replicated to every anchor within RADIUS + t; of two linked points one's home
is then among the anchors of the other. Points that live at an anchor are compared with all that come there.

Anchors where more meet than a task should compare are put off: their points are dealt to pairs of blocks that meet
in tasks of their own. Of many links at an anchor a spanning forest is kept, so no component is lost, and no task emits
more rows than in proportion to those it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .storage import materialise
from .wordwise import slices

SEED, BITS, RADIUS = 42, 64, 1
#: Characters of text that are taken together, and shingles whose bits are counted at once.
SLICE, COUNTED = 2_000_000, 1 << 16
#: Rows and comparisons of an anchor that one task takes; comparisons that are made at once.
ROWS, COMPARISONS, AT_ONCE = 1 << 16, 1 << 26, 1 << 21
#: Comparisons of an anchor up to which many anchors are taken together.
SMALL = 2048
#: Points of a block that live at an anchor that was put off, and of a block that comes there.
HOMES, GUESTS = 4096, 16384
#: Links for each row of a node from which a spanning forest is taken.
DENSE = 4
#: Anchors that may be broadcast (16 bytes each); more are joined.
BROADCAST_ANCHORS = 200_000


def shingle_digests(text: str, k: int) -> bytes:
    """8 bytes (XXH64, seed 42) of every k-word shingle of a text, repeats included; of fewer words one, of none nothing."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    shingles = [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))


def fingerprint(text: str | None, k: int) -> bytes:
    """The fingerprint's 8 bytes, highest first; a text without words has zeros."""
    rows = np.frombuffer(shingle_digests(text or "", k), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(rows), COUNTED):
        ones += np.unpackbits(rows[at : at + COUNTED], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, point`` for each row of docs: the fingerprint as a signed long."""

    def run(batches):
        for pdf in batches:
            ids, texts = pdf["id"].astype("Int64"), pdf["text"].tolist()
            for a, b in slices(texts, SLICE):
                points = np.frombuffer(b"".join([fingerprint(t, k) for t in texts[a:b]]), dtype=">i8").astype(np.int64)
                yield pd.DataFrame({"doc_id": ids.iloc[a:b], "point": points})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, point long")


class Covering:
    """The anchors of one block of bits: a Hamming code over the longest 2^r - 1 of them, all words over the rest."""

    def __init__(self, number: int, shift: int, width: int, threshold: int):
        self.number, self.shift, self.width = number, shift, width
        self.checks = (width + 1).bit_length() - 1
        self.coded = (1 << self.checks) - 1
        # flips that lead to anchors within the radius of RADIUS + threshold, by syndrome: of coded bits, then of the others
        reach, rest = RADIUS + threshold, width - self.coded
        some = [(m, m.bit_count()) for m in self._masks(rest, reach)]
        by_syndrome: list[list[int]] = [[] for _ in range(self.coded + 1)]
        for m in self._masks(self.coded, reach):
            by_syndrome[self._syndrome_of(m)] += [m | r << self.coded for r, size in some if m.bit_count() + size <= reach]
        self.flips = [np.array(sorted(f, key=lambda m: (m.bit_count(), m)), dtype=np.uint64) for f in by_syndrome]

    @staticmethod
    def _masks(width: int, most: int) -> list[int]:
        """Masks of up to so many of width bits."""
        masks, last = [0], [0]
        for _ in range(min(most, width)):
            last = sorted({m | 1 << i for m in last for i in range(width) if not m >> i & 1})
            masks += last
        return masks

    def _syndrome_of(self, mask: int) -> int:
        out = 0
        for i in range(self.coded):
            out ^= i + 1 if mask >> i & 1 else 0
        return out

    def word(self, points: np.ndarray) -> np.ndarray:
        return (points >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        """The place (from 1) of the coded bit whose flip gives a code word, 0 for code words."""
        out = np.zeros(len(words), dtype=np.int64)
        for i in range(self.checks):
            mask = sum(1 << p for p in range(self.coded) if (p + 1) >> i & 1)
            out |= (np.bitwise_count(words & np.uint64(mask)).astype(np.int64) & 1) << i
        return out

    def meet(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (anchor, point's index, whether it lives there) for all anchors in reach. The first flip leads home."""
        words = self.word(points)
        syndromes = self.syndromes(words)
        anchors, at, home = [], [], []
        for s in np.unique(syndromes).tolist():
            here, flips = np.flatnonzero(syndromes == s), self.flips[s]
            anchors.append((words[here][:, None] ^ flips).ravel())
            at.append(np.repeat(here, len(flips)))
            home.append(np.tile(np.arange(len(flips)) == 0, len(here)))
        tagged = np.concatenate(anchors) | np.uint64(self.number << 56)
        return tagged.astype(np.int64), np.concatenate(at), np.concatenate(home)


def coverings(distance: int, blocks: int) -> list[Covering]:
    """Blocks of bits with thresholds that add up to distance - blocks + 1: more in every block would be more than distance."""
    if not 2 <= blocks <= 8 or distance < 0:
        raise ValueError("from 2 to 8 blocks, and a distance of at least 0")
    if blocks > distance + 1:
        blocks = max(2, distance + 1)
    left, out, shift = max(0, distance - blocks + 1), [], 0
    for i in range(blocks):
        width = (BITS - shift) // (blocks - i)
        threshold = left // (blocks - i) + (1 if left % (blocks - i) else 0)
        out.append(Covering(i + 1, shift, width, threshold))
        left, shift = left - threshold, shift + width
    return out


def meetings(points: DataFrame, codes: list[Covering]) -> DataFrame:
    """``anchor, point, home`` for each of points (``point``) and every anchor that it comes to."""

    def run(batches):
        for pdf in batches:
            values = pdf["point"].to_numpy()
            for code in codes:
                anchor, at, home = code.meet(values.view(np.uint64))
                yield pd.DataFrame({"anchor": anchor, "point": values[at], "home": home})

    return points.select("point").mapInPandas(run, "anchor long, point long, home boolean")


def _nodes(batches, most: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[tuple[int, int, int]]]]:
    """Whole nodes of a stream sorted by anchor: rows, where each node begins (one more at the end), and anchors put off.

    An anchor put off comes with its homes and rows; of a node above most rows none is held.
    """
    held, over = None, None
    for pdf in batches:
        late = []
        if over is not None:
            same = pdf["anchor"].to_numpy() == over[0]
            over = (over[0], over[1] + int(pdf["home"].to_numpy()[same].sum()), over[2] + int(same.sum()))
            if same.all():
                continue
            late, over, pdf = [over], None, pdf[~same].reset_index(drop=True)
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        anchor = pdf["anchor"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(1, int)
        held = pdf.iloc[starts[-1] :].reset_index(drop=True)
        if len(held) > most:
            over, held = (int(held["anchor"].iloc[0]), int(held["home"].sum()), len(held)), None
        yield pdf.iloc[: starts[-1]], starts, late
    if held is not None and len(held):
        yield held, np.array([0, len(held)]), []
    if over is not None:
        yield pd.DataFrame({"anchor": [], "point": [], "home": []}), np.zeros(1, int), [over]


def _spanning(links: np.ndarray) -> np.ndarray:
    """Of links (two columns of points), those of a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for i, (x, y) in enumerate(links.tolist()):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            kept.append(i)
    return links[kept]


def _close(homes: np.ndarray, guests: np.ndarray, distance: int) -> np.ndarray:
    """Rows (home, guest) that span all links between points that live at an anchor and points that come there.

    Guests stand in groups of those already joined, so that a home asks each group once; the first homes are taken few
    at a time, until groups have formed.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept, at, step, first = [], 0, 1, np.arange(len(guests))
    while at < len(homes) and len(guests):
        some = homes[at : at + step]
        apart = np.bitwise_count(some[:, None].view(np.uint64) ^ guests.view(np.uint64))
        near = (apart <= distance) & (apart > 0)
        asked = near if len(first) == len(guests) else np.logical_or.reduceat(near, first, axis=1)
        before = len(kept)
        ends = np.append(first[1:], len(guests))
        for x, g in zip(*(v.tolist() for v in np.nonzero(asked))):
            home, start = int(some[x]), int(first[g])
            a, b = find(home), find(int(guests[start]))
            if a != b:
                root[a] = b
                kept.append((home, int(guests[start + int(near[x, start : ends[g]].argmax())])))
        if len(kept) > before:
            groups = np.array([find(g) for g in guests.tolist()])
            order = np.argsort(groups, kind="stable")
            guests, groups = guests[order], groups[order]
            first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        at, step = at + step, min(2 * step, max(1, AT_ONCE // len(guests)))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def near_points(met: DataFrame, distance: int) -> DataFrame:
    """``a, b, homes, rows`` : links within anchors (homes null), and anchors put off (in a; b null)."""

    def run(batches):
        for pdf, starts, late in _nodes(batches, ROWS):
            point, home, anchor = pdf["point"].to_numpy(dtype=np.int64), pdf["home"].to_numpy(dtype=bool), pdf["anchor"].to_numpy(dtype=np.int64)
            sizes = np.diff(starts)
            lives = np.add.reduceat(home.astype(np.int64), starts[:-1]) if len(sizes) else np.zeros(0, np.int64)
            put_off = np.flatnonzero(lives * sizes > COMPARISONS)
            late = late + list(zip(anchor[starts[:-1][put_off]].tolist(), lives[put_off].tolist(), sizes[put_off].tolist()))
            links = []
            for n in np.flatnonzero((lives * sizes > SMALL) & (lives * sizes <= COMPARISONS)).tolist():
                a, b = starts[n], starts[n + 1]
                links.append(_close(point[a:b][home[a:b]], point[a:b], distance))
            small = np.flatnonzero((lives > 0) & (sizes > 1) & (lives * sizes <= SMALL))
            # small nodes together: every point that lives there against all rows of its node
            ends = np.cumsum(lives[small] * sizes[small])
            first = 0
            while first < len(small):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
                some = small[first:last]
                rows = np.concatenate([np.arange(starts[n], starts[n + 1]) for n in some.tolist()]) if len(some) else np.zeros(0, int)
                node = np.repeat(np.arange(len(some)), sizes[some])
                of = np.flatnonzero(home[rows])
                width = sizes[some][node[of]]
                x = np.repeat(rows[of], width)
                y = np.repeat(starts[some][node[of]], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                apart = np.bitwise_count(point[x].view(np.uint64) ^ point[y].view(np.uint64))
                good = (apart <= distance) & (apart > 0)
                found = np.stack([point[x[good]], point[y[good]]], axis=1)
                links.append(_spanning(found) if len(found) > DENSE * len(rows) else found)
                first = last
            found = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
            if len(found):
                yield pd.DataFrame({"a": found.min(axis=1), "b": found.max(axis=1), "homes": pd.Series(pd.NA, index=range(len(found)), dtype="Int64"), "rows": pd.Series(pd.NA, index=range(len(found)), dtype="Int64")})
            if late:
                yield pd.DataFrame({"a": [x[0] for x in late], "b": pd.array([None] * len(late), dtype="Int64"), "homes": [x[1] for x in late], "rows": [x[2] for x in late]})

    ordered = met.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInPandas(run, "a long, b long, homes long, rows long")


def near_points_dealt(met: DataFrame, late: DataFrame, distance: int) -> DataFrame:
    """``a, b``: links within the anchors of late (``anchor, homes, rows``), block against block."""
    parts = late.select("anchor", F.ceil(F.col("homes") / HOMES).alias("home_blocks"), F.ceil(F.col("rows") / GUESTS).alias("guest_blocks"))
    here = met.join(F.broadcast(parts) if late.count() <= BROADCAST_ANCHORS else parts, "anchor")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("point"), F.col(n))
    guests = here.select("anchor", "point", F.lit(False).alias("home"), F.explode(every("home_blocks")).alias("i"), own("guest_blocks").alias("j"))
    homes = here.where("home").select("anchor", "point", F.lit(True).alias("home"), own("home_blocks").alias("i"), F.explode(every("guest_blocks")).alias("j"))
    dealt = homes.unionByName(guests).select(F.xxhash64("anchor", "i", "j").alias("anchor"), "point", "home")

    def run(batches):
        held = []  # batches of one pair of blocks
        for pdf, last in _ahead(batches):
            anchor = pdf["anchor"].to_numpy()
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1]["anchor"].iloc[0] != anchor[a]:
                    yield from compared(pd.concat(held))
                    held = []
                held.append(pdf.iloc[a:b])
            if last and held:
                yield from compared(pd.concat(held))

    def compared(pdf):
        point, home = pdf["point"].to_numpy(), pdf["home"].to_numpy(dtype=bool)
        links = _close(point[home], point[~home], distance)
        if len(links):
            yield pd.DataFrame({"a": links.min(axis=1), "b": links.max(axis=1)})

    return dealt.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(run, "a long, b long")


def _ahead(batches) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Each batch that holds rows, and whether it is the last."""
    before = None
    for pdf in batches:
        if len(pdf):
            if before is not None:
                yield before, False
            before = pdf
    if before is not None:
        yield before, True


def near_duplicates(docs: DataFrame, k: int = 5, distance: int = 4, blocks: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, fingerprint`` (16 hex digits) ``, component_id``.

    Texts link where their fingerprints differ in at most distance bits; component_id is the least id that a document
    reaches by links, its own included. Null texts and texts without words have the fingerprint zero and link like any
    other. Rows with a null id take no part: their component is null. Rows that repeat an id keep a fingerprint each
    and link by it. An empty table gives an empty result; further columns are ignored. More blocks mean fewer copies of
    a point and more comparisons.
    """
    marked = materialise(fingerprints(docs, k, id_col, text_col), "fingerprints")
    points = materialise(marked.where("doc_id is not null").groupBy("point").agg(F.min("doc_id").alias("least_id")), "points")
    met = meetings(points, coverings(distance, blocks))
    found = materialise(near_points(met, distance), "near-points")
    links = found.where("b is not null").select("a", "b")
    late = found.where("b is null").select(F.col("a").alias("anchor"), "homes", "rows").where("homes > 0")
    if not late.isEmpty():
        links = links.unionByName(materialise(near_points_dealt(met, late, distance), "near-points-dealt"))
    roots = connected_components(links, keep=materialise)
    placed = points.join(roots.hint("merge"), F.col("point") == F.col("node"), "left").select("point", "least_id", F.coalesce("component", "point").alias("root"))
    placed = materialise(placed, "placed-points")
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(placed.select("point", "root").join(least.hint("merge"), "root").select("point", "component_id"), "named-points")
    joined = marked.join(named.hint("merge"), "point", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
