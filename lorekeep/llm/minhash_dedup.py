"""MinHash near-dedup: a chosen-path set similarity join.

A document is the set of its word shingles, and its minwise tokens are the least shingles under many hash
functions. In each of several independent trees, documents are branched by chosen tokens: a node holds those that
share the tokens on its path. Nodes of one document end; small nodes are compared exhaustively by signature; large
ones branch again by further tokens, two branches for each document so that similar ones rarely part. What is
still large at the last level is compared in blocks, each joined by the node's first document, and then whole: all
pairs across components, block by block, by exact overlap of full sets.

A pair of similarity s shares the first token of a tree with probability s, and one of two branches with
1 - (1 - s)^2. With six trees, a pair of 0.85 in small nodes is missed with probability 0.15^6, about 1e-5.
Estimates that prune add to that, alike in all trees: one pair exactly at the threshold lies below four deviations with
about 7e-5 (192 hashes) and 4e-5 (1024) at 0.8, 9e-5 and 6e-5 at 0.85. Large nodes compared whole use no estimates.

Candidates are confirmed on full sets. The first round proposes a spanning forest per node, heaviest edges first;
the second takes every pair left over whose documents aren't in one component yet, so no link between components is
lost to the forest: in small nodes those that sharper signatures propose, in large ones all. Documents with equal sets stand for one another throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .storage import materialise
from .wordwise import slices

HASHES, TREES, LEVELS, BRANCHES = 192, 6, 3, 2
#: Documents of a node that are compared exhaustively.
SMALL = 64
#: Documents of a block of what is still large at the last level.
BLOCK = 256
#: How many standard deviations below the threshold an estimate may lie.
DEVIATIONS = 4
SHARP = 1024
#: Documents and shingles of a block where large nodes are compared whole; a task holds two blocks.
WHOLE, WHOLE_SHINGLES = 1024, 500_000
#: Holders up to which a shingle's pairs are counted one by one; columns of shingles of more that are multiplied at once.
FEW, COLUMNS = 16, 2048
#: Characters of text whose words are held at once, and bytes of signatures that are compared at once.
SLICE, COMPARED = 2_000_000, 10_000_000
#: Ids that may be broadcast to pick documents before a shuffle (8 bytes each); more are joined.
BROADCAST_IDS = 500_000
TOKENS = 1 + (LEVELS - 1) * BRANCHES  # of a tree


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, lower-cased from A to Z, and where each text's begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, type=pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    words = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[at] > 0 if len(at) else np.zeros(0, bool)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])[bounds - bounds[0]]
    return hashes[at][words] if len(at) else np.zeros(0, np.uint64), ends


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Each text's set of k-word shingles as sorted 64-bit hashes; a shorter sequence is one shingle, no word none."""
    with np.errstate(over="ignore"):
        for a, b in slices(texts, SLICE):
            words, ends = _word_hashes([t or "" for t in texts[a:b]])
            rolled = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
            for j in range(k):
                rolled = _mix(rolled + words[j : j + len(rolled)])
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if y - x >= k:
                    yield np.unique(rolled[x : y - k + 1])
                else:
                    one = np.full(min(1, y - x), y - x, dtype=np.uint64)
                    for w in words[x:y]:
                        one = _mix(one + w)
                    yield one


def _minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The least shingle of each set that isn't empty, under each of so many hash functions."""
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    multipliers = np.random.default_rng(20).integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
    return np.stack([np.minimum.reduceat(flat * m, starts) for m in multipliers], axis=1)


def _low_bytes(minima: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in (minima >> np.uint32(13)).astype(np.uint8)]


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, key, sig, tokens``: set size, digest of the set, low bytes of all minima, whole minima used as tokens."""

    def run(batches):
        for pdf in batches:
            ids, texts = pdf["id"].astype("Int64"), pdf["text"].tolist()
            for a, b in slices(texts, SLICE):
                sets = list(shingle_sets(texts[a:b], k))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                sig, tokens = [None] * len(sets), [None] * len(sets)
                if len(full):
                    minima = _minima([sets[i] for i in full.tolist()], HASHES)
                    for i, low, row in zip(full.tolist(), _low_bytes(minima), minima):
                        sig[i], tokens[i] = low, row[: TREES * TOKENS].astype("<u4").tobytes()
                keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pd.DataFrame({"doc_id": ids.iloc[a:b], "n": sizes.astype(np.int64), "key": keys, "sig": sig, "tokens": tokens})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, n long, key binary, sig binary, tokens binary")


def sharp_signatures(texts: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, sig`` with SHARP hashes, of texts (``doc_id, text``) that hold a word."""

    def run(batches):
        for pdf in batches:
            for a, b in slices(pdf["text"].tolist(), SLICE):
                part = pdf.iloc[a:b]
                sets = list(shingle_sets(part["text"].tolist(), k))
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    yield pd.DataFrame({"doc_id": part["doc_id"].iloc[full].to_numpy(), "n": [len(sets[i]) for i in full], "sig": _low_bytes(_minima([sets[i] for i in full], SHARP))})

    return texts.mapInPandas(run, "doc_id long, n long, sig binary")


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, shingles``: full sets of texts (``doc_id, text``) that hold a word, as bytes."""

    def run(batches):
        for pdf in batches:
            for a, b in slices(pdf["text"].tolist(), SLICE):
                part = pdf.iloc[a:b]
                sets = list(shingle_sets(part["text"].tolist(), k))
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    yield pd.DataFrame({"doc_id": part["doc_id"].iloc[full].to_numpy(), "n": [len(sets[i]) for i in full], "shingles": [sets[i].tobytes() for i in full]})

    return texts.mapInPandas(run, "doc_id long, n long, shingles binary")


def _nodes(batches) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole nodes of a stream sorted by path: the rows, and where each node begins (one more at the end)."""
    held = None
    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        path = pdf["path"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, int)
        if len(starts) > 1:
            yield pdf.iloc[: starts[-1]].reset_index(drop=True), starts
        held = pdf.iloc[starts[-1] :].reset_index(drop=True) if len(starts) else pdf
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _slack(percent: int, hashes: int) -> float:
    """How far below the threshold an estimate by so many hashes may lie; low bytes of different minima match by chance."""
    match = percent / 100 + (1 - percent / 100) / 256
    return DEVIATIONS * (match * (1 - match) / hashes) ** 0.5 / (1 - 1 / 256)


def _similar(ids: np.ndarray, n: np.ndarray, sig: np.ndarray, starts: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """For nodes of one size at a time, rows (node, i, j, estimate) of pairs that may reach the threshold."""
    sizes = np.diff(starts)
    for m in np.unique(sizes[sizes > 1]).tolist():
        where = starts[:-1][sizes == m]
        step = max(1, COMPARED // (m * sig.shape[1]))
        for some in (where[i : i + step] for i in range(0, len(where), step)):
            rows = some[:, None] + np.arange(m)
            found = []
            for d in range(1, m):
                x, y = rows[:, :-d].ravel(), rows[:, d:].ravel()
                fit = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (ids[x] != ids[y])
                x, y = x[fit], y[fit]
                estimate = ((sig[x] == sig[y]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                good = estimate >= percent / 100 - _slack(percent, sig.shape[1])
                found.append(np.stack([np.searchsorted(where, x[good], side="right"), x[good], y[good], estimate[good]]))
            yield np.concatenate(found, axis=1)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Of each node's pairs, those of a spanning forest with the highest estimates first."""
    order = np.lexsort((-pairs[3], pairs[0]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept, node = [], None
    for i, (g, x, y) in zip(order.tolist(), pairs[:3, order].astype(np.int64).T.tolist()):
        if g != node:
            node, root = g, {}
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[:, kept]


def candidate_pairs(leaves: DataFrame, reps: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``a < b, path`` : pairs of leaves (``path, doc_id``) whose signatures in reps come near the threshold.

    With a column ``component``, only pairs across components; forest: of each node a spanning forest alone.
    """
    across = "component" in leaves.columns
    signed = leaves.join(reps.select("doc_id", "n", "sig").hint("merge"), "doc_id")

    def run(batches):
        for pdf, starts in _nodes(batches):
            ids, n, path = pdf["doc_id"].to_numpy(), pdf["n"].to_numpy(), pdf["path"].to_numpy()
            sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(pdf), -1)
            component = pdf["component"].to_numpy() if across else None
            for pairs in _similar(ids, n, sig, starts, percent):
                if forest and pairs.shape[1]:
                    pairs = _forest(pairs)
                x, y = pairs[1].astype(np.int64), pairs[2].astype(np.int64)
                if across:
                    apart = component[x] != component[y]
                    x, y = x[apart], y[apart]
                if len(x):
                    yield pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "path": path[x]})

    return signed.repartition("path").sortWithinPartitions("path", "doc_id").mapInPandas(run, "a long, b long, path long")


def _shared(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many shingles each of some sets (rows) shares with each of all."""
    doc, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    doc, flat = doc[order], flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    held = np.diff(np.append(first, len(flat)))
    row = np.full(len(sets), -1)
    row[rows] = np.arange(len(rows))
    shared = np.zeros((len(rows), len(sets)), dtype=np.float32)
    for c in range(2, FEW + 1):
        holders = doc[first[held == c][:, None] + np.arange(c)]
        for d in range(1, c):
            x, y = row[holders].ravel(), np.roll(holders, d, axis=1).ravel()
            np.add.at(shared.reshape(-1), x[x >= 0] * len(sets) + y[x >= 0], np.float32(1))
    many = np.flatnonzero(held > FEW)
    for some in (many[i : i + COLUMNS] for i in range(0, len(many), COLUMNS)):
        ends = np.cumsum(held[some])
        places = np.repeat(first[some] - ends + held[some], held[some]) + np.arange(ends[-1])
        holds = np.zeros((len(sets), len(some)), dtype=np.float32)
        holds[doc[places], np.repeat(np.arange(len(some)), held[some])] = 1
        shared += holds[rows] @ holds.T
    return shared.astype(np.int32)


def _links_across(sets: list[np.ndarray], component: np.ndarray, percent: int) -> np.ndarray:
    """Rows (i, j) of linked sets of different components that span all such links."""
    _, component = np.unique(component, return_inverse=True)
    n, rows = np.array([len(s) for s in sets], dtype=np.int32), np.flatnonzero(component != np.bincount(component).argmax())
    linked = (100 + percent) * _shared(sets, rows) >= percent * (n[rows][:, None] + n)
    linked &= component[rows][:, None] != component
    x, y = np.nonzero(linked)
    x = rows[x]
    _, one = np.unique(np.stack([component[x], component[y]]), axis=1, return_index=True)
    x, y = x[one], y[one]
    return _forest(np.stack([np.zeros(len(x), int), component[x], component[y], np.ones(len(x), int), x, y]))[4:]


def whole_links(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a < b``: links that span all those across components within nodes (``path, doc_id, component``), by full sets of texts.

    A node's documents are dealt to blocks and every two blocks meet, so no pair is left out; the work of a node grows
    with the square of its documents outside its largest component, that of a task doesn't.
    """
    sets = materialise(full_sets(_of_ids(texts, nodes.select("doc_id").distinct()), k), "full-sets")
    sizes = nodes.join(sets.select("doc_id", "n").hint("merge"), "doc_id").groupBy("path").agg(F.greatest(F.ceil(F.count("*") / WHOLE), F.ceil(F.sum("n") / WHOLE_SHINGLES)).alias("blocks"))
    dealt = nodes.join(materialise(sizes, "whole-nodes").hint("merge"), "path").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: (x != F.col("own")) | (F.col("blocks") == 1))
    met = dealt.withColumn("other", F.explode(others)).select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "doc_id", "component")

    def run(batches):
        for pdf, starts in _nodes(batches):
            ids, component = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy()
            for at, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if len(np.unique(component[at:end])) > 1:
                    i, j = _links_across([np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"].iloc[at:end]], component[at:end], percent)
                    if len(i):
                        yield pd.DataFrame({"a": np.minimum(ids[at + i], ids[at + j]), "b": np.maximum(ids[at + i], ids[at + j])})

    held = met.join(sets.select("doc_id", "shingles").hint("merge"), "doc_id")
    return held.repartition("path").sortWithinPartitions("path", "doc_id").mapInPandas(run, "a long, b long")


def grow_trees(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of all trees over reps (``doc_id, tokens``): ``path, doc_id`` of small ones, of large ones, and of blocks of these.

    No small node is above SMALL, no block much above BLOCK.

    Rows carry a path and an id alone; tokens meet again only those documents whose node branches further.
    """
    token = lambda level, branch: F.substring("tokens", (F.col("tree") * TOKENS + 1 + (level - 2) * BRANCHES + branch) * 4 + 1 if level > 1 else F.col("tree") * TOKENS * 4 + 1, F.lit(4))
    rows = reps.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("doc_id", "tree", F.xxhash64("tree", token(1, F.lit(0))).alias("path"))
    leaves = []
    for level in range(1, LEVELS + 1):
        # written first, so that a node with many rows meets its count in a join that Spark can split
        nodes = materialise(rows.groupBy("path").agg(F.count("*").alias("size"), F.min("doc_id").alias("first")).where("size > 1"), f"nodes{level}")
        rows = materialise(rows.join(nodes.hint("merge"), "path"), f"level{level}")
        leaves.append(rows.where(F.col("size") <= SMALL).select("path", "doc_id"))
        rows = rows.where(F.col("size") > SMALL)
        if level < LEVELS:
            tokened = rows.select("doc_id", "tree", "path").join(reps.select("doc_id", "tokens").hint("merge"), "doc_id")
            branched = tokened.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
            rows = branched.select("doc_id", "tree", F.xxhash64("path", "branch", token(level + 1, F.col("branch"))).alias("path"))
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.array(F.pmod(F.xxhash64("doc_id", "tree", "path"), blocks))
    every = F.when(F.col("doc_id") == F.col("first"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(own)
    dealt = rows.withColumn("block", F.explode(every)).select(F.xxhash64("path", "block").alias("path"), "doc_id")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, rows.select("path", "doc_id"), dealt


def _mixed(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Rows (``path, doc_id``) of nodes that hold more than one component of found, with ``component``."""
    placed = nodes.join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialise(placed, f"placed{name}")
    mixed = placed.groupBy("path").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("path")
    return materialise(placed.join(mixed, "path", "left_semi"), f"mixed{name}")


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id stands in ids (distinct); few ids are broadcast, more are joined."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (``a, b``) with ``linked``: whether the full sets of docs (``doc_id, text``, one row per id) reach the threshold."""
    docs = _of_ids(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                texts = pd.unique(pd.concat([part["text_a"], part["text_b"]])).tolist()
                sets = dict(zip(texts, shingle_sets(texts, k)))
                linked = []
                for x, y in zip(part["text_a"], part["text_b"]):
                    x, y = sets[x], sets[y]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pd.DataFrame({"a": part["a"], "b": part["b"], "linked": linked})

    return both.mapInPandas(run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where 100 * shared >= percent * all of their shingles; component_id is the least id that a
    document reaches by links, and kept holds for that document alone. Texts that are null or hold no word have the
    empty set and are linked with nothing. Rows with a null id take no part: their component is null and they are
    kept. Rows that repeat an id all get what its least text gives. Further columns are ignored.
    """
    source, copies = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    if repeats(source):
        copies = materialise(source.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.count("*").alias("rows")), "texts")
        source = copies.select("doc_id", "text").unionByName(source.where("doc_id is null"))
    marked = materialise(signatures(source, k, "doc_id"), "signatures")
    twice = marked.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = materialise(marked.join(materialise(twice, "twice").hint("merge"), "key", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).drop("key"), "members")
    reps, texts = members.where("n > 0 and doc_id = rep").select("doc_id", "n", "sig", "tokens"), source
    small, large, blocks = grow_trees(reps)
    proposed = materialise(candidate_pairs(small.unionByName(blocks), reps, percent, True), "proposed")
    first = materialise(confirm(materialise(proposed.select("a", "b").distinct(), "pairs"), texts, k, percent), "confirmed")
    found = materialise(connected_components(first.where("linked"), keep=materialise), "components")
    # a node without a proposed pair has none at all; of the others, those within one component are done
    mixed = _mixed(small.join(proposed.select("path").distinct(), "path", "left_semi"), found, "")
    sharp = materialise(sharp_signatures(_of_ids(texts, mixed.select("doc_id").distinct()), k), "sharp-signatures")
    more = candidate_pairs(mixed, sharp, percent, False).select("a", "b").distinct()
    rest = materialise(more.join(first.select("a", "b"), ["a", "b"], "left_anti"), "more-pairs")
    linked = [] if rest.isEmpty() else [materialise(confirm(rest, texts, k, percent).where("linked").select("a", "b"), "more-confirmed")]
    whole = _mixed(large, found, "-whole")
    linked += [] if whole.isEmpty() else [materialise(whole_links(whole, texts, k, percent), "whole-links")]
    linked = [x for x in linked if not x.isEmpty()]
    if linked:
        links = first.where("linked").select("a", "b")
        for x in linked:
            links = links.unionByName(x)
        found = materialise(connected_components(links, keep=materialise), "components")
    joined = members.select("doc_id", "n", "rep").join(found.hint("merge"), F.col("rep") == F.col("node"), "left")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    if copies is not None:
        each = out.join(copies.select("doc_id", "rows"), "doc_id", "left").withColumn("_row", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("rows").cast("int"), F.lit(1)))))
        out = each.drop("rows", "_row")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def repeats(members: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return not members.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
