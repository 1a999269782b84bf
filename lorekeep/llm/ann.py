"""Approximate nearest neighbours: a forest of random-projection trees.

The trees' planes are fitted on the driver on a bounded sample (``SAMPLE`` vectors of the smallest id hash): each
node is halved at the median along the line through two of its vectors. Every vector is then indexed, in one leaf
of each tree. A query searches all trees through one priority queue, ordered by the farthest it is on the wrong
side of a plane on the way. How many leaves it visits is measured: as many as find ``TARGET`` of the nearest vectors
of ``PROBES`` vectors, which one pass compares with the whole table; clustered tables need few, shapeless ones many.

Leaves that grow beyond ``SMALL`` vectors branch on in the tasks that hold them, by planes through their own vectors,
and a query follows every branch that lies no farther on the wrong side than the last leaf its queue gave. What it
reaches is reranked by exact distance.

Equal vectors are equally near to anything, so of each distinct vector only the rows that could be among the
nearest go through the index (k of them and one more, smallest ids first); equal queries are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

SAMPLE, TREES, LEAF, MAX_LEAVES, SEED = 16_384, 4, 40, 4096, 11
#: Share of the nearest that visits must find, and how many of the sample's vectors are asked for that.
TARGET, PROBES = 0.95, 128
#: Leaves of a forest that is searched whole, and visits at least in a larger one.
SEARCHED_WHOLE, LEAST_VISITS = 64, 16
#: Vectors of a leaf that one task holds; larger leaves are dealt out. Above SMALL they branch on, down to so many.
LEAF_ROWS, SMALL, BRANCHED = 32_768, 512, 128
#: Candidates that a task holds before it keeps the nearest of each query only, and distances computed at once.
HELD, DISTANCES = 1_000_000, 2_000_000


class Tree:
    """Planes in heap order: node i has children 2i and 2i + 1; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        self.planes, self.cuts = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
        rows = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = rows.pop(node)
            w = rng.normal(size=sample.shape[1])
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                w = a - b if np.any(a != b) else w
            w = w / np.linalg.norm(w)
            along = sample[own] @ w
            order = np.argsort(along, kind="stable")
            half = len(own) // 2
            cut = (along[order[half - 1]] + along[order[half]]) / 2 if len(own) > 1 else (along[0] if len(own) else 0.0)
            self.planes[node], self.cuts[node] = w, cut
            rows[2 * node], rows[2 * node + 1] = own[along <= cut], own[along > cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.planes[node]) > self.cuts[node])
        return node - (1 << self.depth)


    def margins(self, x: np.ndarray) -> np.ndarray:
        """Of each leaf, the farthest that the query x is on the wrong side of a plane on the way."""
        side = self.planes @ x - self.cuts
        m = np.zeros(1)
        for level in range(self.depth):
            s = side[1 << level : 2 << level]
            m = np.stack([np.where(s > 0, np.maximum(m, s), m), np.where(s > 0, m, np.maximum(m, -s))], axis=1).ravel()
        return m

    def within(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) of all leaves that are no farther on the wrong side of a plane than the query's bound."""
        query, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x[query], self.planes[node]) - self.cuts[node]
            near = 2 * node + (side > 0)
            far = np.abs(side) <= bounds[query]
            query, node = np.concatenate([query, query[far]]), np.concatenate([near, near[far] ^ 1])
        return query, node - (1 << self.depth)


class Forest:
    def __init__(self, sample: np.ndarray, rows: int):
        depth = max(0, int(np.log2(min(MAX_LEAVES, max(1, rows // LEAF), max(1, len(sample) // 4)))))
        rng = np.random.default_rng(SEED)
        self.leaf_count = 1 << depth
        self.trees = [Tree(sample, depth, rng) for _ in range(TREES)]
        self.visits = TREES * self.leaf_count

    def index(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered through the forest."""
        return np.stack([t * self.leaf_count + tree.leaves(x) for t, tree in enumerate(self.trees)], axis=1)

    def measure(self, probes: np.ndarray, found: np.ndarray, leaves: np.ndarray) -> None:
        """Set the visits so that TARGET of some near vectors are found: found names each one's probe, leaves where it lies."""
        needed = np.zeros(len(found), dtype=np.int64)
        for i in np.unique(found).tolist():
            place = np.empty(TREES * self.leaf_count, dtype=np.int64)
            place[np.argsort(np.concatenate([t.margins(probes[i]) for t in self.trees]), kind="stable")] = np.arange(len(place))
            needed[found == i] = place[leaves[found == i]].min(axis=1) + 1
        enough = int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) if len(needed) else 1
        self.visits = min(TREES * self.leaf_count, max(LEAST_VISITS, enough))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Leaves that the query x visits, nearest margin first over all trees, and the last one's margin."""
        sides = [(tree.planes @ x - tree.cuts).tolist() for tree in self.trees]
        heap, found, margin = [(0.0, t, 1) for t in range(TREES)], [], 0.0
        while heap and len(found) < self.visits:
            margin, t, node = heapq.heappop(heap)
            side = sides[t]
            while node < self.leaf_count:
                m = side[node]
                near = 2 * node + (m > 0)
                heapq.heappush(heap, (max(margin, abs(m)), t, near ^ 1))
                node = near
            found.append(t * self.leaf_count + node - self.leaf_count)
        return np.array(found, dtype=np.int64), margin if heap else np.inf


def compare(p: np.ndarray, ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (query, id, distance) of the k nearest of some vectors p (ids ascend) to each query q, among those that its bound lets it reach."""
    if len(p) > SMALL:
        tree = Tree(p, int(np.log2(len(p) / BRANCHED)), np.random.default_rng(SEED))
        query, leaf = tree.within(q, bounds)
        if 2 * len(query) < len(q) << tree.depth:
            own, order = tree.leaves(p), np.argsort(leaf, kind="stable")
            at = np.searchsorted(leaf[order], np.arange((1 << tree.depth) + 1))
            for i in np.unique(leaf).tolist():
                rows, asked = np.flatnonzero(own == i), query[order[at[i] : at[i + 1]]]
                if len(rows):
                    for x, y, d in _nearest_of(p[rows], q[asked], k):
                        yield asked[x], ids[rows[y]], d
            return
    for x, y, d in _nearest_of(p, q, k):
        yield x, ids[y], d


def _nearest_of(p: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (in q, in p) and distances of the k nearest, ties to the first; products of matrices leave few to be computed exactly."""
    sizes = (p**2).sum(axis=1)
    for at in range(0, len(q), max(1, DISTANCES // len(p))):
        some = q[at : at + max(1, DISTANCES // len(p))]
        near = sizes - 2 * some @ p.T
        if len(p) > k:
            own = (some**2).sum(axis=1)
            slack = 1e-12 * (own + sizes.max()) * (4 + p.shape[1])
            x, y = np.nonzero(near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        else:
            x, y = (i.ravel() for i in np.indices(near.shape))
        d = np.sqrt(((some[x] - p[y]) ** 2).sum(axis=1))
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        first = np.searchsorted(x, x)
        kept = np.arange(len(x)) - first < k
        yield x[kept] + at, y[kept], d[kept]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` (array of double): vectors without null or non-finite components, not all zero. Negative zero counts as zero."""
    fine = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vec_col, lambda x: x != 0)
    return vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("v"))


def _nearest(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of each query, without repeats."""
    rows = rows.sort_values(["query", "score", "vec_id"], kind="stable").drop_duplicates(["query", "vec_id"])
    return rows[rows.groupby("query", sort=False).cumcount() < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest vectors found for each query, never the row of the query's own id.

    score is the Euclidean distance in double precision; ties go to the smaller id. Null vectors, zero vectors and
    those with null or non-finite components take no part, nor do null ids and vectors of another length than most.
    Repeated rows count once; with fewer than k candidates all are returned if found. Empty tables give no rows.
    """
    rows = materialise(usable(vectors, id_col, vec_col).distinct(), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    of_length = F.size("v") == (lengths["d"] if lengths else 0)
    rows, asked = rows.where(of_length), usable(queries, id_col, vec_col).where(of_length).distinct()
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    points = materialise(rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).drop("r"), "points")
    total = points.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # asked has few rows per vector unless copies are many: map-side minima make one query of each
    one = asked.groupBy("v").agg(F.min("vec_id").alias("query"))
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    forest = Forest(np.stack(sample["v"]), total)
    if forest.leaf_count * TREES > SEARCHED_WHOLE:
        probes, probe_ids = np.stack(sample["v"].iloc[:PROBES]), sample["vec_id"].to_numpy()[:PROBES]

        def nearest_of_probes(batches):
            for pdf in batches:
                if len(pdf):
                    x, ids = np.stack(pdf["v"]), pdf["vec_id"].to_numpy()
                    i, j, d = (np.concatenate(c) for c in zip(*_nearest_of(x, probes, k + 1)))
                    other = ids[j] != probe_ids[i]
                    i, j, d = i[other], j[other], d[other]
                    yield pd.DataFrame({"probe": i, "vec_id": ids[j], "d": d, "leaves": list(forest.index(x[j]))})

        near = points.mapInPandas(nearest_of_probes, "probe int, vec_id long, d double, leaves array<long>")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("d", "vec_id"))).where(F.col("r") <= k).toPandas()
        forest.measure(probes, near["probe"].to_numpy(), np.stack(near["leaves"]) if len(near) else np.zeros((0, TREES), dtype=np.int64))
    shares = -(-total // (forest.leaf_count * LEAF_ROWS))
    # vectors of single precision are moved as such: doubles of them hold nothing more
    packed = "<f4" if getattr(vectors.schema[vec_col].dataType, "elementType", None) == T.FloatType() else "<f8"

    def leaves(batches):
        for pdf in batches:
            if len(pdf):
                found = forest.index(np.stack(pdf["v"]))
                data = [np.asarray(x, dtype=packed).tobytes() for x in pdf["v"]]
                yield pd.DataFrame({"leaf": found.ravel(), "query": False, "id": np.repeat(pdf["vec_id"].to_numpy(), TREES), "bound": 0.0, "v": np.repeat(np.array(data, dtype=object), TREES)})

    def visits(batches):
        for pdf in batches:
            for i, x in zip(pdf["query"], pdf["v"]):
                found, bound = forest.search(np.asarray(x, dtype=float))
                yield pd.DataFrame({"leaf": found, "query": True, "id": i, "bound": bound, "v": [np.asarray(x, dtype=packed).tobytes()] * len(found)})

    schema = "leaf long, query boolean, id long, bound double, v binary"
    placed = points.mapInPandas(leaves, schema).withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)))
    visited = one.mapInPandas(visits, schema).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    dealt = placed.unionByName(visited).repartition("leaf", "share").sortWithinPartitions("leaf", "share", "query", "id")

    def rerank(batches):
        held, size, rest = [], 0, None

        def reranked(group: pd.DataFrame):
            n = int((~group["query"].to_numpy(dtype=bool)).sum())
            if not n or n == len(group):
                return
            x = np.frombuffer(b"".join(group["v"]), dtype=packed).reshape(len(group), -1).astype(float)
            ids, bounds = group["id"].to_numpy(), group["bound"].to_numpy()
            for query, vec, d in compare(x[:n], ids[:n], x[n:], bounds[n:], k + 1):
                yield pd.DataFrame({"query": ids[n:][query], "vec_id": vec, "score": d})

        for pdf in batches:
            pdf = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf
            key = pdf[["leaf", "share"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(pdf) else np.zeros(0, int)
            for a, b in zip(starts[:-1], starts[1:]):
                for found in reranked(pdf.iloc[a:b]):
                    held.append(found)
                    size += len(found)
                    if size > HELD:
                        held = [_nearest(pd.concat(held), k + 1)]
                        size = len(held[0])
                        if size > HELD // 2:
                            yield held.pop()
                            size = 0
            rest = pdf.iloc[starts[-1] :] if len(starts) else pdf
        if rest is not None and len(rest):
            held += list(reranked(rest))
        if held:
            yield _nearest(pd.concat(held), k + 1)

    found = dealt.mapInPandas(rerank, "query long, vec_id long, score double").distinct()
    per_query = Window.partitionBy("query").orderBy("score", "vec_id")
    top = found.withColumn("r", F.row_number().over(per_query)).where(F.col("r") <= k + 1).select("query", F.struct("score", "vec_id").alias("hit"))
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list("hit")).alias("hits"))  # at most k + 1 each
    owners = asked.select(F.col("vec_id").alias("query_id"), "v").join(one, "v").select("query_id", "query")
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    each = owners.join(lists, "query").select("query_id", F.posexplode(own).alias("i", "hit"))
    return each.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
