"""Target-distribution importance resampling by partition-local word tries.

Features are runs of up to ``longest`` consecutive words, hashed to buckets by the CRC-32 of their words joined by a
space. Each task keeps a trie of the words that it meets: the children of a node are the words that follow its run, so
a node is a run, and holds how often the run came and the state of its CRC, from which a child's goes on. Counts of
nodes are added up by bucket, one row a bucket and task. A bucket's gain is the logarithm of how much likelier it is in
the target; documents are then scored by walking tries whose nodes have gains attached. The highest scores, each raised
by Gumbel noise that only depends on the id, are a sample without replacement in proportion to the likelihood ratio.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .wordwise import paused_gc, slices

#: Characters of text that are taken together, and nodes that a trie holds before it starts anew.
SLICE, NODES = 4_000_000, 500_000
#: Bytes as they are read: capitals from A to Z are lowered, ASCII but letters and digits parts words, the rest stays.
READ = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PER_GAIN = 1000


class WordTrie:
    """Runs of words as nodes: children by word, counts, CRC states, and a gain if those of buckets are given."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.totals = np.zeros(buckets, dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        self.word: dict[bytes, int] = {}  # a word's number is that of the root's child by it
        self.child: dict[int, int] = {}  # parent << 32 | word
        self.crc = np.zeros(1024, dtype=np.uint32)
        self.count = np.zeros(1024, dtype=np.int64)
        self.size = 0

    def _add(self, states: list[int]) -> None:
        while self.size + len(states) > len(self.crc):
            self.crc, self.count = np.concatenate([self.crc, np.zeros_like(self.crc)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.crc[self.size : self.size + len(states)] = states
        self.size += len(states)

    def _first(self, words: list[bytes]) -> np.ndarray:
        """Nodes of single words. Words are numbered when met; other nodes stand between their numbers."""
        nodes = list(map(self.word.get, words))
        missing = [i for i, n in enumerate(nodes) if n is None]
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            self.word.update(zip(new, range(self.size, self.size + len(new))))
            self._add([zlib.crc32(w) for w in new])
            for i in missing:
                nodes[i] = self.word[words[i]]
        return np.array(nodes, dtype=np.int64)

    def _longer(self, parents: np.ndarray, words: np.ndarray, spelled: dict[int, bytes]) -> np.ndarray:
        """Nodes of runs that are those of parents and one word more."""
        keys, back = np.unique(parents << 32 | words, return_inverse=True)
        nodes = list(map(self.child.get, keys.tolist()))
        missing = [i for i, n in enumerate(nodes) if n is None]
        states = []
        for i in missing:
            key = int(keys[i])
            nodes[i] = self.child[key] = self.size + len(states)
            states.append(zlib.crc32(b" " + spelled[key & 0xFFFFFFFF], int(self.crc[key >> 32])))
        self._add(states)
        return np.array(nodes, dtype=np.int64)[back]

    def walk(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For ranges a, b of texts: their numbers of words, and of each length of run its nodes and the text of each."""
        for a, b in slices(texts, SLICE):
            if self.size > NODES:
                self.flush()
            each = [(t or "").encode("utf-8", "surrogatepass").translate(READ).split() for t in texts[a:b]]
            sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
            words = [w for ws in each for w in ws]
            first, owner = self._first(words), np.repeat(np.arange(len(each)), sizes)
            levels, nodes = [(first, owner)], first
            spelled = dict(zip(first.tolist(), words)) if self.longest > 1 else {}
            for more in range(1, self.longest):
                n = max(0, len(owner) - more)
                within = owner[more:] == owner[:n]
                # a run of more words begins where one word less did and still stands in the same text
                held = np.full(len(first), -1, dtype=np.int64)
                held[: len(within)][within] = self._longer(nodes[: len(within)][within], first[more:][within], spelled)
                nodes = held
                levels.append((nodes[: len(within)][within], owner[: len(within)][within]))
            yield a, b, sizes, levels

    def take(self, texts: list[str | None]) -> None:
        """Count all runs of texts."""
        for _, _, _, levels in self.walk(texts):
            for nodes, _ in levels:
                self.count[: self.size] += np.bincount(nodes, minlength=self.size)

    def flush(self) -> np.ndarray:
        """Add the nodes' counts to their buckets' and start anew; returns the counts of buckets so far."""
        np.add.at(self.totals, self.crc[: self.size].astype(np.int64) % self.buckets, self.count[: self.size])
        self._clear()
        return self.totals

    def score(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For ranges a, b of texts: numbers of words and of features, and sums of gains."""
        for a, b, sizes, levels in self.walk(texts):
            gain = self.gains[self.crc[: self.size].astype(np.int64) % self.buckets]
            sums, features = np.zeros(b - a, dtype=np.int64), np.zeros(b - a, dtype=np.int64)
            for nodes, owner in levels:
                ends = np.cumsum(np.bincount(owner, minlength=b - a))
                running = np.concatenate([[0], np.cumsum(gain[nodes])])
                sums += running[ends] - running[np.concatenate([[0], ends[:-1]])]
                features += np.diff(np.concatenate([[0], ends]))
            yield a, b, sizes, features, sums


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """``bucket, n`` of all features of all texts, for buckets that hold any."""

    def run(batches):
        trie = WordTrie(longest, buckets)
        with paused_gc():
            for pdf in batches:
                trie.take(pdf["text"].tolist())
        totals = trie.flush()
        held = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": held, "n": totals[held]})

    return texts.select(F.col(text_col).alias("text")).mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """floor(1000 ln ((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket.

    Two numbers a bucket meet on the driver, however many features there are.
    """
    held = []
    for table in (docs, target):
        n = np.zeros(buckets, dtype=object)
        for r in bucket_counts(table, longest, buckets, text_col).collect():
            n[r["bucket"]] = r["n"]
        held.append(n)
    s, t = held
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(PER_GAIN * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)], dtype=np.int64)


def noise(key: int, seed: str) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-PER_GAIN * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, longest: int = 1, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for each row of docs. No shuffle."""

    def run(batches):
        trie = WordTrie(longest, len(gains), gains)
        with paused_gc():
            for pdf in batches:
                ids = pdf["id"].astype("Int64")
                for a, b, words, features, sums in trie.score(pdf["text"].tolist()):
                    weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
                    some = ids.iloc[a:b]
                    score = pd.array([None if k is pd.NA else int(w) + noise(k, seed) for k, w in zip(some.tolist(), weight.tolist())], dtype="Int64")
                    yield pd.DataFrame({"doc_id": some.to_numpy(dtype=object), "n_words": words, "n_features": features, "weight": weight, "score": score})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored with ``rank``: 1, 2, 3... for the drawn percent of the rows of at least so many words, else null.

    Scores are whole thousandths of logarithms of bounded numbers, so there are about 115,000 at most, whatever the
    table's size: only their counts are put in order in one place. Ranks within a score are given apart.
    """
    keys = ["doc_id", "n_features", "weight", "score"]
    in_draw = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    alike = materialise(scored.groupBy(*keys, in_draw.alias("_in")).agg(F.count("*").alias("_copies")), "alike")
    by_score = alike.where("_in").groupBy("score").agg(F.sum("_copies").alias("_n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_score.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    drawn_scores = placed.select("score", "_above", F.floor(F.col("_all") * percent / 100).alias("_most")).where("_above < _most")
    joined = alike.join(F.broadcast(drawn_scores.withColumn("_in", F.lit(True))), ["score", "_in"], "left")
    before = Window.partitionBy("score").orderBy("doc_id", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_above") + F.coalesce(F.sum("_copies").over(before), F.lit(0))
    could = joined.where("_above is not null").withColumn("_first", first)
    rest = joined.where("_above is null").withColumn("_first", F.lit(None).cast("long"))
    each = could.unionByName(rest).select(*keys, "_first", "_most", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_place", "_nth"))
    rank = F.col("_first") + F.col("_nth")
    return each.select(*keys, F.when(rank <= F.col("_most"), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, n_features, weight, score, rank`` (null where not drawn).

    target holds the texts whose distribution is aimed at. Null and empty texts have no features and the weight 0; rows
    with a null id have no score and aren't drawn. Rows that repeat an id share its noise, and ties of score and id go
    to fewer features; rows alike in all of these are interchangeable. Empty tables on either side are fine. Further
    columns are ignored.
    """
    gains = bucket_gains(docs, target, longest, buckets, text_col)
    return ranked(materialise(scores(docs, gains, longest, seed, id_col, text_col), "scores"), least_words, percent)


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id has a rank in ranks (``doc_id, rank``)."""
    chosen = ranks.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, F.col(id_col) == F.col("_drawn"), "left_semi")
