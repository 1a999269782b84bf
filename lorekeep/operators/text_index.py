"""A stored full-text index: postings written once per version of a corpus, searched without reading a text.

Tables below a root, each partitioned by source, version and (but for docs) the first letter of what it holds:

* ``postings``: a row is a block, what one term has in one slab of a source: ids, weighted frequencies and sizes, and
  beside these arrays the block's greatest frequency and least size, from which no score in it can be greater than a
  bound. A slab holds entries of like size, so bounds are close; blocks of one slab are about the same entries.
* ``prefixes``: how many entries hold a word that begins so, for prefixes of up to PREFIX letters.
* ``docs``: what hits show.
* ``manifest``: sources with the version that counts, their entries and words; the newest set of rows is in force.

A search of many queries passes all blocks, in tiles of slabs. One of few reads bounds first (two small columns of the blocks whose terms begin with a query's words), then the blocks
of the best slabs, and then only slabs whose bound reaches the k-th best score so far. A source is replaced by writing
its new version and a new manifest; postings of other sources stay as they are, and readers of the old manifest too.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, norm_term, tokens
from .components import written
from .fulltext import BROADCAST_TERMS, K1, LEAST_IDF, TESTED, WEIGHTS, B

#: Entries of a slab, about; words that those of one class in a slab have, about; letters of a prefix that is counted beforehand; slabs of each query that are read first.
SLAB, SLAB_WORDS, PREFIX, FIRST = 512, 4_000_000, 6, 4
#: Entries that many queries meet in one task, about; fewer, while there are less than SPREAD tiles. Parts of a tile's entries that hold a word from which on it is kept for each entry.
TILE, SPREAD, SMALL_TILE, DENSE = 16_384, 32, 1_024, 8
#: Sets of words that are asked at once in a tile; entries of remembered words, about.
ASKED, REMEMBERED = 4_096, 16_000_000
POSTINGS = "term string, slab long, n int, top double, least int, ids array<long>, weights array<double>, sizes array<int>, part string, version string, initial string"
PREFIXES = "prefix string, df long, part string, version string, initial string"
MANIFEST = "source_key string, part string, version string, entries long, words long, number long"


def part_of(source_key: Column) -> Column:
    return F.substring(F.md5(F.coalesce(source_key, F.lit(""))), 1, 12)


#: First letters of the groups that a source's terms are filed by; digits and other letters are a group each.
GROUPS = "adgjnqtw"


def initial_of(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    out = F.when(first.between("0", "9"), "0")
    for low, high in zip(GROUPS, [*(chr(ord(c) - 1) for c in GROUPS[1:]), "z"]):
        out = out.when(first.between(low, high), low)
    return out.otherwise("_")


def _initial(word: str) -> str:
    first = word[0]
    return "0" if "0" <= first <= "9" else max(c for c in GROUPS if c <= first) if "a" <= first <= "z" else "_"


def _idf(df: Column, entries: Column) -> Column:
    idf = F.log((entries - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def _gain(idf: Column, f: Column, size: Column, mean: float) -> Column:
    """What a term adds to a score; greater for more, and for shorter entries."""
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))


class TextIndex:
    """An index at a root folder; open it anew to see what was written since."""

    def __init__(self, spark: SparkSession, root: str, docs_schema: str):
        self.spark, self.root, self.docs_schema = spark, root, docs_schema
        found = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
        rows = found.where(F.col("number") == found.agg(F.max("number")).first()[0]).collect()  # one row a source
        self.number = rows[0]["number"] if rows else 0
        self.sources = {r["source_key"]: r.asDict() for r in rows if r["part"] is not None}
        self.entries, self.words = (sum(s[c] for s in self.sources.values()) for c in ("entries", "words"))

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{name}/part={s['part']}/version={s['version']}" for s in self.sources.values() if s["entries" if name == "docs" else "words"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/{name}").schema(schema).parquet(*paths)

    @property
    def docs(self) -> DataFrame:
        """The entries' columns without their texts, ``size`` and ``excerpt``."""
        return self._table("docs", self.docs_schema + ", size int, excerpt string, part string, version string").drop("part", "version")

    def _blocks(self, prefixes: list[str] | None, lengths: list[int], longer: DataFrame | None = None) -> DataFrame:
        """Blocks with each of their terms' beginnings (``prefix``) of the given lengths; prefixes prune files and row groups. longer: only those that may hold one of these that is longer than PREFIX."""
        rows = self._table("postings", POSTINGS)
        if prefixes is not None:
            initials = {_initial(p) for p in prefixes}
            begins = F.lit(False)
            for p in prefixes:
                begins = begins | F.col("term").startswith(p)
            rows = rows.where(F.col("initial").isin(*sorted(initials))).where(begins)
        if longer is not None:
            begin = lambda c: F.substring(c, 1, PREFIX + 1)
            rows = rows.join(longer.where(F.length("prefix") > PREFIX).select(begin("prefix").alias("_begin")), begin("term") == F.col("_begin"), "left_semi")
        starts = F.array_compact(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
        return rows.withColumn("prefix", F.explode(starts))

    def search(self, queries: DataFrame, k: int = 10, where: Column | str | None = None) -> DataFrame:
        """As fulltext.search: ``query_id, rank, id, score`` for queries (``query_id, query``).

        where: a condition on docs; what it keeps is the whole corpus to the search (frequencies and sizes too). Blocks
        aren't skipped then, as bounds are about all entries.
        """
        terms = _local(queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("i", "prefix")), "terms")
        wanted = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
        distinct = terms.select("prefix").distinct()
        known = [r["prefix"] for r in distinct.limit(TESTED + 1).collect()]
        if not known:
            return self.spark.createDataFrame([], queries.select("query_id").schema.add("rank", "int").add("id", "long").add("score", "double"))
        few = known if len(known) <= TESTED else None
        lengths = sorted({len(p) for p in known}) if few is not None else sorted(r["n"] for r in distinct.select(F.length("prefix").alias("n")).distinct().collect())
        near = F.broadcast if few is not None or terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda df: df)
        blocks = self._blocks(few, lengths)
        at = ["part", "slab"]
        many = few is None and where is None
        opened = lambda rows: rows.select("prefix", *at, F.inline(F.arrays_zip("ids", "weights", "sizes"))).groupBy("prefix", *at, F.col("ids").alias("id"), F.col("sizes").alias("size")).agg(F.sum("weights").alias("f"))
        if where is not None:
            kept = self.docs.where(where)
            entries, mean = kept.agg(F.count("*"), F.avg("size")).first()
            hits = written(opened(blocks.join(near(distinct), "prefix")).join(kept.select("id"), "id", "left_semi"), "hits")
            df = hits.groupBy("prefix").agg(F.count("*").alias("df"))
            met = terms.join(df, "prefix").select("query_id", "i", "prefix", _idf(F.col("df"), F.lit(entries)).alias("idf"))
            scored = self._scored(hits.join(near(met), "prefix"), wanted, mean or 1.0)
            return self._best(scored, k)
        mean = self.words / self.entries if self.entries else 1.0
        if many:
            return self._search_many(terms, near(self._frequencies(distinct, self._blocks(None, [n for n in lengths if n > PREFIX], near(distinct)), None, opened, near)), k, mean)
        met = _local(terms.join(near(self._frequencies(distinct, blocks, few, opened, near)), "prefix").select("query_id", "i", "prefix", _idf(F.col("df"), F.lit(self.entries)).alias("idf")), "weighted")
        bounds = blocks.join(near(distinct), "prefix").groupBy("prefix", *at).agg(F.sum("top").alias("f"), F.min("least").alias("size"))
        every = bounds.join(near(met), "prefix").groupBy("query_id", *at).agg(F.sum(_gain(F.col("idf"), F.col("f"), F.col("size"), mean)).alias("bound"), F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), *at))
        slabs = written(every.join(near(wanted), "query_id").where("n = n_terms").select("query_id", *at, "bound", place.alias("place")), "slabs")
        read = lambda some: self._scored(opened(blocks.join(some.join(terms, "query_id").select("prefix", *at).distinct(), ["prefix", *at], "left_semi")).join(some.join(met, "query_id").select("query_id", "i", "prefix", *at, "idf"), ["prefix", *at]), wanted, mean)
        first = written(read(slabs.where(F.col("place") <= FIRST).select("query_id", *at)), "first")
        order = Window.partitionBy("query_id").orderBy("score")
        reached = first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select("query_id", F.col("score").alias("reached"))
        rest = slabs.where(F.col("place") > FIRST).join(reached, "query_id", "left").where(F.col("reached").isNull() | (-F.col("bound") <= F.col("reached") + 1e-9)).select("query_id", *at)
        both = first if rest.isEmpty() else first.unionByName(read(rest))
        return self._best(both, k)

    def _search_many(self, terms: DataFrame, frequencies: DataFrame, k: int, mean: float) -> DataFrame:
        """As search: all queries meet all blocks in tiles of entries, each of which keeps the k best of a query. Queries of the same words are asked once."""
        weighed = terms.join(frequencies, "prefix", "left").select("query_id", F.struct("prefix", _idf(F.col("df"), F.lit(self.entries)).alias("idf")).alias("t"), "df")
        asked = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.count("*").alias("n"), F.count("df").alias("known")).where("n = known")
        asked = written(asked.select("query_id", F.array_join("t.prefix", " ").alias("words"), F.col("t.idf").alias("idfs")), "asked")
        sets = written(asked.groupBy("words").agg(F.min("idfs").alias("idfs")).withColumn("number", F.monotonically_increasing_id()), "sets")
        tiles = max(-(-self.entries // TILE), min(SPREAD, -(-self.entries // SMALL_TILE)), 1)
        blocks = self._table("postings", POSTINGS).select(F.pmod(F.xxhash64("part", "slab"), F.lit(tiles)).alias("tile"), "term", "ids", "weights", "sizes")
        dealt = sets.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).select("tile", "number", "words", "idfs")
        # a partition for each tile: rows of a tile are many, whatever their bytes
        both = blocks.repartition(tiles, "tile").groupBy("tile").cogroup(dealt.repartition(tiles, "tile").groupBy("tile"))
        found = both.applyInArrow(lambda b, s: _best_of_tile(b, s, k, mean), "number long, id long, score double")
        best = Window.partitionBy("number").orderBy(F.round("score", 9), "id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return asked.join(sets.select("words", "number"), "words").join(ranked, "number").select("query_id", "rank", "id", F.round("score", 6).alias("score"))

    def _frequencies(self, distinct: DataFrame, blocks: DataFrame, few: list[str] | None, opened, near) -> DataFrame:
        """``prefix, df``: from the table of prefixes, longer ones from their postings."""
        held = self._table("prefixes", PREFIXES)
        if few is not None:
            held = held.where(F.col("initial").isin(*sorted({_initial(p) for p in few}))).where(F.col("prefix").isin(*few))
        short = held.join(distinct, "prefix").groupBy("prefix").agg(F.sum("df").alias("df"))
        if few is not None and all(len(p) <= PREFIX for p in few):
            return short
        long = opened(blocks.where(F.length("prefix") > PREFIX).join(near(distinct), "prefix")).groupBy("prefix").agg(F.count("*").alias("df"))
        return short.unionByName(long)

    @staticmethod
    def _scored(per_term: DataFrame, wanted: DataFrame, mean: float) -> DataFrame:
        """``query_id, id, score`` of entries with all of a query's terms (``query_id, i, id, size, f, idf``)."""
        sums = per_term.groupBy("query_id", "id").agg(F.sum(-_gain(F.col("idf"), F.col("f"), F.col("size"), mean)).alias("score"), F.count("*").alias("n"))
        return sums.join(wanted, "query_id").where("n = n_terms").select("query_id", "id", "score")

    @staticmethod
    def _best(scored: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))

    def replace(self, source_key: str, entries: DataFrame) -> TextIndex:
        """The index after a source's entries are replaced by entries (none: removed); only that source is written."""
        if self.docs_schema != _docs_schema(entries):
            raise ValueError("entries have other columns than the index")
        mine = entries.where(F.col("source_key").eqNullSafe(F.lit(source_key)))
        written = _write(self.spark, mine, self.root)
        stay = [s for key, s in self.sources.items() if key != source_key]
        return _publish(self.spark, self.root, stay + written, self.number + 1, self.docs_schema)


def _local(rows: DataFrame, name: str) -> DataFrame:
    """Few rows are held by the driver and sent with each task, more are written."""
    few = rows.limit(BROADCAST_TERMS // 10 + 1).collect()
    return rows.sparkSession.createDataFrame(few, rows.schema) if len(few) <= BROADCAST_TERMS // 10 else written(rows, name)


def _docs_schema(entries: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema if f.name not in ("body", "original"))


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


FILED = "term string, slab long, n int, top double, least int, ids array<long>, weights array<double>, sizes array<int>, part string"


def _filed(rows: pa.Table) -> pa.Table:
    """One slab's blocks; and how many of its entries hold a prefix, in rows without ids. Words come folded and parted by spaces."""
    rows = rows.sort_by("id").combine_chunks()
    n, ids, sizes = rows.num_rows, rows["id"].to_numpy(), rows["size"].to_numpy()
    words, owners, gains = [], [], []
    for column in (c for c in WEIGHTS if c in rows.column_names):
        for chunk in rows[column].chunks:
            lists = pc.split_pattern(chunk, " ")
            flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
            some = pc.not_equal(flat, "")
            words.append(flat.filter(some))
            owners.append(owner.filter(some).to_numpy(zero_copy_only=False).astype(np.int64))
            gains.append(np.full(len(owners[-1]), WEIGHTS[column]))
    coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode() if words else pa.array([], pa.string()).dictionary_encode()
    held = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.concatenate([np.zeros(0, np.int64), *owners])
    order = np.argsort(held, kind="stable")
    held, at = held[order], _runs(held[order])
    f = np.add.reduceat(np.concatenate([np.zeros(0), *gains])[order], at) if len(at) else np.zeros(0)
    term, owner = held[at] // n, held[at] % n
    block = _runs(term)
    ends = np.r_[block, len(term)].astype(np.int32)
    size = sizes[owner].astype(np.int32)
    terms = coded.dictionary
    out = [{
        "term": terms.take(pa.array(term[block])), "n": np.diff(ends).astype(np.int32), "top": np.maximum.reduceat(f, block) if len(block) else f, "least": np.minimum.reduceat(size, block) if len(block) else size,
        **{name: pa.ListArray.from_arrays(ends, values) for name, values in (("ids", pa.array(ids[owner])), ("weights", pa.array(f)), ("sizes", pa.array(size)))},
    }]
    lengths = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
    for letters in range(1, PREFIX + 1):
        begins = pc.utf8_slice_codeunits(terms, 0, letters).dictionary_encode()
        long = lengths[term] >= letters
        both = np.unique(begins.indices.to_numpy(zero_copy_only=False).astype(np.int64)[term[long]] * n + owner[long])
        prefix = both // n
        first = _runs(prefix)
        out.append({"term": begins.dictionary.take(pa.array(prefix[first])), "n": np.diff(np.r_[first, len(prefix)]).astype(np.int32)})
    schema = pa.schema([("term", pa.string()), ("slab", pa.int64()), ("n", pa.int32()), ("top", pa.float64()), ("least", pa.int32()), ("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int32())), ("part", pa.string())])
    slab, part = rows["slab"][0], rows["part"][0]
    return pa.concat_tables([pa.table([pa.repeat(slab, len(o["n"])) if c.name == "slab" else pa.repeat(part, len(o["n"])) if c.name == "part" else o.get(c.name, pa.nulls(len(o["n"]), c.type)) for c in schema], schema=schema) for o in out])


def _best_of_tile(blocks: pa.Table, sets: pa.Table, k: int, mean: float) -> pa.Table:
    """``number, id, score``: a tile's k best entries of each set of words, ties in order of ids."""
    found = []
    if blocks.num_rows and sets.num_rows:
        order = pc.sort_indices(blocks["term"]).to_numpy()
        terms = blocks["term"].to_numpy()[order]
        ids, owner, sizes = _owners(blocks["ids"], blocks["sizes"])
        norm = K1 * (1 - B + B * sizes / mean)
        long = pc.list_value_length(blocks["ids"]).to_numpy().astype(np.int64)
        ends, long = np.cumsum(long), long[order]
        # one column at a time, in order of terms; those that came are held by the caller
        place = np.repeat((ends[order] - np.cumsum(long)).astype(np.int32), long)
        place += np.arange(len(place), dtype=np.int32)
        ends = np.r_[0, np.cumsum(long)]
        owner, weight = owner[place], _flat(blocks["weights"], np.float64)[place]
        del place
        n, known, held_rows = len(ids), {}, 0

        def gains(prefix: str, idf: float):
            """Entries that hold a word that begins so, what it adds to each, and that of all entries where it is in many."""
            low, high = np.searchsorted(terms, prefix), np.searchsorted(terms, prefix + chr(0x10FFFF))
            at = slice(ends[low], ends[high])
            f = np.bincount(owner[at], weight[at], n)
            rows = np.flatnonzero(f).astype(np.int32)
            gain = idf * f[rows] * (K1 + 1) / (f[rows] + norm[rows])
            if len(rows) * DENSE < n:
                return rows, gain, None
            f[rows] = gain
            return rows, gain, f

        for at in range(0, sets.num_rows, ASKED):
            numbers, hits, scores = [], [], []
            for number, words, idfs in zip(*(sets[c].slice(at, ASKED).to_pylist() for c in ("number", "words", "idfs"))):
                held = []
                for w, idf in zip(words.split(" "), idfs):
                    if w not in known:
                        if held_rows > REMEMBERED:
                            known, held_rows = {}, 0
                        known[w] = gains(w, idf)
                        held_rows += len(known[w][0]) + (0 if known[w][2] is None else n)
                    held.append(known[w])
                held.sort(key=lambda x: len(x[0]))
                rows, score = held[0][0], held[0][1]
                for others, gain, of_all in held[1:]:
                    if not len(rows):
                        break
                    if of_all is None:
                        place = np.searchsorted(others, rows)
                        place[place == len(others)] = 0
                        both = others[place] == rows
                        rows, score = rows[both], score[both] + gain[place[both]]
                    else:
                        more = of_all[rows]
                        both = more > 0
                        rows, score = rows[both], score[both] + more[both]
                if len(rows) > k:
                    near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-8)
                    if len(near) > 4 * k:  # many are equal to nine places
                        near = near[np.lexsort((rows[near], -np.round(score[near], 9)))[: 2 * k]]
                    rows, score = rows[near], score[near]
                if len(rows):
                    numbers.append(np.full(len(rows), number, np.int64))
                    hits.append(ids[rows])
                    scores.append(-score)
            if numbers:
                found.append(pa.table({"number": np.concatenate(numbers), "id": np.concatenate(hits), "score": np.concatenate(scores)}))
    none = pa.table({"number": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    return pa.concat_tables([none, *found])


def _flat(lists: pa.ChunkedArray, kind: type) -> np.ndarray:
    """What lists hold, joined."""
    out, at = np.empty(sum(len(x.flatten()) for x in lists.chunks), kind), 0
    for x in lists.chunks:
        flat = x.flatten().to_numpy(zero_copy_only=False)
        out[at : at + len(flat)] = flat
        at += len(flat)
    return out


def _owners(ids: pa.ChunkedArray, sizes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, for each held one its place there, and each distinct one's size; a chunk at a time."""
    distinct = np.zeros(0, np.int64)
    for x in ids.chunks:
        distinct = np.union1d(distinct, x.flatten().to_numpy(zero_copy_only=False))
    owners, size, at = np.empty(sum(len(x.flatten()) for x in ids.chunks), np.int32), np.zeros(len(distinct), np.int64), 0
    for x, y in zip(ids.chunks, sizes.chunks):
        of = np.searchsorted(distinct, x.flatten().to_numpy(zero_copy_only=False))
        owners[at : at + len(of)] = of
        size[of] = y.flatten().to_numpy(zero_copy_only=False)
        at += len(of)
    return distinct, owners, size


def _write(spark: SparkSession, entries: DataFrame, root: str) -> list[dict]:
    """Write the tables of all sources of entries under a new version; returns what the manifest says of them.

    Texts are read twice, for their sizes and for their words, and shuffled once, by slab: all that an entry or a block
    sums up lies in one slab.
    """
    version = uuid.uuid4().hex[:16]
    texts = [c for c in WEIGHTS if c in entries.columns]
    folded = lambda c: F.coalesce(norm_term(F.col(c)), F.lit(""))
    size = F.lit(0)
    for c in texts:
        size = size + F.regexp_count(folded(c), F.lit(TOKEN))
    held = entries.where("id is not null").withColumns({"size": size, "part": part_of(F.col("source_key"))})
    shown = held.withColumn("excerpt", F.substring("body", 1, 160)).withColumn("version", F.lit(version))
    _save(shown.select(*[c for c in entries.columns if c not in ("body", "original")], "size", "excerpt", "part", "version"), f"{root}/docs", ["part", "version"], "id")
    docs = spark.read.schema(_docs_schema(entries) + ", size int, excerpt string, part string, version string").parquet(f"{root}/docs").where(F.col("version") == version)
    of_size = F.floor(4 * F.log2(F.col("size") + F.lit(1.0)))
    # neighbouring classes of size share a slab as long as they are small, large ones are dealt to several; few classes a source
    before = Window.partitionBy("part").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = docs.groupBy("part", of_size.alias("class")).agg(F.count("*").alias("_n"), F.sum("size").alias("_words")).withColumn("_group", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / SLAB))
    dealt = classes.select("part", "class", "_group", F.greatest(F.ceil(F.col("_n") / SLAB), F.ceil(F.col("_words") / SLAB_WORDS), F.lit(1)).alias("_parts"))
    dealt = F.broadcast(dealt) if dealt.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else dealt
    words = held.select("part", "id", "size", of_size.alias("class"), *[F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " ").alias(c) for c in texts])
    slabs = words.join(dealt, ["part", "class"]).withColumn("slab", F.col("_group") * 1_000_000 + F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("class", "_group", "_parts")
    filed = written(slabs.groupBy("part", "slab").applyInArrow(_filed, FILED), "filed")
    rows = filed.where("ids is not null").withColumns({"version": F.lit(version), "initial": initial_of(F.col("term"))})
    _save(rows, f"{root}/postings", ["part", "version", "initial"], "term")
    counted = filed.where("ids is null").groupBy("part", F.col("term").alias("prefix")).agg(F.sum("n").alias("df"))
    _save(counted.select("prefix", "df", "part", F.lit(version).alias("version"), initial_of(F.col("prefix")).alias("initial")), f"{root}/prefixes", ["part", "version", "initial"], "prefix")
    totals = docs.groupBy("source_key", "part").agg(F.count("*").alias("entries"), F.sum("size").alias("words"))
    return [{**r.asDict(), "version": version} for r in totals.collect()]  # one row a source


def _save(rows: DataFrame, path: str, by: list[str], order: str) -> None:
    """Append rows to a table; what lies in one partition is dealt to several tasks by size at run time, sorted for row groups."""
    rows.hint("rebalance", *by).sortWithinPartitions(*by, order).write.mode("append").partitionBy(*by).parquet(path)


def _publish(spark: SparkSession, root: str, sources: list[dict], number: int, docs_schema: str) -> TextIndex:
    rows = [(s["source_key"], s["part"], s["version"], s["entries"], s["words"], number) for s in sources] or [(None, None, None, 0, 0, number)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return TextIndex(spark, root, docs_schema)


def open_or_build(entries: DataFrame, root: str) -> TextIndex:
    """The index at root, built where there is none yet."""
    try:
        return TextIndex(entries.sparkSession, root, _docs_schema(entries))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return build(entries, root)


def version_of(spark: SparkSession, path: str) -> str:
    """A name for what a table's files hold now, by their names, sizes and times."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.agg(F.md5(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws("-", *[F.col(c).cast("string") for c in files.columns])))))).first()[0]


def build(entries: DataFrame, root: str) -> TextIndex:
    """Write the index of entries (``id, source_key, name, body`` and whatever columns hits may be filtered by) below a new root.

    Ids are distinct; entries without an id are left out. Empty texts are entries without words.
    """
    spark = entries.sparkSession
    return _publish(spark, root, _write(spark, entries, root), 1, _docs_schema(entries))
