"""Token-id files: patched frame-of-reference blocks.

Ids are written in ascending id order of their documents, in blocks of 128. A block's minimum is subtracted, what
is left is packed at the width that a percentile of the block needs, and what doesn't fit goes to an exception
list (position and value). The start of every block is indexed, so any document can be read without its
predecessors. A file is one shard: header, documents' ids and lengths, blocks, exceptions, CRC-32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library_ids import library_ids
from .storage import materialise, shared_dir, write_file

MAGIC, VERSION, BLOCK, PERCENTILE = b"PFOR", 1, 128, 0.9
HEADER = struct.Struct("<4sIqqqq")  # magic, version, documents, ids, ids of the partition before this shard, exceptions
#: Ids after which a shard is closed; a single document may exceed it.
SHARD_IDS = 1 << 20
#: What a worker's encoder holds: words, and characters of text taken together.
REMEMBERED, SLICE = 700_000, 16_000_000


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Block minima, widths, starts, exception counts, exception positions, exception values, payload."""
    n = -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.uint32).reshape(n, BLOCK) if n else np.empty((0, BLOCK), np.uint32)
    low = padded.min(axis=1) if n else np.empty(0, np.uint32)
    delta = padded - low[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    high = np.partition(delta, at, axis=1)[:, at] if n else np.empty(0, np.uint32)
    width = np.ceil(np.log2(high.astype(np.float64) + 1)).astype(np.uint8)
    out = delta > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    where, spot = np.nonzero(out)
    values = delta[where, spot]
    kept = np.where(out, np.uint32(0), delta)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    payload = np.zeros(int(start[-1]), dtype=np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        kind = "<u2" if w <= 16 else "<u4"
        bits = np.unpackbits(kept[rows].astype(kind).view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK, -1)[:, :, :w]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        payload[start[rows][:, None] + np.arange(packed.shape[1])] = packed
    return [low.astype("<u4").tobytes(), width.tobytes(), start.astype("<i8").tobytes(), np.bincount(where, minlength=n).astype(np.uint8).tobytes(), spot.astype(np.uint8).tobytes(), values.astype("<u4").tobytes(), payload.tobytes()]


def encode_shard(doc_ids: list, sizes: list[int], ids: np.ndarray, before: int) -> bytes:
    known = np.array([d is not None and d == d for d in doc_ids], dtype=np.uint8)
    keys = np.array([int(d) if k else 0 for d, k in zip(doc_ids, known)], dtype="<i8")
    low, width, start, exceptions, spot, values, payload = pack_blocks(ids)
    body = HEADER.pack(MAGIC, VERSION, len(doc_ids), len(ids), before, len(spot)) + keys.tobytes() + known.tobytes() + np.array(sizes, dtype="<i8").tobytes() + low + width + start + exceptions + spot + values + payload
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's bytes, opened; blocks are unpacked when asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token file")
        _, version, docs, self.n, self.before, exceptions = HEADER.unpack_from(data)
        if version != VERSION:
            raise ValueError(f"token file version {version}")
        at, blocks = HEADER.size, -(-self.n // BLOCK)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        self.doc_ids, self.known, self.sizes = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.low, self.width, self.start = take("<u4", blocks), take("u1", blocks), take("<i8", blocks + 1)
        self.counts, self.spots, self.values = take("u1", blocks), take("u1", exceptions), take("<u4", exceptions)
        self.payload = take("u1", int(self.start[-1]))
        self.first = np.concatenate([[0], np.cumsum(self.counts.astype(np.int64))])

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a up to b of the shard, through the index of block starts."""
        lo, hi = a // BLOCK, -(-b // BLOCK)
        delta = np.zeros((hi - lo, BLOCK), dtype=np.uint32)
        for w in np.unique(self.width[lo:hi]).tolist():
            if w:
                rows = np.flatnonzero(self.width[lo:hi] == w)
                packed = self.payload[self.start[lo:hi][rows][:, None] + np.arange(w * BLOCK // 8)]
                bits = np.zeros((len(rows), BLOCK, 16 if w <= 16 else 32), dtype=np.uint8)
                bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
                delta[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u2" if w <= 16 else "<u4")
        e = slice(self.first[lo], self.first[hi])
        delta[np.repeat(np.arange(hi - lo), self.counts[lo:hi]), self.spots[e]] = self.values[e]
        return (delta + self.low[lo:hi, None]).ravel()[a - lo * BLOCK : b - lo * BLOCK]


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write every row's ids, each closed by end_id, below out_dir; returns the manifest: part, shard, n_docs, n_ids.

    Documents are dealt to tasks by ranges of their id and sorted there (ties by text), so part and shard numbers
    follow ascending ids. A null text is empty and leaves its end id alone; null ids come first; repeated rows stay;
    an empty table writes no file. A task holds one shard at a time, and a retried task writes the same files.
    """

    def run(batches):
        codec = library_ids(tokenizer_path, REMEMBERED, SLICE)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, parts, held = [], [], [], 0

        def close() -> dict:
            nonlocal shard, before, doc_ids, sizes, parts, held
            write_file(out_dir, f"{part:06d}-{shard:06d}.pfor", encode_shard(doc_ids, sizes, np.frombuffer(b"".join(parts), dtype="<u4"), before))
            row = {"part": [part], "shard": [shard], "n_docs": [len(doc_ids)], "n_ids": [held]}
            shard, before, doc_ids, sizes, parts, held = shard + 1, before + held, [], [], [], 0
            return row

        for pdf in batches:
            for key, ids in zip(pdf["id"].astype(object).tolist(), codec.encode_each(pdf["text"].tolist(), end_id)):
                doc_ids.append(key)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                held += sizes[-1]
                if held >= shard_ids:
                    yield pd.DataFrame(close())
        if doc_ids:
            yield pd.DataFrame(close())

    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    return materialise(ranged.mapInPandas(run, "part int, shard int, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``, and ``shard_file``.

    What stands before a part is summed on the driver: one number per writing task, however large the table.
    """
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard_file string"
    if not totals:
        return spark.createDataFrame([], schema)
    base = dict(zip([p for p, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()))

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                name = path.rpartition("/")[2]
                shard = Shard(data)
                ids, ends = shard.read(0, shard.n), np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                view = memoryview(ids.astype("<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array([int(d) if k else None for d, k in zip(shard.doc_ids, shard.known)], dtype="Int64"),
                    "start": base[int(name[:6])] + shard.before + starts, "n_tokens": shard.sizes,
                    "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], "shard_file": name,
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(out_dir).select("path", "content")
    return files.mapInPandas(run, schema)


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write docs as token files in the shared folder, read them back, and return the reader's rows."""
    spark = docs.sparkSession
    out_dir = shared_dir(spark, "token-files")
    manifest = write_token_files(docs, out_dir, tokenizer_path, end_id)
    return read_token_files(spark, out_dir, manifest)
