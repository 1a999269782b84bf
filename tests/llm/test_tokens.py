"""Operators on tokens: BPE codec, token files, packing, token counts, each against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm import bpe, packing, queries, token_counts, token_files
from lorekeep.llm.library_ids import LibraryIds
from lorekeep.llm.storage import shared_dir

BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b", "a\n\n b \n\n\tc", "x<|endoftext|>y <|endoftext|>", "<|startoftext|>x<|endoftext", "it's WE'LL 's  'S x's. don't", "é漢字 ñ　x \x1c y\x85z", "a" * 3000, "ab" * 50 + " " + "\n" * 9 + "z",
    "123 4567 ½ ٠ 12,34.5!? ...", " lead", "trail ", "\n x", "ΣΑΣ Σ İI ß ǅ Å", "İ̱x", "\U0001e4ec\U0001e4ee", "a\U0001e4ee\u0331 \u0130\u0331", "a​b\xa0c d᠎e", "a ̈b é",
]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def table(spark, rows, schema="doc_id long, text string, ids string, start int, n_tokens string, _rank int, id int"):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


ROWS = [(3, "Hello, world"), (1, None), (2, ""), (2, ""), (None, "no id"), (7, "word " * 9000), *[(100 + i, t) for i, t in enumerate(ODD)]]


def test_codec_on_odd_texts(library):
    codec = bpe.ByteCodec(BYTE)
    for text in ODD:
        _, _, ids, counts = next(codec.encode([text]))
        want = library[BYTE].encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and counts.tolist() == [len(want)], text
        assert codec.decode(ids) == library[BYTE].decode(want, skip_special_tokens=False)


CODEC, IDS, COUNTER = bpe.ByteCodec(BYTE), LibraryIds(WORD), token_counts.Transducer(WORD)
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcAB'stlre .,!0½éΣ漢\n\t\xa0　<|>")), max_size=60))
def test_random_texts(text):
    assert next(CODEC.encode([text]))[2].tolist() == LIBRARY[BYTE].encode(text, add_special_tokens=False).ids
    want = LIBRARY[WORD].encode(text, add_special_tokens=False).ids
    assert next(IDS.encode([text]))[2].tolist() == want
    assert next(COUNTER.count([text])).tolist() == [len(want)]


def strings(seed, n):
    """Random texts: letters, pieces of the vocabulary, marks, newer Unicode letters and rare separators."""
    rng = random.Random(seed)
    vocabulary = [w.replace("</w>", "") for w in LIBRARY[WORD].get_vocab()]
    near = [*map(chr, [*range(32, 0x250), *range(0x370, 0x530), 0x180E, *range(0x1C, 0x20), 0x85, 0x200B, 0x2028, 0x1C89, 0x1C8A, 0xA7DA, 0xA7CB, 0x1DFDF])]
    far = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    kinds = [lambda: rng.choice("abcdefghij"), lambda: rng.choice(vocabulary), lambda: rng.choice("aAB'stlre .,!0½Σ漢\n\t\xa0<|>"), lambda: rng.choice(near), lambda: chr(rng.choice(far))]
    return ["".join(kind() for _ in range(rng.randint(0, 24))) for kind in (rng.choice(kinds) for _ in range(n))]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_many_strings_equal_the_library(path):
    texts = strings(11, 20_000)
    want = [e.ids for e in LIBRARY[path].encode_batch_fast(texts, add_special_tokens=False)]
    if path == WORD:
        assert np.concatenate(list(COUNTER.count(texts))).tolist() == list(map(len, want))
        assert [x.tolist() for _, _, ids, counts in IDS.encode(texts) for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    else:
        got = [x.tolist() for _, _, ids, counts in CODEC.encode(texts) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want


def test_a_word_that_stays_pending_is_merged_alone():
    """Its neighbours in the slice are still counted by the machine."""
    machine = token_counts.Transducer(WORD)
    rng = random.Random(1)
    texts = ["the cat sat", "x " + "".join(rng.choice("ab") for _ in range(900)) + " on the mat", None, "", "b" * 2000 + " end"]
    machine_merged, asked = machine._merged, []
    machine._merged = lambda symbols: asked.append(len(symbols)) or machine_merged(symbols)
    token_counts.PENDING, before = 3, token_counts.PENDING
    try:
        got = np.concatenate(list(machine.count(texts))).tolist()
    finally:
        token_counts.PENDING = before
    assert got == [len(LIBRARY[WORD].encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert 900 in asked and sum(asked) < 2 * sum(len(t or "") for t in texts)


def test_tokens_apart_are_those_that_merging_leaves():
    rng, m = random.Random(4), COUNTER.merges
    inner = list(COUNTER.inner.items())
    for _ in range(3000):
        (a, i), (b, j) = rng.choice(inner), rng.choice(inner)
        symbols = np.frombuffer(a + b + b"x", dtype=np.uint8)
        # without the last symbol, which is of another kind, no word end takes part
        ids = list(m.first[symbols[:-1]])
        while True:
            ranks = [m.ranks.get(int(x) << 16 | int(y), 1 << 40) for x, y in zip(ids, ids[1:])]
            if not ranks or min(ranks) == 1 << 40:
                break
            at = ranks.index(min(ranks))
            ids[at : at + 2] = [int(m.made[ranks[at]])]
        assert COUNTER.apart(i, j) == (ids == [i, j])


def test_states_are_few_and_transitions_emit():
    machine = token_counts.Transducer(WORD)
    list(machine.count(["the cat sat on the mat " * 50]))
    assert 1 < len(machine.states) < 60 and machine.table.size < 60
    moves = machine.table.values[machine.table.keys >= 0]
    finals = machine.table.keys[machine.table.keys >= 0] % 512 >= 256
    assert (moves[finals] >> 16 == token_counts.START).all() and (moves[finals] & 0xFFFF > 0).all()


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 100_000, "the " * 100_000, "!" * 100_000, "é" * 50_000, "1" * 50_000])
def test_long_words_are_counted_in_proportion(text):
    began = time.time()
    assert int(next(COUNTER.count([text]))[0]) == len(LIBRARY[WORD].encode(text, add_special_tokens=False).ids)
    assert time.time() - began < 20


def test_words_whose_states_would_grow_are_merged(monkeypatch):
    monkeypatch.setattr(token_counts, "PENDING", 3)
    machine = token_counts.Transducer(WORD)
    texts = ["internationalization of xylophones", "", "plain"]
    assert next(machine.count(texts)).tolist() == [len(LIBRARY[WORD].encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Transducer(BYTE)


def test_lone_and_lockstep_trees_agree():
    merges = CODEC.merges
    words = [b"tionthetion" * 5, b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"a", "naïveté".encode()]
    assert merges.encode(words) == [merges._alone(w) for w in words]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 16])
def test_chunk_maps_compose(monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    together = next(COUNTER.count(ODD)).tolist()
    assert together == [len(LIBRARY[WORD].encode(t, add_special_tokens=False).ids) for t in ODD]
    for text in ODD:
        assert int(next(COUNTER.count([text]))[0]) == len(LIBRARY[WORD].encode(text, add_special_tokens=False).ids), text


def test_op5(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    got = queries.op5_bpe_roundtrip(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, text in docs.items():
        ids = library[BYTE].encode(text, add_special_tokens=False).ids
        r = got.loc[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op10(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    got = queries.op10_token_counts(spark, sf).toPandas().set_index("doc_id")
    want = {i: len(library[WORD].encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert got.n_tokens.to_dict() == want and got.n_bytes.to_dict() == {i: len(t.encode()) for i, t in docs.items()}
    assert got.over_limit.to_dict() == {i: n > 2048 for i, n in want.items()}


def test_edge_tables(spark, library):
    docs, none = table(spark, ROWS), table(spark, [])
    counted = token_counts.count_tokens(docs, WORD).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library[WORD].encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in counted) == want
    coded = bpe.encode_documents(docs, BYTE).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.decoded) for r in coded) == sorted((-1 if i is None else i, t or "") for i, t in ROWS)
    for empty in (token_counts.count_tokens(none, WORD), bpe.encode_documents(none, BYTE), token_files.token_file_digest(none, WORD), packing.pack_documents(none, WORD)):
        assert empty.count() == 0


def test_token_files(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = queries.op4_token_files(spark, sf).toPandas().sort_values("doc_id")
    at = 0
    for r, text in zip(got.itertuples(), docs.text):
        ids = np.array([*library[WORD].encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_odd_rows_in_small_shards(spark, library):
    docs, out = table(spark, ROWS), shared_dir(spark, "t")
    manifest = token_files.write_token_files(docs, out, WORD, 1, shard_ids=50)
    rows = sorted(token_files.read_token_files(spark, out, manifest).collect(), key=lambda r: r.start)
    assert len({r.shard_file for r in rows}) > 3 and [r.doc_id for r in rows] == sorted([i for i, _ in ROWS], key=lambda x: -1 if x is None else x)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(ids):
    shard = token_files.Shard(token_files.encode_shard([1, None], [len(ids), 0], np.array(ids, dtype=np.uint32), 9))
    assert shard.read(0, shard.n).tolist() == ids and shard.before == 9
    if ids:
        a = len(ids) // 3
        assert shard.read(a, len(ids)).tolist() == ids[a:]


def test_damaged_file_is_refused():
    data = bytearray(token_files.encode_shard([1], [3], np.array([1, 2, 3], dtype=np.uint32), 0))
    data[-6] ^= 1
    with pytest.raises(ValueError):
        token_files.Shard(bytes(data))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_place_every_length_once(histogram):
    counts = np.zeros(65, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    used = np.zeros(65, dtype=np.int64)
    for parts, times in packing.plan_windows(counts, 64):
        assert 0 < sum(parts) <= 64 and times > 0
        for n in parts:
            used[n] += times
    assert (used == counts).all()


def test_packing(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    got = queries.op2_pack_sequences(spark, sf).toPandas()
    for i, pieces in got.sort_values("start").groupby("doc_id"):
        ids, at = np.array([*library[WORD].encode(docs[i], add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for p in pieces.itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert set(got.doc_id) == set(docs.index)
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == np.cumsum([0, *pieces.length])[:-1].tolist() and pieces.length.sum() <= 4096
    assert got.sequence_id.nunique() * 4096 < 1.05 * got.length.sum()


def test_packing_of_odd_rows_and_bad_lengths(spark):
    got = packing.pack_documents(table(spark, ROWS), WORD).toPandas()
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum() and len(got[got.start == 0]) == len(ROWS)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 5000)], "doc_id long, start long, length long"))
