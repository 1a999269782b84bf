"""Token alignment against the two libraries and a plain reading of the definition."""

import base64
import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lorekeep.llm import alignment, queries
from lorekeep.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    ranks = {int(r): base64.b64decode(t) for t, r in map(str.split, open(tokenizer_path("byte_bpe_50k.tiktoken")))}
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def spell(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        data = (" " + text).encode()
        if b"".join(ranks[i] for i in x) != data or b"".join(map(spell, y)) != data:
            return [], []
        out = []
        for ids, size in ((x, lambda i: len(ranks[i])), (y, lambda i: len(spell(i)))):
            at, cut = 0, []
            for i in ids:
                cut.append((at, at + size(i), i))
                at += size(i)
            out.append(cut)
        return out

    return tokens


def brute(texts, tokens):
    cut = [tokens(t) for t in texts]
    links = [[(x, y) for a, b, x in A for c, d, y in B if a < d and c < b] for A, B in cut]
    count = Counter(p for some in links for p in some)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (A, B), some in zip(cut, links):
        ends = sorted({e for _, e, _ in A} & {e for _, e, _ in B})
        groups = [",".join(str(i) for s, e, i in A if a <= s and e <= b) + "|" + ",".join(str(i) for s, e, i in B if a <= s and e <= b) for a, b in zip([0, *ends], ends)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(A), len(B), len(groups), len(some), sum(count[p] == best[p[1]] for p in some), sum(count[p] for p in some), digest))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op11(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    short = docs[docs.text.str.len() < 3000]
    got = alignment.align_documents(spark.createDataFrame(short[["doc_id", "text"]]), *PATHS).toPandas().set_index("doc_id").loc[short.doc_id]
    assert [tuple(r) for r in got[list(COLUMNS)].itertuples(index=False)] == brute(short.text.tolist(), both)
    every = queries.op11_token_alignment(spark, sf).toPandas().set_index("doc_id")
    assert sorted(every.index) == sorted(docs.doc_id)
    for key, text in zip(docs.doc_id, docs.text):
        x, y = both(text)
        assert (every.n_a[key], every.n_b[key]) == (len(x), len(y))


ODD = [None, "", " ", "  ", " a", "a ", "a  b", "a\n b", "\n", "a \n b", "\x00 a", "<|endoftext|> and <s>", "a▁b c", "▁", "don't  'll", "\xa0 x \xa0", "1 2  3", "中文 字符，。", "ab́ c", "\U0001f600 \U0001f600", "x" * 3000, "word " * 4000, "᠎ \u0085 a", "​ b", "ﬁ Å é", "\t\ta  ", "\x1c \x1f b"]


def test_odd_texts(spark, both):
    frame = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t, "x", [i]) for i, t in enumerate(ODD)], "doc_id long, text string, block string, pairs array<int>").repartition(2)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(frame, *PATHS).collect()]
    assert sorted(got) == sorted(brute(ODD, both))
    assert alignment.align_documents(frame.limit(0), *PATHS).count() == 0


def test_many_strings(both, monkeypatch):
    """Parts put together are what the libraries make of the whole text."""
    rng = random.Random(3)
    letters = ["a", "b", "the", "é", " ", " ", "  ", "\n", "\t", "\xa0", "'s", "1", "23", ".", "!", "ß", "中", "▁", "<s>", "́", "\U0001f600", "　", "퟿", "\x00", "ing", "tion"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(4000)]
    monkeypatch.setattr(alignment, "REMEMBERED", 500)
    codec = alignment.Aligner(*PATHS)
    for at in range(0, len(texts), 200):
        some = texts[at : at + 200]
        got = codec.block(some)
        for text, digest in zip(some, got["digests"]):
            x = codec.whole(text)
            assert digest == ("" if not len(x.a) else hashlib.sha256(codec.spelled(x)[0][:-1]).hexdigest()), repr(text)
            assert x.a.tolist() == [i for *_, i in both(text)[0]]


def test_groups(spark, both):
    texts = ["one two three", None, "Étion dans, çouelle", "a▁b"]
    rows = alignment.token_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *PATHS).collect()
    assert {r["doc_id"] for r in rows} == {0, 2}
    for key in (0, 2):
        mine = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["place"])
        x, y = both(texts[key])
        assert [i for r in mine for i in r["a"]] == [i for *_, i in x] and [i for r in mine for i in r["b"]] == [i for *_, i in y]
        assert mine[0]["start"] == 0 and mine[-1]["end"] == len((" " + texts[key]).encode()) and all(p["end"] == q["start"] for p, q in zip(mine, mine[1:]))


def test_blocks_are_stored_and_read_few_at_a_time(spark, both, monkeypatch):
    """Row groups, and pages in them, don't grow with the blocks of a task."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=20_000)) for _ in range(60)]
    monkeypatch.setattr(alignment, "BLOCK", 100_000)
    monkeypatch.setattr(alignment, "STORED_BYTES", 1 << 20, raising=False)
    found = alignment.align_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), *PATHS)
    stored = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in found.inputFiles() if "aligned-blocks" in f]
    groups = [m.row_group(i) for m in stored for i in range(m.num_row_groups)]
    rows, total = sum(g.num_rows for g in groups), sum(g.total_byte_size for g in groups)
    assert rows == len(texts) and total > 3 << 20
    assert max(g.total_byte_size for g in groups) < (1 << 20) + 4 * total / rows
    short = {r["doc_id"]: (r["n_a"], r["n_b"]) for r in found.collect()}
    assert all(short[i] == tuple(map(len, both(t))) for i, t in enumerate(texts[:2]))
