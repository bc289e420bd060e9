"""Encoding, token files and packing against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenstock.llm import packing, rans
from lumenstock.llm.bpe import Bpe, encode_documents, encoding_digests
from lumenstock.llm.chunks import Library, chunk_keys, encode_texts, library_encodings, literal

from .support import no_documents, odd_documents

public = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a  b\t\n c \n\n", "\x1cab\x1d c", "é" * 700 + " ", "I'm you'll 123 4 　 \xa0x", "\n", "foo\t bar", "<|endoftext|> a<|startoftext|>", "Σας ΟΔΟΣ İ", "á ́ é", "日本語 テスト", "\x00abc abc", " \x00abc", "a\ǹb", "\x85 a​b", "don't!!! x'!! 12%% –$$ ÀB.", "word$$$ word, word", "ſ ß ÿ Ā"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_encode_like_the_whole_text(spark, sf_dir, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(name))
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(100).collect()]
    got = [np.frombuffer(b, "<u4").tolist() for b in encode_texts(library_encodings(public.path(name)), texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert all("".join(map(literal, chunk_keys(x))) == x for x in texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_encode_like_the_library(name):
    """Special strings, letters that change when lower-cased or composed, marks, contractions, odd spaces."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(public.path(name)), random.Random(9)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "İ", "BELEDİYESİ", "e\u0301", "É", "ß", "ﬁ", "क़", "\u0307", "²", "Å", "Ǆ",
             "it's", "'ll", "'S", "I'M", "word", "Words", "THE", "12", "3.5", ".", ",", "!?", "...", "-", "_", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2028", "日本", "\U0001f600", "ѐ", "Σς"]
    own = Library(public.path(name), size=50)
    for _ in range(10_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        (got,) = own.texts([text])
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert len(own) <= 50 and len(own.words) <= 50


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_are_encoded_once_and_directly(name):
    """A word and the same word before punctuation share one call of the model, and the whole way is not taken."""
    from tokenizers import Tokenizer

    t, own, calls = Tokenizer.from_file(public.path(name)), Library(public.path(name), size=50), []
    tokenize = own.tokenize
    own.tokenize = lambda word: calls.append(word) or tokenize(word)
    text = "x Wherer Wherer, Wherer... (Wherer) x' don't"
    (got,) = own.texts([text])
    assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert sum("herer" in c for c in calls) == 1 and set(own.spaced) >= {"Wherer", "x"}
    own.forget()
    assert not own.spaced


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), Bpe(path)


def test_matrix_merges_equal_the_library(multi):
    library, own = multi
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abthein gs\n.,éß") for _ in range(rng.randrange(300))) for _ in range(200)] + ["ab" * 3000, "z" * 999]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_encoding_digests(spark, multi):
    library, _ = multi
    docs = odd_documents(spark)
    want = sorted((r.doc_id, len(i := library.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect() if r.doc_id is not None)
    assert sorted(map(tuple, encoding_digests(docs).collect())) == want
    assert encoding_digests(no_documents(spark)).count() == 0
    back = {r.doc_id: bytes(r.decoded).decode() for r in encode_documents(docs).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.collect() if r.doc_id is not None)


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (31, 3), (50_000, 900), (40_000, 40_000)])
def test_coder_round_trip_and_checkpoints(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, kinds - 1).astype("<u4") * 3
    symbols, counts = np.unique(np.append(ids, np.arange(kinds) * 3), return_counts=True)
    coder = rans.Coder(symbols.astype("<u4"), rans.frequencies(symbols, counts))
    words, starts, states, steps = coder.encode(ids)
    assert coder.decode(words, starts, states, steps)[:n].tolist() == ids.tolist()
    if len(starts) > 2:  # one segment from its checkpoint alone
        size = steps * rans.LANES
        assert coder.decode(words, starts[1:2], states[1:2], steps).tolist() == ids[size:2 * size].tolist()
    if n == 50_000:
        p = counts / counts.sum()
        assert words.nbytes < 1.1 * (-(np.log2(p[np.searchsorted(symbols, ids)])).sum() / 8) + 6000


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = odd_documents(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None))
    ids = [np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4") for _, x in rows]
    starts = np.cumsum([0] + [len(i) for i in ids])
    want = sorted((d, int(s), len(i), zlib.crc32(i.tobytes())) for (d, _), s, i in zip(rows, starts, ids))
    assert sorted(map(tuple, rans.token_digests(docs, block_ids=2000).collect())) == want
    assert rans.token_digests(no_documents(spark)).count() == 0


def test_damaged_block_is_noticed(spark):
    folder = rans.write_tokens(odd_documents(spark))
    blocks = spark.read.parquet(folder)
    from pyspark.sql import functions as F

    blocks.withColumn("words", F.when(F.col("kind") == "block", F.concat(F.col("words"), F.lit(b"\x01\x02\x03\x04"))).otherwise(F.col("words"))).write.parquet(folder + "-bad")
    with pytest.raises(Exception, match="damaged block"):
        rans.read_tokens(spark, folder + "-bad").count()


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        items = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 9)))
        room = rng.randrange(1, 80)
        got = packing.fullest(room, sorted(items.items(), reverse=True))
        assert not Counter(got) - items
        sums = {0}
        for k in items.elements():
            sums |= {s + k for s in sums}
        assert sum(got) == max(s for s in sums if s <= room)


def test_combinations_use_every_piece():
    counts = {4096: 7, 3000: 5, 1096: 3, 7: 100, 1: 2}
    used = Counter()
    for uses, copies in packing.combinations(counts, 4096):
        assert sum(k * c for k, c in copies.items()) <= 4096
        used.update({k: uses * c for k, c in copies.items()})
    assert used == counts


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs = odd_documents(spark)
    got = packing.pack(docs).toPandas()
    want = []
    for r in docs.collect():
        if r.doc_id is not None:
            ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
            want += [(r.doc_id, i, at, len(p := ids[at:at + 4096]), zlib.crc32(p.tobytes())) for i, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.length.cumsum() - g.length).tolist() == g.offset.tolist() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)
    assert packing.pack(no_documents(spark)).count() == 0
