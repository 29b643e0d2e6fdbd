"""Byte-level BPE against the public library and a merge loop written out."""

import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodegrain.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TENTH = "/root/testdata/sf0.01"
PIECES = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "1", "!", "<|endoftext|>", "é", "漢", "🙂", " ", "　", " ", "\x1c", "\x85", "\U00013460", "the", " and", "aaaa", "<|", "|>"]


@functools.cache
def parsed() -> Tokenizer:
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return parsed()


def ids_of(texts: list[str]) -> list[list[int]]:
    bounds, ids = bpe.tools(PATH)[0].encode([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_made_texts_equal_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "'", "''s", "x" * 50_000, "ab" * 20_000, " " * 9_999 + "z", "é" * 5_000, "<|endoftext|>" * 3, " <|endoftext|> 's"]
    assert ids_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    assert ids_of([text]) == [parsed().encode(text, add_special_tokens=False).ids]


def test_pair_index_equals_a_merge_loop():
    v, rng = bpe.tools(PATH)[0].v, random.Random(2)
    words = ["".join(rng.choice("aehnrst ") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)] + [b"a" * n for n in range(1, 40)]
    ranks = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(v.left, v.right, strict=True))}

    def plain(word: bytes) -> list[int]:
        symbols = [int(v.byte_ids[b]) for b in word]
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]:
            rank, i = min(pairs)
            symbols[i : i + 2] = [int(v.joined[rank])]
        return symbols

    index = bpe.PairIndex(v, words)
    index.merge()
    ids, sizes = index.result()
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(w) for w in words]


def test_full_cache_and_runs_of_several_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "DECODE_IDS", 4)
    encoder, decoder = bpe.Encoder(bpe.tools(PATH)[0].v), bpe.tools(PATH)[1]
    for texts in (["one two three four five", "", "two"], ["one", "<|endoftext|>"], [""], []):
        bounds, ids = encoder.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert list(decoder.decode(ids, bounds)) == texts


def test_decoding_any_ids(spark, library):
    """Cut characters become U+FFFD as in the library; unknown ids are passed over; nulls are empty."""
    rows = [[220, 50256, 40], [447], [447, 247], [99, 447, 99, 447, 447], [], [60_000, 40], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>")
    got = [r.t for r in df.select("i", bpe.decode(F.col("ids"), PATH).alias("t")).orderBy("i").collect()]
    assert got == [library.decode(r or [], skip_special_tokens=False) for r in rows[:5]] + [library.decode([40]), ""]


def test_odd_tables(spark):
    """Null and empty texts have no ids, repeated rows are each encoded, columns of any name are carried along, an empty table is empty."""
    docs = spark.createDataFrame([(1, None, "p"), (1, "", "d"), (None, "a b", "p"), (2, "a b", "p"), (2, "a b", "p")], "doc_id long, text string, packed string")
    both = docs.select("*", bpe.round_trip(F.col("text"), PATH).alias("decoded"))
    got = sorted((r.doc_id or 0, r.text or "", r.packed, bytes(r.decoded.packed), r.decoded.decoded) for r in both.collect())
    ab = np.array(ids_of(["a b"])[0], "<u4").tobytes()
    assert got == [(0, "a b", "p", ab, "a b"), (1, "", "d", b"", ""), (1, "", "p", b"", ""), (2, "a b", "p", ab, "a b"), (2, "a b", "p", ab, "a b")]
    assert docs.where("false").select(bpe.encode(F.col("text"), PATH)).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TENTH}/documents.parquet").collect()}
    rows = queries.op13_byte_bpe(spark, TENTH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
