"""The registered queries over a corpus folder, against their SQL or a plain version, and the pipeline's stages."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodegrain.llm import decontam, minhash
from tests.llm.test_operators import brute_groups, brute_stats

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the corpus folder")


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def get(name):
        if name not in held:
            held[name] = entry.queries()[name](spark, DATA).toPandas()
        return held[name]

    return get


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.fixture(scope="module")
def documents(tables):
    return dict(tables.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


LLM = sorted(k for k in entry.queries() if re.match(r"op\d+_", k))


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in LLM} == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [k for k in LLM if k in entry.oracle_sql()])
def test_against_sql(results, tables, name):
    got, want = results(name), tables.execute(entry.oracle_sql()[name]).df()

    def counted(df):
        df = df[sorted(df.columns)].astype(object)
        return collections.Counter(tuple(None if x is None else round(float(x), 6) if isinstance(x, (int, float)) else str(x) for x in row) for row in df.where(df.notna(), None).itertuples(index=False))

    assert sorted(got.columns) == sorted(want.columns) and counted(got) == counted(want)


def test_op3_held_out(results, tables, documents):
    got = results("op3_toxicity")
    assert set(got.doc_id) == set(documents) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    labels = dict(tables.execute("SELECT doc_id, toxic FROM labels").fetchall())
    clean = got[got.doc_id.map(labels) == 0]
    assert (clean.predicted == 0).mean() > 0.9


def test_op4_digests(results, documents):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in results("op4_pieces").itertuples():
        ids = library.encode(documents[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op5_groups(results, documents):
    want = brute_groups(list(documents.items()), 85)
    got = results("op5_minhash")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want and ((got.doc_id == got.component_id) == got.kept).all()


def test_op7_counts_and_verdicts(results, tables, documents):
    got = results("op7_quality")
    for r in got.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(documents[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    quality = dict(tables.execute("SELECT doc_id, quality FROM labels").fetchall())
    fine = got[(got.doc_id.map(quality) == 1) & ~got.base_failed]
    assert fine.kept.mean() > 0.9


def test_op9_shards(results, documents):
    got = results("op9_sharding")
    assert set(got.doc_id) == set(documents) and got["shard"].between(0, 39).all() and (got.law == "bytes").all() and got.grown_shard.isna().all()
    assert (got["size"] == got.doc_id.map(lambda d: len(documents[d].encode()) + 16)).all() and (got.text_crc32 == got.doc_id.map(lambda d: zlib.crc32(documents[d].encode()))).all()
    assert (got.groupby(got.doc_id.map(documents))["shard"].nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_op6_beats_its_base_out_of_sample(results):
    got = results("op6_language_model")
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_op8_on_marked_pages(results, tables):
    import html

    pages = dict(tables.execute("SELECT page_id, html FROM pages").fetchall())
    for r in results("op8_main_text").itertuples():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h\d|div|li|ul)\b[^>]*>", inner)
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts) if x) and r.n_chars == len(r.text)


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "pieces"]
    before = set(documents)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        if name == "near_duplicates":
            groups = minhash.near_duplicates(docs, minhash.Similarity(80)).collect()
            assert after == {r.component_id for r in groups}
        if name == "decontamination":
            assert decontam.leaks(out, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
        docs, before = out, after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == len(before) and all(r.decoded == documents[r.doc_id] for r in last.select("doc_id", "decoded").collect() if "\x00" not in documents[r.doc_id])
