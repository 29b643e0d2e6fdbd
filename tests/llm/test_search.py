"""Ranked search and hard negatives against brute force written out."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodegrain.llm import negatives, oracles, queries, search

TENTH = "/root/testdata/sf0.01"
RANKED = "doc_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """Rows (item, rank, doc, score) by the scoring rule, item by item and document by document."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 75 + 25 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d[3], -d[0]) for r, d in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=3):
    index = search.build(spark.createDataFrame(docs, RANKED))
    rows = search.search(index, spark.createDataFrame(items, "item long, text string"), k)
    return sorted(((r.item, r["rank"], r.doc_id, r.score) for r in rows.collect()), key=str)


def test_ranks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(search, "SHARD_TERMS", 40)  # many shards in a task
    monkeypatch.setattr(search, "QUERY_BYTES", 60)  # many blocks of queries
    words = ["alpha", "Beta", "ÑU", "ñu", "x1", "the", "漢字", "rare"]
    docs = [(int(i), " ,".join(rng.choice(words, rng.integers(0, 30), p=[0.1, 0.1, 0.05, 0.05, 0.1, 0.5, 0.08, 0.02]))) for i in rng.permutation(150)]
    items = [(i, " ".join(rng.choice([*words, "absent"], rng.integers(1, 9)))) for i in range(12)]
    got = run(spark, docs, items, 7)
    assert got == ranked(docs, items, 7) and len(got) > 60


def test_ties_repeats_nulls_and_odd_texts(spark):
    """Equal scores by doc_id, null ids last; repeated documents each count; equal query texts of several items, null, empty and strange queries."""
    docs = [(7, "same words"), (3, "same words"), (None, "same words"), (5, "SAME words"), (3, "same words"), (1, None), (2, ""), (4, "-- !!"), (6, "w" * 100_000 + " same"), (8, "pad " * 50_000)]
    items = [(1, "words"), (2, "words"), (2, "words"), (3, None), (4, ""), (5, "?!"), (6, "same SAME same"), (None, "pad"), (9, "never seen")]
    got = run(spark, docs, items, 4)
    assert got == ranked(docs, items, 4)
    assert [g[2] for g in got if g[0] == 1] == [3, 3, 5, 7]


def test_a_row_group_of_the_index_holds_one_shard(spark, monkeypatch):
    """However many shards a task writes, readers and writers hold one at a time."""
    monkeypatch.setattr(search, "SHARD_TERMS", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a shard for each batch
    try:
        shards = search.build(spark.createDataFrame([(i, "some words of a document " * 4) for i in range(60)], RANKED).coalesce(1)).shards
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    assert sum(g.num_rows for g in groups) > 10 and all(g.num_rows == g.num_row_groups for g in groups)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], RANKED)
    index = search.build(empty)
    assert (index.documents, index.terms) == (0, 0)
    assert search.search(index, spark.createDataFrame([(1, "a")], "item long, text string"), 5).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, terms int, docs int")
    items = spark.createDataFrame([("a", 1, 2)], "text string, query int, _block int")
    rows = search.search(search.build(docs), items, 5)
    assert {"text", "query", "_block", "doc_id", "score", "rank"} == set(rows.columns) and rows.count() == 1
    assert search.search(search.build(docs), items.where("false"), 5).count() == 0


def test_search_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TENTH}/{t}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({oracles.SEARCH})").fetchall()
    assert sorted(map(tuple, queries.op11_search(spark, TENTH).collect())) == sorted(want)


def mined(rows, rule):
    """Rows of the mining rule from all products."""
    out = []
    for a, label, v in rows:
        if a % rule.every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, k == label) for i, k, w in rows)
        for neg, p in [(s, i) for s, i, same in scores if same and i != a][: rule.positives]:
            fits = [(-s, i) for s, i, same in scores if not same and rule.least * -neg <= 100 * -s <= rule.most * -neg]
            out += [(a, p, r, i, -neg, s) for r, (s, i) in enumerate(fits[: rule.negatives], 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, vector array<int>"


@pytest.mark.parametrize("steps", [(64, 4096), (2, 7)])
def test_mining_equals_brute_force(spark, monkeypatch, steps):
    """Clusters, many equal vectors, null vectors' places taken by zero vectors and unequal lengths."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-200, 200, (5, 10))
    rows = [(int(i), int(i % 4), [int(x) for x in centres[i % 5] + rng.integers(-60, 60, 10)]) for i in range(400)]
    rows += [(400 + i, i % 3, [50] * 10) for i in range(60)] + [(500, 1, []), (501, 2, [9]), (510, 1, [0] * 10)]
    monkeypatch.setattr(negatives, "STEP_ANCHORS", steps[0])
    monkeypatch.setattr(negatives, "STEP_ROWS", steps[1])
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 20)
    rule = negatives.Mining(every=10)
    index = negatives.build(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert sorted(map(tuple, negatives.mine(index, rule).collect())) == mined(rows, rule)


@pytest.mark.parametrize("step", [64, 3])
def test_bounds_hold_and_spare_products(monkeypatch, step):
    monkeypatch.setattr(negatives, "STEP_ANCHORS", step)
    rng = np.random.default_rng(1)
    centres = rng.integers(-90, 90, (20, 16))
    data = centres[rng.integers(0, 20, 3000)] + rng.integers(-6, 6, (3000, 16))
    book = negatives.Codebook.fit(data[:1000])
    codes, residual = book.encode(data)
    anchors = data[:10]
    tables = book.tables(anchors)
    about = sum(tables[m][:, codes[:, m]] for m in range(codes.shape[1]))
    exact = anchors @ data.T
    assert (np.abs(exact - about) <= np.linalg.norm(anchors, axis=1)[:, None] * residual * (1 + 1e-9) + 1).all()
    n = len(anchors)
    looked = negatives.Windows(np.arange(n), np.zeros(n, int), anchors, np.arange(n), np.full(n, negatives.LOWEST), np.full(n, negatives.HIGHEST))
    found = negatives.Search(book, looked, 10, same=False)
    for part in np.array_split(np.arange(3000), 4):
        found.add(part, np.ones(len(part), int), codes[part], residual[part], data[part])
    top = found.result().to_pandas().groupby("window").score.apply(lambda s: sorted(s, reverse=True))
    assert all(top[i] == sorted(exact[i].tolist(), reverse=True)[:10] for i in range(n))
    assert found.exact < n * 3000 / 4


def test_odd_vectors(spark):
    """Null and non-finite components leave a row out; sizes beyond 64-bit scores are refused; repeated rows; an empty table."""
    raw = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("-inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [])], "i int, v array<float>")
    assert [r.s for r in raw.select(negatives.scaled(F.col("v")).alias("s")).collect()] == [[128, -1], None, None, None, None, []]
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (1, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [2, 3]), (2, 2, [2, 3])]
    index = negatives.build(spark.createDataFrame(rows, VECTORS).withColumn("codes", F.lit("clash")))
    assert sorted(map(tuple, negatives.mine(index).collect())) == sorted([(0, 1, r, 2, 25, 18) for r in (1, 2)] * 2)
    assert negatives.mine(negatives.build(spark.createDataFrame([], VECTORS))).count() == 0
    with pytest.raises(ValueError, match="below"):
        negatives.build(spark.createDataFrame([(0, 1, [1 << 24])], VECTORS))


def test_negatives_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{TENTH}/embeddings.parquet'")
    want = con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({oracles.NEGATIVES})").fetchall()
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, TENTH).collect())) == sorted(want)
