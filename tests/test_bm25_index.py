import random

import numpy as np
import pytest

from larkspur.operators import bm25_index as bx
from larkspur.operators import sparse
from larkspur.operators.bm25_index import Bm25Index

SCHEMA = "doc_id long, content string"


def corpus(seed, n=300):
    """Words by a steep law, so that there are terms in all documents and in one; texts without words; lengths of 1 to 80."""
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(20_000)]
    return [(i * 3, None if i == 5 else "" if i == 9 else " ".join(["the"] * (i % 3) + [r.choice(words) for _ in range(r.randrange(1, 80))])) for i in range(n)]


def queries(seed, rows, n=40):
    r = random.Random(seed)
    texts = [t for _, t in rows if t]
    return [(i, " ".join(r.choice(texts).split()[: r.randrange(1, 12)] + ["THE"] * r.randrange(3))) for i in range(n)] + [(900, "nowhere"), (901, ""), (902, "w1 w1 w2")]


def listed(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(bx, "RANGE_DOCS", 50)
    monkeypatch.setattr(bx, "BLOCK_DOCS", 8)
    monkeypatch.setattr(bx, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(bx, "FIRST_POSTINGS", 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_scan(spark, tmp_path, small, seed):
    rows = corpus(seed)
    c, q = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(queries(seed, rows), "query_id long, query string")
    index, reads = Bm25Index.build(c, f"{tmp_path}/i"), []
    assert listed(bx.search(index, q, 4, reads=reads)) == listed(sparse.search(c, q, 4))
    seen = bx.reading(index, reads).first()
    assert 0 < seen.read_blocks and seen.index_blocks > 500


def test_negative_weights_and_few_hits(spark, tmp_path, small):
    """Two documents of three words: most odds are negative, and so is their mean."""
    rows = [(1, "a b"), (2, "a b c"), (3, "a"), (4, "a b")]
    c, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "a b c"), (2, "c"), (3, "a a")], "query_id long, query string")
    assert listed(bx.search(Bm25Index.build(c, f"{tmp_path}/i"), q, 3)) == listed(sparse.search(c, q, 3))


def test_add_and_merge(spark, tmp_path, small):
    rows = corpus(3)
    c, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries(3, rows), "query_id long, query string")
    path, want = f"{tmp_path}/i", listed(sparse.search(c, q, 5))
    first = Bm25Index.build(c.where("doc_id < 300"), path)
    before = listed(bx.search(first, q, 5))
    second = first.add(c.where("doc_id >= 300 and doc_id < 600")).add(c.where("doc_id >= 600"))
    assert len(second.segments) == 3 and listed(bx.search(second, q, 5)) == want
    third = second.merge()
    assert len(third.segments) == 1 and listed(bx.search(Bm25Index.open(spark, path), q, 5)) == want
    assert listed(bx.search(first, q, 5)) == before  # a reader keeps its version
    assert (third.n_docs, third.vocabulary) == (300, sparse.index_stats(c).first().vocabulary)
    with pytest.raises(ValueError, match="already"):
        third.add(c.where("doc_id = 30"))


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        Bm25Index.open(spark, f"{tmp_path}/none")


def test_few_blocks_for_a_rare_and_a_common_word(spark, tmp_path, small, monkeypatch):
    """One document holds both words; the common word's other blocks are not read."""
    monkeypatch.setattr(bx, "FIRST_POSTINGS", 1)
    c = spark.createDataFrame([(i, "common " * (1 + (i == 150)) + f"x{i}" + " pad" * (i % 5) + (" rare" if i == 150 else "")) for i in range(400)], SCHEMA)
    index, reads = Bm25Index.build(c, f"{tmp_path}/i"), []
    got = bx.search(index, spark.createDataFrame([(1, "rare common")], "query_id long, query string"), 1, reads=reads)
    assert [r.doc_id for r in got.collect()] == [150]
    assert bx.reading(index, reads).first().read_blocks < 6  # of 50 and more of the common word


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (100, 1), (128, 300), (7, 70_000)):
        places, counts = np.sort(r.choice(4096, n, replace=False)), r.integers(1, top + 1, n)
        p, c = bx.unpacked(bx.packed(places, counts), n)
        assert (p == places).all() and (c == counts).all()


def test_a_build_tokenises_once_and_after_the_ranges(spark, tmp_path, monkeypatch):
    from larkspur.operators import bm25_index

    plans, plain = [], bm25_index.tokenised
    monkeypatch.setattr(bm25_index, "tokenised", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or plain(df))
    rows = [(i, "a b " * (i % 5) + "c") for i in range(100)] + [(None, "lost words"), (100, None)]
    made = bm25_index.Bm25Index.build(spark.createDataFrame(rows, "doc_id long, content string"), f"{tmp_path}/i")
    assert (made.n_docs, made.total) == (101, sum(2 * (i % 5) + 1 for i in range(100)))
    assert len(plans) == 1 and "Sort" in plans[0] and "RepartitionByExpression" in plans[0]
