import numpy as np
import pytest

from larkspur.operators import dense
from larkspur.operators import vector_index as vx
from larkspur.operators.vector_index import VectorIndex

SCHEMA = "doc_id long, embedding array<float>"


def corpus(seed, n=900, size=24, groups=12):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(groups, size))
    x = middles[r.integers(0, groups, n)] + 0.35 * r.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def asked(df, k):
    return df.where(f"doc_id % {k} = 0").selectExpr("doc_id AS query_id", "embedding")


def found(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('vectors')}/i"
    df = spark.createDataFrame(corpus(1) + [(5000, None)], SCHEMA).repartition(3)
    return df, VectorIndex.build(df, path, cells=40)


def test_recall_with_a_quarter_of_the_files(spark, built):
    df, index = built
    opened = []
    got, exact = found(vx.search(index, asked(df, 30), 10, opened=opened)), found(dense.search(df, asked(df, 30), 10))
    assert len(got & exact) >= 0.95 * len(exact)
    total = vx.files(index)
    assert len(opened) > 1 and max(vx.files(index, c) for c in opened) <= total / 4


def test_all_cells_and_all_rows_are_exact(spark, built):
    df, index = built
    got = vx.search(index, asked(df, 100), 5, probes=40, refine=200, share=1.0)
    want = dense.search(df, asked(df, 100), 5)
    rounded = lambda x: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in x.collect())
    assert rounded(got) == rounded(want)


def test_open_add_and_errors(spark, built, tmp_path):
    df, index = built
    with pytest.raises(ValueError, match="no index"):
        VectorIndex.open(spark, f"{tmp_path}/none")
    path = f"{tmp_path}/i"
    VectorIndex.build(df.where("doc_id < 600"), path, cells=20).add(df.where("doc_id >= 600 and doc_id < 5000"))
    again = VectorIndex.open(spark, path)
    assert again.rows().count() == 900
    new = df.where("doc_id = 700").selectExpr("doc_id AS query_id", "embedding")
    assert [r.doc_id for r in vx.search(again, new, 1).collect()] == [700]
    with pytest.raises(Exception, match="dimensions"):
        again.add(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA))


def test_blocks_hold_neighbours():
    cells = np.array([[0, 1], [5, 6], [1, 0], [6, 5], [0, 1], [9, 2]])
    got = vx.blocks(cells, 2)
    assert sorted(i for b in got for i in b.tolist()) == list(range(6))
    assert all(len(np.unique(cells[b])) <= 2 for b in got) and len(got) == 3
