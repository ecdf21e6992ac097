import numpy as np
import pytest

from larkspur.operators import dense
from larkspur.operators import vector_index as vx


@pytest.mark.parametrize("k", [1, 3, 20])
def test_best_equals_a_sort_of_all(k):
    r = np.random.default_rng(k)
    s = r.choice([0.1, 0.2, 0.3, 0.3 + 2e-10, 0.5, -np.inf], (7, 400))  # ties, some by rounding only
    doc = r.permutation(400)
    best = dense.Best(9, k)
    for a in range(0, 400, 13):
        best.add(np.arange(7), s[:, a : a + 13], doc[a : a + 13], lambda v: np.round(v, 9))
    query, got, key, value = best.rows()
    for i in range(7):
        want = np.lexsort((doc, -np.round(s[i], 9)))[:k]
        at = query == i
        assert got[at].tolist() == doc[want].tolist() and key[at].tolist() == np.round(s[i], 9)[want].tolist() and value[at].tolist() == s[i][want].tolist()
    assert not (query >= 7).any()


def test_a_task_sends_k_rows_a_query(spark):
    """Before, each 1,024 rows of a task sent k rows a query."""
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(5000, 8)))], "doc_id long, embedding array<float>").coalesce(1)
    part, _ = dense._block(df, df.where("doc_id % 1000 = 0").selectExpr("doc_id AS query_id", "embedding"), 4, "cosine")
    assert part.count() == 5 * 4


def test_codes_of_a_task_are_k_rows_a_query_too():
    import pyarrow as pa

    r = np.random.default_rng(2)
    model = vx.Model(r.normal(size=(6, 8)), r.normal(size=(4, 16, 2)))
    codes, cell, q = r.integers(0, 16, (3000, 4)).astype(np.uint8), np.sort(r.integers(0, 6, 3000)).astype(np.int32), r.normal(size=(5, 8))
    cells = model.nearest_cells(q, 4)

    def scan(keep):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 500)), pa.array(cell[a : a + 500]), pa.array([c.tobytes() for c in codes[a : a + 500]], pa.binary())], names=["doc_id", "cell", "code"]) for a in range(0, 3000, 500)]
        return [x for b in vx._code_scores(model, np.arange(5) + 100, q, cells, keep)(iter(batches)) for x in b.to_pylist()]

    got = scan(7)
    assert len(got) == 5 * 7
    full = np.stack([model.centres[cell[i]] + np.concatenate([model.books[m, codes[i, m]] for m in range(4)]) for i in range(3000)])
    for i in range(5):
        s = np.where(np.isin(cell, cells[i]), full @ q[i], -np.inf)
        want = np.lexsort((np.arange(3000), -s))[:7]
        mine = sorted((x for x in got if x["query_id"] == 100 + i), key=lambda x: -x["score"])
        assert np.allclose([x["score"] for x in mine], s[want]) and all(x["cell"] == cell[x["doc_id"]] for x in mine)
    held, vx.HELD = vx.HELD, 10  # too many to hold: each batch's best ones
    try:
        assert {(x["query_id"], x["doc_id"]) for x in got} <= {(x["query_id"], x["doc_id"]) for x in scan(7)}
    finally:
        vx.HELD = held


def test_many_codes_a_query_are_not_shuffled(spark, tmp_path):
    """Vectors without structure: before, `refine` times k rows a query were shuffled and joined, a share of all rows."""
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(3000, 16)))], "doc_id long, embedding array<float>").repartition(3)
    index = vx.VectorIndex.build(df, f"{tmp_path}/i", cells=8)
    assert index.model.refine * 10 * vx.FEW > 3000
    asked = df.where("doc_id % 100 = 0").selectExpr("doc_id AS query_id", "embedding")
    near, exact = ({(x.query_id, x.doc_id): x.score for x in y.collect()} for y in (vx.search(index, asked, 10), dense.search(df, asked, 10)))
    both = near.keys() & exact.keys()
    assert len(both) >= 0.95 * len(exact) and all(abs(near[x] - exact[x]) < 1e-6 for x in both)
    few, vx.FEW = vx.FEW, 0  # by codes, as where few are needed
    try:
        coded = {(x.query_id, x.doc_id) for x in vx.search(index, asked, 10).collect()}
    finally:
        vx.FEW = few
    assert len(coded & exact.keys()) >= 0.9 * len(exact) and len(both) >= len(coded & exact.keys())


def test_places_of_codes(spark, tmp_path):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.repeat(r.normal(size=(300, 8)), 3, axis=0))], "doc_id long, embedding array<float>").repartition(3)
    index = vx.VectorIndex.build(df, f"{tmp_path}/i", cells=6)
    rows = sorted(index.rows().collect())
    q = [float(x) for x in r.normal(size=8)]
    cells = index.model.nearest_cells(np.array([q]), 4)[0]
    open_rows = [x for x in rows if x.cell in cells]
    score = {x.doc_id: round(float(index.model.decoded(np.frombuffer(x.code, np.uint8)[None], x.cell)[0] @ np.array(q)), 9) for x in open_rows}
    want = {d: i + 1 for i, d in enumerate(sorted(score, key=lambda d: (-score[d], d)))}
    from pyspark.sql import Row

    near = [Row(query_id=9, doc_id=x.doc_id, cell=x.cell, code=x.code) for x in open_rows[::40]]
    assert vx.code_ranks(index, {9: q}, near, {9: cells}) == {(9, p.doc_id): want[p.doc_id] for p in near}
