import os

import pytest
from pyspark.sql import functions as F

from larkspur.functions import models
from larkspur.functions.models import Overloaded, Pace
from larkspur.operators import dense
from larkspur.plans import adaptive


def test_calls_by_budget_across_batches(spark, tmp_path):
    """A model is made once a worker process; no call passes the budget; calls are full whatever the batches are."""
    log = str(tmp_path / "log")

    def factory():
        with open(log, "a") as f:
            f.write(f"made {os.getpid()}\n")

        def model(texts):
            with open(log, "a") as f:
                f.write(f"call {sum(map(len, texts))}\n")
            return [t.upper() for t in texts]

        return model

    df = spark.range(500).select("id", F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"), F.lit("own").alias("name")).repartition(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = models.modelled(df, "text", "upper", factory, "string", pace=Pace(budget=100), tokens=len)
        got = {r.id: (r.result, r.error, r.name) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {i: (f"T{i:04d}", None, "own") for i in range(500)}
    lines = open(log).read().split("\n")
    made = [x for x in lines if x.startswith("made")]
    assert 1 <= len(made) == len(set(made))
    sizes = [int(x.split()[1]) for x in lines if x.startswith("call")]
    assert max(sizes) <= 100 and sum(s == 100 for s in sizes) >= len(sizes) - 2


def test_retries_pauses_and_rows_that_fail():
    calls, waits = [], []

    def model(texts):
        calls.append(list(texts))
        if len(calls) == 1:
            raise Overloaded(7)
        if "bad" in texts:
            raise RuntimeError("no")
        return [len(t) for t in texts]

    got = models.called(model, ["a", "bad", "ccc", "dd"], Pace(attempts=2, pause=1, sleep=waits.append))
    assert got == [(1, None), (None, "RuntimeError: no"), (3, None), (2, None)]
    assert waits[0] == 7 and set(waits[1:]) == {1}
    waits.clear()
    assert models.called(lambda t: (_ for _ in ()).throw(Overloaded(500)), ["x"], Pace(attempts=3, sleep=waits.append)) == [(None, "retry after 500 s")]
    assert waits == [60, 60]
    assert models.called(lambda t: [1], ["x", "y"], Pace(attempts=1, sleep=waits.append)) == [(1, None), (1, None)]  # alone, each has one result


def test_failed_rows_can_run_again(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id long, text string")
    strict = lambda: lambda texts: [float(len(t)) if t != "bad" else 1 / 0 for t in texts]
    done = models.modelled(df, "text", "strict", strict, "double", pace=Pace(attempts=1)).cache()
    assert {r.id: r.result for r in done.collect()} == {1: 4.0, 2: None, 3: 0.0}
    again = models.modelled(models.failed(done).select("id", "text"), "text", "lenient", lambda: lambda texts: [0.5] * len(texts), "double").collect()
    assert [(r.id, r.result, r.error) for r in again] == [(2, 0.5, None)]
    assert models.modelled(df.where("id > 5"), "text", "strict", strict, "double").count() == 0


def test_encoder_is_made_in_the_worker(spark, tmp_path):
    log = str(tmp_path / "made")

    class Heavy:
        def __init__(self):
            with open(log, "a") as f:
                f.write("x")
            self.encode = dense.hashed_encoder(8)

        def __reduce__(self):
            raise TypeError("a model must not be pickled")

        def __call__(self, texts):
            return self.encode(texts)

    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(50)], "id long, text string").repartition(1)
    got = {r.id: r.embedding for r in dense.encoded_by(df, "text", "heavy", Heavy).collect()}
    want = {r.id: r.embedding for r in dense.encoded(df, "text", dense.hashed_encoder(8)).collect()}
    assert got.keys() == want.keys() and all(a == pytest.approx(b, abs=1e-6) for a, b in ((got[i], want[i]) for i in want))
    assert len(open(log).read()) == 1


@pytest.mark.parametrize(("accept", "generations"), [(True, 1), (False, 3)])
def test_the_loop_ends_when_no_row_is_left(spark, accept, generations):
    corpus = spark.createDataFrame([(1, "python is a language. It is old."), (2, "spark runs jobs.")], "doc_id long, content string")
    asked = []

    def generate(query, prompt, contents, attempt):
        asked.append(attempt)
        return adaptive.first_sentence(query, prompt, contents, attempt)

    providers = adaptive.Providers(generate=generate, grade_answer=lambda q, a, c: F.lit(accept) & q.isNotNull())
    plan = adaptive.Pipeline(corpus, settings=adaptive.Settings(grade_answers=True, max_retries=2), providers=providers)
    out = plan.adaptive(spark.createDataFrame([(1, "python language")], "query_id long, query string")).collect()
    assert asked == list(range(generations)) and len(out) == 1 and out[0].answer_is_acceptable == accept


def test_queries_in_several_blocks(spark, monkeypatch):
    """The same hits whatever the blocks' size."""
    from larkspur.operators import sparse

    c = spark.createDataFrame([(i, f"word{i % 7} common x{i}") for i in range(60)], "doc_id long, content string")
    q = spark.createDataFrame([(i, f"common word{i % 5}") for i in range(23)], "query_id long, query string")
    v = spark.createDataFrame([(i, [float(i % 9), float(i % 4), 1.0]) for i in range(60)], "doc_id long, embedding array<double>")
    listed = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    vq = v.where("doc_id < 23").withColumnRenamed("doc_id", "query_id")
    want = listed(sparse.search(c, q, 4)), listed(dense.search(v, vq, 4)), listed(dense.search(v, vq, 4, "euclidean"))
    monkeypatch.setattr(sparse, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 6)
    monkeypatch.setattr(dense, "STEP", 7)
    assert (listed(sparse.search(c, q, 4)), listed(dense.search(v, vq, 4)), listed(dense.search(v, vq, 4, "euclidean"))) == want
