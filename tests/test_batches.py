"""Batches that are kept as they are done, mergeable sketches, and the bootstrap's vectors."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import statistics, telemetry
from larkspur.sources import sinks


def test_a_run_that_breaks_off_keeps_its_batches(spark, tmp_path):
    todo, path, done = spark.range(100).select(F.col("id").alias("query_id"), F.lit("x").alias("_other")), f"{tmp_path}/out", []

    def work(rows, fail_at=None):
        ids = [r.query_id for r in rows.collect()]
        if len(done) == fail_at:
            raise InterruptedError
        done.append(set(ids))
        return rows.withColumn("r", F.col("query_id") * 2)

    with pytest.raises(InterruptedError):
        sinks.resume(todo, path, lambda r: work(r, 2), batch_rows=20)
    first = set().union(*done)
    assert len(done) == 2 and {r.query_id for r in sinks.committed(spark, path).collect()} == first
    spark.range(3).write.parquet(f"{path}/batches/broken")  # a batch that was written and never counted
    out = sinks.resume(todo, path, work, batch_rows=20)
    assert sorted((r.query_id, r.r) for r in out.collect()) == [(i, 2 * i) for i in range(100)]
    assert not first & set().union(*done[2:])  # nothing is done twice
    calls = len(done)
    assert sinks.resume(todo, path, work, batch_rows=20).count() == 100 and len(done) == calls
    assert sinks.resume(todo.unionByName(todo.withColumn("query_id", F.col("query_id") + 100)), path, work).count() == 200
    assert sum(map(len, done)) == 200 and out.columns == ["query_id", "_other", "r"]


def test_nothing_to_do(spark, tmp_path):
    none = spark.createDataFrame([], "query_id long")
    assert sinks.committed(spark, f"{tmp_path}/out") is None
    assert sinks.resume(none, f"{tmp_path}/out", lambda r: r.withColumn("r", F.lit(1))).columns == ["query_id", "r"]


def events(spark, n=5000):
    r = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=r.randrange(3600)), r.choice("ab"), r.lognormvariate(0, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, value double")


def test_sketches_merge_into_any_window(spark):
    rows, df = events(spark)
    sketches = telemetry.minute_sketches(df, F.col("value"), "kind")
    for r in telemetry.merged_quantiles(sketches, {"p50": 0.5, "p95": 0.95}, "kind").collect():
        values = np.array([x[3] for x in rows if x[2] == r.kind])
        assert r.n == len(values)
        assert abs((values <= r.p50).mean() - 0.5) <= 0.01 and abs((values <= r.p95).mean() - 0.95) <= 0.01
    windows = {r.start: (r.n, r.p50) for r in telemetry.sliding_sketches(sketches, {"p50": 0.5}, minutes=5).collect()}
    start = datetime(2024, 1, 1, 0, 10)
    inside = np.array([x[3] for x in rows if start <= x[1] < start + timedelta(minutes=5)])
    n, p50 = windows[start]
    assert n == len(inside) and abs((inside <= p50).mean() - 0.5) <= 0.02
    assert len(windows) == 64


def test_sliding_counts_events_once(spark):
    """A window's quantile equals that of its own events; nothing but minutes' counts is copied."""
    rows, df = events(spark, 800)
    got = {r.start: (r.n, r.quantile) for r in telemetry.sliding_quantile(df, F.col("value"), 0.9, telemetry.QUERY_BUCKETS).collect()}
    for start in (datetime(2023, 12, 31, 23, 57), datetime(2024, 1, 1, 0, 30)):
        inside = df.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(start + timedelta(minutes=5))))
        want = telemetry.histogram_quantile(inside, F.col("value"), 0.9, telemetry.QUERY_BUCKETS).first()
        assert got[start] == (want.n, want.quantile)


def test_bootstrap_vectors(spark, monkeypatch):
    """The same resamples as row by row, whatever the batches and partitions; groups of one row; nulls left out."""
    monkeypatch.setattr(statistics, "DRAWN_ROWS", 7)
    monkeypatch.setattr(statistics, "HELD_GROUPS", 1)
    r = random.Random(9)
    rows = [(i, r.choice(["m", "n"]), i % 3, r.random(), r.random() if i != 5 else None) for i in range(90)] + [(1000, "one", 0, 0.25, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, metric string, fold int, a double, b double")
    got = {(x.metric, x.fold): (x.ci_low, x.ci_high) for x in statistics.bootstrap(df.repartition(5), 200, by=("metric", "fold"), number=F.col("query_id")).collect()}

    def scattered(x):
        for step in (48_271, 69_621, 39_373):
            x = (x * x + x * step + step) % statistics.MODULUS
        return x

    for metric, fold in {(x[1], x[2]) for x in rows}:
        means = []
        for k in range(200):
            s = c = 0
            for i, _, _, a, b in (x for x in rows if (x[1], x[2]) == (metric, fold) and x[4] is not None):
                u = scattered((scattered((i + 42) % statistics.MODULUS) + k * 1_000_003) % statistics.MODULUS) / statistics.MODULUS
                times = sum(u >= p for p in statistics.POISSON)
                s, c = s + times * (b - a), c + times
            if c:
                means.append(s / c)
        assert got[metric, fold] == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5)), abs=2e-6)
    assert statistics.bootstrap(df.where("query_id < 0"), 10).count() == 0


def test_a_report_makes_its_rows_once(spark, tmp_path):
    """Categories come from metrics that cost much: the distribution and the report each make them once."""
    from pyspark.sql import functions as F

    from larkspur.operators import evaluation

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def kinds(i):
        made.add(1)
        return ["correct"] if i % 4 == 0 else ["hallucination", "wrong_answer"] if i % 4 == 1 else ["wrong_answer"]

    rows = spark.range(0, 40, 1, 3).select(F.col("id").alias("pair_id"), kinds("id").alias("categories"))
    got = {r.category: (r.n, r.error_rate) for r in evaluation.error_distribution(rows).collect()}
    assert made.value == 40
    assert got["correct"] == (10, 0.75) and got["hallucination"] == (10, 0.75) and got["wrong_answer"] == (30, 0.75) and got["empty_response"] == (0, 0.75)
    sinks.write_error_report(rows, f"{tmp_path}/report", "pair_id", 2)
    assert made.value == 80
    shown = {r.category: (r.n, r.examples) for r in spark.read.json(f"{tmp_path}/report").collect()}
    assert shown["wrong_answer"] == (30, [1, 2]) and shown["correct"] == (10, [0, 4])
    assert {r.n for r in evaluation.error_distribution(rows.limit(0)).collect()} == {0}


def test_a_batch_has_several_files(spark, tmp_path, monkeypatch):
    """No task gets a whole batch."""
    monkeypatch.setattr(sinks, "FILE_ROWS", 50)
    files = []

    def work(rows):
        files.append(len(rows.inputFiles()))
        return rows

    out = sinks.resume(spark.range(1000).withColumnRenamed("id", "query_id"), f"{tmp_path}/run", work, batch_rows=500)
    assert out.count() == out.distinct().count() == 1000 and min(files) > 3
