import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from larkspur.operators import telemetry
from larkspur.streaming import stateful
from larkspur.streaming import telemetry as live

START = datetime(2024, 1, 1)
EVENT = "user_id long, ts timestamp, ord long, cost double"
REQUEST = "id long, ts timestamp, embedding array<double>"


def written(spark, path, slices, schema, end):
    """A file a slice, in this order, and one row without a key that closes the stream."""
    for i, rows in enumerate([*slices, [end]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def swapped(rows, n):
    """n slices by time, every two neighbours changed."""
    size = -(-len(rows) // n)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    return [parts[i ^ 1] if i ^ 1 < len(parts) else parts[i] for i in range(len(parts))]


def drained(stream, name):
    with stateful.rocks(stream.sparkSession):
        return live.drain(stream, name)


def test_breaker_takes_files_out_of_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(4), START + timedelta(seconds=60 * i + r.randrange(60)), i, r.random()) for i in range(240)]
    stream = written(spark, f"{tmp_path}/s", swapped(rows, 6), EVENT, (None, START + timedelta(days=9), None, None))
    got = {x.ord: (x.cumulative, x.open) for x in drained(stateful.breaker(stream, 3.0, 5000, "2 hours"), "tws-breaker").collect()}
    want = {x.ord: (x.cumulative, x.open) for x in telemetry.breaker(spark.createDataFrame(rows, EVENT), 3.0, 5000).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_breaker_drops_what_is_behind_the_watermark(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    slices = [[(1, at(0), 0, 1.0)], [(1, at(10), 1, 1.0)], [(1, at(20), 2, 1.0)], [(1, at(2), 3, 50.0)]]
    stream = written(spark, f"{tmp_path}/s", slices, EVENT, (None, at(200), None, None))
    got = {x.ord: x.cumulative for x in drained(stateful.breaker(stream, 3.0, 86_400, "1 hour"), "tws-late").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0}


def vector(r, like=None):
    x = [r.gauss(0, 1) for _ in range(8)] if like is None else [a + 0.1 * r.gauss(0, 1) for a in like]
    n = math.sqrt(sum(a * a for a in x))
    return [a / n for a in x]


@pytest.mark.parametrize(("least", "projections"), [(0.9, 2), (0.3, 1)])
def test_cache_equals_the_batch(spark, tmp_path, least, projections):
    r = random.Random(7)
    rows = []
    for i in range(150):
        like = r.choice(rows)[2] if rows and r.random() < 0.5 else None
        rows.append((i, START + timedelta(minutes=i), vector(r, like) if r.random() < 0.9 or not rows else r.choice(rows)[2]))
    stream = written(spark, f"{tmp_path}/s", swapped(rows, 5), REQUEST, (None, START + timedelta(days=9), None))
    got = drained(stateful.cache_lookups(stream, 8, least, 3600, "2 hours", projections), f"tws-cache-{projections}")
    df = spark.createDataFrame(rows, REQUEST)
    want = telemetry.cache_lookups(df.withColumnRenamed("id", "lookup_id"), df.withColumnRenamed("id", "entry_id"), least, 3600)
    listed = lambda x: sorted(map(tuple, x.select("lookup_id", "entry_id", "similarity", "hit").collect()), key=str)
    assert listed(got) == listed(want)
    assert 20 < want.where("hit").count() < 150 or least < 0.5


def test_cache_wants_unit_vectors(spark, tmp_path):
    stream = written(spark, f"{tmp_path}/s", [[(1, START, [2.0] * 8)]], REQUEST, (None, START + timedelta(days=9), None))
    with pytest.raises(Exception, match="longer than 1"):
        drained(stateful.cache_lookups(stream, 8), "tws-long")


def test_cells_hold_all_within_reach(spark):
    r, reach = random.Random(3), 0.5
    pairs = []
    while len(pairs) < 200:
        a, b = vector(r), vector(r, None)
        if math.dist(a, b) > reach:
            b = vector(r, a)
        if math.dist(a, b) <= reach:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    near, own = stateful.cells(F.col("a"), 8, reach, 2, 1)[:2], stateful.cells(F.col("b"), 8, reach, 2, 1)[2:]
    assert df.where(F.array_contains(near[0], own[0][0]) & F.array_contains(near[1], own[1][0])).count() == 200


def test_cache_keys_hold_two_spans(spark, tmp_path, monkeypatch):
    """Days of requests within the lateness: what a key takes in is bounded by the time to live."""
    r, like, n = random.Random(9), vector(random.Random(2)), 400
    rows = [(i, START + timedelta(minutes=10 * i), vector(r, like)) for i in range(n)]
    seen = f"{tmp_path}/seen"

    class Watched(StatefulProcessor):
        def __init__(self, *given):
            self.given = given

        def init(self, handle):
            from larkspur.streaming.stateful import SimilarEntries

            self.own = SimilarEntries(*self.given)
            self.own.init(handle)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            held = list(rows)
            with open(seen, "a") as f:
                f.write(f"{sum(len(p) for p in held)}\n")
            return self.own.handleInputRows(key, iter(held), timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            return self.own.handleExpiredTimer(key, timerValues, expiredTimerInfo)

        def close(self):
            pass

    monkeypatch.setattr(stateful, "SimilarEntries", Watched)
    stream = written(spark, f"{tmp_path}/s", [rows], REQUEST, (None, START + timedelta(days=90), None))
    got = drained(stateful.cache_lookups(stream, 8, 0.9, 3600, "30 days"), "tws-spans")
    assert got.count() == n and got.where("hit").count() > n // 2
    taken = [int(x) for x in open(seen)]
    assert len(taken) > 60 and max(taken) <= 18  # six requests a span: two spans of entries, one of lookups


def test_breaker_calls_the_state_once_a_group(spark, tmp_path, monkeypatch):
    """Many users in a few groups: a trigger hands over a group at a time, and users' windows stay apart."""
    r = random.Random(4)
    rows = [(r.randrange(200), START + timedelta(seconds=60 * i + r.randrange(60)), i, r.random()) for i in range(1200)]
    seen = f"{tmp_path}/seen"

    class Watched(StatefulProcessor):
        def __init__(self, *given):
            self.given = given

        def init(self, handle):
            from larkspur.streaming.stateful import SpendWindow

            self.own = SpendWindow(*self.given)
            self.own.init(handle)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            with open(seen, "a") as f:
                f.write(f"{key[0]}\n")
            return self.own.handleInputRows(key, rows, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            return self.own.handleExpiredTimer(key, timerValues, expiredTimerInfo)

        def close(self):
            pass

    monkeypatch.setattr(stateful, "SpendWindow", Watched)
    stream = written(spark, f"{tmp_path}/s", swapped(rows, 4), EVENT, (None, START + timedelta(days=9), None, None))
    got = {x.ord: (x.user_id, x.cumulative, x.open) for x in drained(stateful.breaker(stream, 2.0, 20_000, "12 hours", groups=3), "tws-groups").collect()}
    want = {x.ord: (x.user_id, x.cumulative, x.open) for x in telemetry.breaker(spark.createDataFrame(rows, EVENT), 2.0, 20_000).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert len(open(seen).read().split()) <= 3 * 4


def test_triggers_do_not_grow_with_the_table(spark):
    from larkspur.catalog import out_of_order

    df = spark.range(0, 4000, 1, 12).select(F.col("id"), F.timestamp_seconds(F.pmod(F.col("id") * 37, F.lit(4000))).alias("ts"))
    stream, _ = out_of_order(spark, df, "triggers")
    seen = []
    q = stream.writeStream.foreachBatch(lambda batch, n: seen.append(batch.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 4 <= len(seen) <= 6 and sum(seen) == 4001
