"""Streams whose rows must be taken in order: the spend breaker and the similarity cache.

Both keep arbitrary state a key with transformWithState in event time.  A row
waits in its key's buffer until the watermark has passed it; then a timer
releases what is due, in order, whatever order the files came in.  So a key
holds the rows of the allowed lateness, and what its windows or the time to live
still need; both go when the watermark says so.  (A state's own time to live
counts the clock, by which a delayed or repeated stream would forget too early or
too late.)  Rows behind the watermark are dropped, and what lies within the
lateness of the newest row stays open until newer rows come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BOUNDED, PARTITIONS = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "spark.sql.shuffle.partitions"
#: Stores a core: each is opened, committed and held by an executor at every trigger.
STORES = 4


@contextmanager
def rocks(spark: SparkSession):
    """Within it, streams that start keep their state in RocksDB, which transformWithState needs: in few stores, whose memory an executor bounds together."""
    stores = min(int(spark.conf.get(PARTITIONS)), STORES * spark.sparkContext.defaultParallelism)
    settings = {PROVIDER: ROCKS, BOUNDED: "true", PARTITIONS: str(stores)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed them; `released` gets them in order.  Times are microseconds."""

    waiting_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def wake(self, at: int) -> None:
        """A timer for the first watermark that has passed `at`, unless an earlier one will do."""
        ms = at // 1000 + 1
        if all(t > ms for t in self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def hold(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.appendList(rows)
            self.wake(min(r[0] for r in rows))

    def due(self, watermark: int) -> list[tuple]:
        """The rows that the watermark has passed, sorted; the others stay."""
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        n = sum(r[0] <= watermark for r in rows)
        if n:
            self.waiting.put(rows[n:]) if n < len(rows) else self.waiting.clear()
        if n < len(rows):
            self.handle.registerTimer(rows[n][0] // 1000 + 1)
        return rows[:n]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self.released(key, self.due(watermark), watermark)

    def close(self) -> None:
        pass


#: A spend, and a user's open window, as they lie in the state of a group of users.
SPEND = np.dtype([("user", "<i8"), ("at", "<i8"), ("ord", "<i8"), ("cost", "<f8")])
WINDOW = np.dtype([("user", "<i8"), ("start", "<i8"), ("total", "<f8")])
#: Groups of users.  A call to the state costs the same for one user as for a group.
GROUPS = 4096


class SpendWindow(Ordered):
    """The running sums of the windows of a group of users, each anchored at its user's first spend."""

    waiting_schema = "rows binary"

    def __init__(self, limit: float, window_seconds: float) -> None:
        self.limit, self.span = limit, int(window_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.windows = handle.getValueState("windows", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = []
        for frame in rows:
            part = np.empty(len(frame), SPEND)
            for field, column in (("user", "user_id"), ("at", "at"), ("ord", "ord"), ("cost", "cost")):
                part[field] = frame[column].astype(SPEND[field])
            parts.append(part)
        held = np.concatenate(parts) if parts else np.empty(0, SPEND)
        if len(held):
            self.waiting.appendValue((held.tobytes(),))
            self.wake(int(held["at"].min()))
        return iter(())

    def due(self, watermark: int) -> np.ndarray:
        """The spends that the watermark has passed, by user and in order; the others stay."""
        held = np.concatenate([np.frombuffer(r[0], SPEND) for r in self.waiting.get()]) if self.waiting.exists() else np.empty(0, SPEND)
        go = held["at"] <= watermark
        left = held[~go]
        if go.any():
            self.waiting.put([(left.tobytes(),)]) if len(left) else self.waiting.clear()
        if len(left):
            self.handle.registerTimer(int(left["at"].min()) // 1000 + 1)  # wake() would take the timer that has just expired for a waiting one
        rows = held[go]
        return rows[np.lexsort((rows["cost"], rows["ord"], rows["at"], rows["user"]))]

    def released(self, key, rows: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(self.windows.get()[0], WINDOW) if self.windows.exists() else np.empty(0, WINDOW)
        window = {u: (start, total) for u, start, total in kept.tolist()}
        sums = []
        user, start, total = None, None, 0.0
        for u, at, _, cost in rows.tolist():
            if u != user:
                if user is not None:
                    window[user] = start, total
                user, (start, total) = u, window.get(u, (None, 0.0))
            if start is None or at - start >= self.span:
                start, total = at, 0.0
            total += cost
            sums.append(total)
        if user is not None:
            window[user] = start, total
        # of a window that the watermark has passed nothing is needed: the user's next spend opens a new one
        live = np.array([(u, start, total) for u, (start, total) in window.items() if start + self.span > watermark], WINDOW)
        if len(live):
            self.windows.update((live.tobytes(),))
            self.handle.registerTimer((int(live["start"].min()) + self.span) // 1000 + 1)
        elif len(kept):
            self.windows.clear()
        if len(rows):
            yield pd.DataFrame({"user_id": rows["user"], "ord": rows["ord"], "cumulative": [round(s, 6) for s in sums], "open": [s >= self.limit for s in sums]})


def _keyed(key: str) -> Column:
    """The row has a key and a time; as one condition on both, so that rows without a key go behind the watermark, which they move, and not before it."""
    return F.when(F.col("ts").isNotNull(), F.col(key).isNotNull())


def breaker(spends: DataFrame, limit: float, window_seconds: float, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """(user_id, ord, cumulative, open) of a stream of spends (user_id, ord, ts, cost), in the order of ts and ord.  Rows without a user only move the watermark.

    Users are dealt by hash into so many groups, each one key of the state: every trigger makes a few calls to the state
    for a group, not for a user.  A group holds its users' spends of the lateness as packed rows.
    """
    timed = spends.withWatermark("ts", late).where(_keyed("user_id")).select("ts", F.col("user_id").cast("long").alias("user_id"), F.unix_micros("ts").alias("at"), F.col("ord").cast("long").alias("ord"), F.col("cost").cast("double").alias("cost"))
    grouped = timed.withColumn("users", F.pmod(F.xxhash64("user_id"), F.lit(groups)))
    return grouped.groupBy("users").transformWithStateInPandas(SpendWindow(limit, window_seconds), "user_id long, ord long, cumulative double, open boolean", "append", "eventTime")


#: Lookups compared with a key's entries at once.
LOOKUPS = 1024


class SimilarEntries(Ordered):
    """The entries that a cell's lookups of one span may find, and the lookups that wait for their turn."""

    waiting_schema = "at long, id long, vector array<double>"

    def __init__(self, least: float, ttl_seconds: float) -> None:
        self.least, self.ttl = least, int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entries = handle.getListState("entries", self.waiting_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked, stored = [], []
        for part in rows:
            for at, i, v, is_entry in zip(part["at"], part["id"], part["vector"], part["is_entry"], strict=True):
                (stored if is_entry else asked).append((int(at), int(i), [float(x) for x in v]))
        if stored:
            self.entries.appendList(stored)
            self.wake(min(r[0] for r in stored) + self.ttl)
        self.hold(asked)
        return iter(())

    def released(self, key, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        held = sorted(self.entries.get(), key=lambda r: r[1]) if self.entries.exists() else []
        if rows:
            found: list[tuple] = [(None, None)] * len(rows)
            times, vectors = np.array([e[0] for e in held]), np.array([e[2] for e in held])
            for a in range(0, len(rows) if held else 0, LOOKUPS):
                part = rows[a : a + LOOKUPS]
                age = np.array([r[0] for r in part])[:, None] - times[None]
                s = np.round(np.array([r[2] for r in part]) @ vectors.T, 9)
                s = np.where((age > 0) & (age < self.ttl), s, -np.inf)
                best = s.argmax(axis=1)  # the least id among equals
                found[a : a + LOOKUPS] = [(held[b][1], float(s[i, b])) if s[i, b] >= self.least else (None, None) for i, b in enumerate(best.tolist())]
            yield pd.DataFrame({"lookup_id": [r[1] for r in rows], "entry_id": pd.array([e for e, _ in found], dtype="Int64"), "similarity": pd.array([x for _, x in found], dtype="Float64")})
        live = [e for e in held if e[0] + self.ttl > watermark]
        if len(live) < len(held):
            self.entries.put(live) if live else self.entries.clear()
        if live:
            self.wake(min(e[0] for e in live) + self.ttl)


def cells(vector: Column, size: int, reach: float, projections: int, seed: int) -> list[Column]:
    """Along random orthogonal directions: the cells, of twice the width `reach`, that hold something within reach of a vector, as arrays, and then the vector's own."""
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, projections)))[0].T
    spans, own = [], []
    for axis in axes:
        p = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(a)) for a in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        at = lambda shift: F.floor((p + shift) / (2 * reach))  # noqa: B023, E731
        spans.append(F.sequence(at(-reach), at(reach)))
        own.append(F.array(at(0.0)))
    return [*spans, *own]


def cache_lookups(requests: DataFrame, size: int, least: float = 0.92, ttl_seconds: int = 86_400, late: str = "1 hour", projections: int = 2, seed: int = 5) -> DataFrame:
    """(lookup_id, entry_id, similarity, hit) of a stream of requests (id, ts, embedding): the best request that was stored before and has not expired.

    Embeddings are of unit length and `size` dimensions; a longer one is an error.  Vectors of a cosine of `least` or more differ by
    at most sqrt(2 - 2 least) along any direction.  So a request is stored in every cell that its like may be
    in, two a direction at most, and is looked up in its own only: the answer is exact, and one task gives it.
    Time is cut into spans of the time to live as well: a request is stored for its own span and the next, and looked
    up in its own.  So a key's state is bounded by what comes in two spans, whatever lateness the stream allows.
    """
    reach = math.sqrt(max(2 - 2 * least, 0.0)) + 1e-3
    v = F.col("embedding").cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    checked = F.when((F.size(v) == size) & (norm < 1.001), v).otherwise(F.raise_error(F.lit("an embedding is longer than 1 or has another number of dimensions")).cast("array<double>"))
    rows = requests.withWatermark("ts", late).where(_keyed("id")).select("ts", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), checked.alias("vector"))
    parts = cells(F.col("vector"), size, reach, projections, seed)
    roles = F.array(F.struct(F.lit(True).alias("is_entry"), F.array(*parts[:projections]).alias("c")), F.struct(F.lit(False).alias("is_entry"), F.array(*parts[projections:]).alias("c")))
    rows = rows.select("*", F.explode(roles).alias("role")).select("ts", "at", "id", "vector", "role.is_entry", "role.c").withColumn("cell", F.lit(""))
    span = F.floor(F.col("at") / int(ttl_seconds * 1_000_000))
    rows = rows.withColumn("span", F.explode(F.when(F.col("is_entry"), F.array(span, span + 1)).otherwise(F.array(span))))
    for k in range(projections):
        rows = rows.withColumn("x", F.explode(F.col("c")[k])).withColumn("cell", F.concat_ws(",", "cell", F.col("x").cast("string"))).drop("x")
    out = rows.drop("c").groupBy("cell", "span").transformWithStateInPandas(SimilarEntries(least, ttl_seconds), "lookup_id long, entry_id long, similarity double", "append", "eventTime")
    return out.select("lookup_id", "entry_id", F.round("similarity", 6).alias("similarity"), F.col("entry_id").isNotNull().alias("hit"))
