"""Time-dependent behaviour in batch form: spend breaker, semantic cache, rates and latency histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Upper bounds of latency buckets, in seconds.
QUERY_BUCKETS = (0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0)
RETRIEVAL_BUCKETS = (0.1, 0.5, 1.0, 2.0, 3.0, 5.0)


LOOKUP_BLOCK = 4096


def spend(input_tokens: Column, output_tokens: Column, per_1k_input: float = 0.004, per_1k_output: float = 0.012) -> Column:
    return input_tokens / 1000 * per_1k_input + output_tokens / 1000 * per_1k_output


def breaker(spends: DataFrame, limit: float, window_seconds: float, key: str = "user_id") -> DataFrame:
    """(key, ord, cumulative, open): the window's cost so far and whether the breaker is open after each spend (key, ts, ord, cost).

    A window is anchored at a key's first spend, and anew at the first spend
    after it has run out, so it can't be a calendar window, and each window
    depends on the one before: a key's rows pass through one task, as a sorted
    stream of which one sum is held.
    """
    import pyarrow as pa

    ordered = spends.select(F.col(key).alias("k"), F.col("ord").cast("long").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("cost").cast("double").alias("cost")).repartition("k").sortWithinPartitions("k", "ord")

    def run(batches):
        key, start, total = object(), None, 0.0
        for b in batches:
            out = []
            for k, at, c in zip(b.column("k").to_pylist(), b.column("at").to_pylist(), b.column("cost").to_pylist(), strict=True):
                if k != key or at - start >= window_seconds:
                    key, start, total = k, at, 0.0
                total += c
                out.append(total)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("ord"), pa.array(out, pa.float64())], names=["k", "ord", "cumulative"])

    out = ordered.mapInArrow(run, "k long, ord long, cumulative double")
    return out.select(F.col("k").alias(key), "ord", F.round("cumulative", 6).alias("cumulative"), (F.col("cumulative") >= limit).alias("open"))


def cache_lookups(lookups: DataFrame, entries: DataFrame, least: float = 0.92, ttl_seconds: int = 86_400) -> DataFrame:
    """For each lookup (lookup_id, ts, embedding) the best entry (entry_id, ts, embedding) written before it and not expired.

    Time is cut into spans of the time to live: an entry can only be found from
    its own span and the next.  The lookups and the entries of a span are dealt
    into blocks of about LOOKUP_BLOCK, a pair of blocks is one matrix product in
    a task, and of it only the best entry a lookup goes on.
    """
    import numpy as np
    import pyarrow as pa

    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = ttl_seconds * 1_000_000
    found = lookups.select(F.col("lookup_id").cast("long").alias("id"), t.alias("t"), "embedding").withColumn("own", F.floor(F.col("t") / span))
    stored = entries.select(F.col("entry_id").cast("long").alias("id"), t.alias("t"), "embedding").withColumn("span", F.floor(F.col("t") / span))
    found = found.withColumn("span", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    parts = found.groupBy("span").agg(F.ceil(F.count("*") / LOOKUP_BLOCK).alias("nl")).join(stored.groupBy("span").agg(F.ceil(F.count("*") / LOOKUP_BLOCK).alias("ne")), "span")  # a row a span
    block = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = found.join(parts, "span").select("span", "id", "t", F.col("embedding").alias("vector"), F.pmod(block, "nl").cast("int").alias("i"), every("ne").alias("j"))
    right = stored.join(parts, "span").select("span", "id", "t", F.col("embedding").alias("vector"), F.pmod(block, "ne").cast("int").alias("j"), every("nl").alias("i"))

    def matrix(table: pa.Table) -> np.ndarray:
        return np.array(table.column("vector").to_pylist(), dtype=np.float64).reshape(len(table), -1)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, e = a.column("id").to_numpy(), b.column("id").to_numpy()
        if not len(ids) or not len(e):
            return pa.table({"lookup_id": pa.array([], pa.int64()), "entry_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        age = a.column("t").to_numpy()[:, None] - b.column("t").to_numpy()[None]
        s = np.where((age > 0) & (age < span), np.round(matrix(a) @ matrix(b).T, 9), -np.inf)
        order = np.argsort(e, kind="stable")  # the least id among equals
        at = order[s[:, order].argmax(axis=1)]
        top = s[np.arange(len(ids)), at]
        ok = top >= least
        return pa.table({"lookup_id": pa.array(ids[ok]), "entry_id": pa.array(e[at[ok]]), "similarity": pa.array(top[ok])})

    hits = left.groupBy("span", "i", "j").cogroup(right.groupBy("span", "i", "j")).applyInArrow(best, "lookup_id long, entry_id long, similarity double")
    top = hits.groupBy("lookup_id").agg(F.max_by("entry_id", F.struct(F.col("similarity"), -F.col("entry_id"))).alias("entry_id"), F.max("similarity").alias("similarity"))
    return lookups.select("lookup_id").join(top, "lookup_id", "left").select("lookup_id", "entry_id", F.round("similarity", 6).alias("similarity"), F.col("entry_id").isNotNull().alias("hit"))


def cache_live(entries: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    return entries.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) < ttl_seconds * 1_000_000)


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"))


def minute_rates(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Events a minute and kind, and the share of each kind in its minute."""
    per = events.groupBy(F.date_trunc("minute", "ts").alias("minute"), kind).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("minute")), 6))


def bucket_counts(values: DataFrame, value: Column, buckets: tuple[float, ...], *by: str) -> DataFrame:
    """Cumulative counts up to each bound, and the total (le is null)."""
    sums = [F.sum((value <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = values.groupBy(*by).agg(*sums, F.count("*").alias("total"))
    items = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return wide.select(*by, F.explode(items).alias("i")).select(*by, "i.*")


def histogram_quantile(values: DataFrame, value: Column, q: float, buckets: tuple[float, ...], *by: str) -> DataFrame:
    """The quantile by linear interpolation in its bucket; beyond the last bound, that bound."""
    sums = [F.sum((value <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(buckets)]
    return _interpolated(values.groupBy(*by).agg(*sums, F.count("*").alias("total")), q, buckets, *by)


def _interpolated(wide: DataFrame, q: float, buckets: tuple[float, ...], *by: str) -> DataFrame:
    rank, out = F.lit(q) * F.col("total"), F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low, under = (F.lit(float(buckets[i - 1])), F.col(f"b{i - 1}")) if i else (F.lit(0.0), F.lit(0))
        inside = low + (F.lit(float(buckets[i])) - low) * (rank - under) / F.nullif(F.col(f"b{i}") - under, F.lit(0))
        out = F.when(F.col(f"b{i}") >= rank, F.coalesce(inside, F.lit(float(buckets[i])))).otherwise(out)
    return wide.select(*by, F.col("total").alias("n"), F.round(out, 6).alias("quantile"))


def _in_windows(rows: DataFrame, minutes: int) -> DataFrame:
    """rows of a minute each, once for every window of so many minutes that holds it, by its start."""
    back = F.explode(F.sequence(F.lit(0), F.lit(minutes - 1)))
    return rows.withColumn("_back", back).withColumn("start", F.col("minute") - F.make_dt_interval(mins=F.col("_back"))).drop("_back", "minute")


def sliding_quantile(events: DataFrame, value: Column, q: float, buckets: tuple[float, ...], *by: str, minutes: int = 5) -> DataFrame:
    """histogram_quantile() over the windows of `minutes` that begin at every minute.  Events are counted once a minute; windows add these counts."""
    sums = [F.sum((value <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(buckets)]
    per = events.groupBy(F.date_trunc("minute", "ts").alias("minute"), *by).agg(*sums, F.count("*").alias("total"))
    wide = _in_windows(per, minutes).groupBy("start", *by).agg(*[F.sum(c).alias(c) for c in [*[f"b{i}" for i in range(len(buckets))], "total"]])
    return _interpolated(wide, q, buckets, "start", *by)


def minute_sketches(events: DataFrame, value: Column, *by: str, k: int = 400) -> DataFrame:
    """(minute, by..., n, sketch): a KLL sketch of the values of every minute and key, from which any later window can be had without the events."""
    return events.groupBy(F.date_trunc("minute", "ts").alias("minute"), *by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(value.cast("double"), k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, qs: dict[str, float], *by: str) -> DataFrame:
    """(by..., n, one column a name of qs) of sketches (by..., n, sketch), merged."""
    whole = sketches.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in qs.items()])


def sliding_sketches(sketches: DataFrame, qs: dict[str, float], *by: str, minutes: int = 5) -> DataFrame:
    """merged_quantiles() over the windows of `minutes` that begin at every minute."""
    return merged_quantiles(_in_windows(sketches, minutes), qs, "start", *by)


def latest(events: DataFrame, value: str, *by: str) -> DataFrame:
    """A gauge: the last value of each key."""
    return events.groupBy(*by).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value))


def request_problems(requests: DataFrame) -> DataFrame:
    """requests (query, top_k) with what is wrong with them: the query has 3 to 512 characters, top_k is 1 to 20."""
    checks = {"query_too_short": F.length(T.strip("query")) < 3, "query_too_long": F.length("query") > 512, "top_k_out_of_range": ~F.col("top_k").between(1, 20)}
    return requests.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()])))
