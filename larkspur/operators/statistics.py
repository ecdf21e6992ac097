"""Paired tests, agreement and sampling, as aggregates; distributions' tails by plain numerics on one row a group."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..sources.qa import shuffled
from .quantiles import value_places


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return regularised_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def p_value(t: Column | str, df: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) or n <= 0 else t_p_value(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")

    return run(t, df)


def paired(champion: DataFrame, challenger: DataFrame, metrics: list[str], key: str = "query_id") -> DataFrame:
    """(key, metric, a, b): both sides' values of each metric, missing ones 0; of repeated keys of the challenger the last (by its column ord, if there is one) counts."""
    from .evaluation import long_metrics

    if "ord" in challenger.columns:
        challenger = challenger.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).where("_n = 1")
    keys = champion.select(key).join(challenger.select(key), key)
    names = F.broadcast(champion.sparkSession.createDataFrame([(m,) for m in metrics], "metric string"))
    a = long_metrics(champion, metrics, [key]).withColumnRenamed("value", "a")
    b = long_metrics(challenger, metrics, [key]).withColumnRenamed("value", "b")
    return keys.crossJoin(names).join(a, [key, "metric"], "left").join(b, [key, "metric"], "left").na.fill(0.0, ["a", "b"])


def paired_stats(pairs: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """n, means, difference, t and Cohen's d of (a, b) pairs; groups with all values 0 are left out.

    t is null where the differences have no spread (p is then 1), d is 0 there.
    """
    d = F.col("b") - F.col("a")
    s = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg(d).alias("md"), F.stddev_samp(d).alias("sd"), F.max(F.abs("a") + F.abs("b")).alias("most"))
    sd = F.when(F.isnan("sd") | F.col("sd").isNull() | (F.col("sd") <= 1e-12), None).otherwise(F.col("sd"))
    return s.where("most > 0").select(*by, "n", F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), F.round("md", 6).alias("difference"), F.round(F.col("md") / (sd / F.sqrt("n")), 6).alias("t"), (F.col("n") - 1).alias("df"), F.round(F.coalesce(F.col("md") / sd, F.lit(0.0)), 6).alias("effect_size"))


def tested(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """paired_stats() with p and whether it is significant."""
    return stats.withColumn("p_value", F.coalesce(p_value("t", F.col("df").cast("double")), F.lit(1.0))).withColumn("significant", F.col("p_value") < alpha)


MODULUS = 2**31 - 1


def _scattered(x: np.ndarray) -> np.ndarray:
    """A number below MODULUS from one below it; squares keep neighbours from staying neighbours, and all fits 64 bits."""
    for step in (48_271, 69_621, 39_373):
        x = (x * x + x * step + step) % MODULUS
    return x


#: How often a row is in a resample: Poisson with mean 1, by its cumulative probabilities.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8))
#: Rows drawn at once, and groups whose sums a task holds.
DRAWN_ROWS, HELD_GROUPS = 1024, 256


def bootstrap(pairs: DataFrame, draws: int = 1000, seed: int = 42, by: tuple[str, ...] = ("metric",), number: Column | None = None) -> DataFrame:
    """The 2.5 and 97.5 percentiles of resampled mean differences.

    A row is in a resample as often as a Poisson variable says that is a hash of
    the row's number (a hash of query_id unless given) and the resample's; for
    many rows that is drawing with replacement.  A row's counts for all resamples
    are one vector, and a task adds them up: it sends `draws` sums a group,
    however many rows it has.
    """
    row = F.pmod(F.xxhash64("query_id") if number is None else number.cast("long"), F.lit(MODULUS).cast("long"))
    rows = pairs.select(*by, (F.col("b") - F.col("a")).cast("double").alias("_d"), F.pmod(row + seed, F.lit(MODULUS).cast("long")).alias("_r")).where("_d IS NOT NULL")
    shape = StructType([*rows.schema.fields[: len(by)], StructField("_sums", ArrayType(DoubleType())), StructField("_times", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, shift = np.array(POISSON), np.arange(draws, dtype=np.int64) * 1_000_003
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        kinds: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in held], t) for i, t in enumerate(kinds)]
            out = [*keys, pa.array([s for s, _ in held.values()], pa.list_(pa.float64())), pa.array([c for _, c in held.values()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(out, names=[*by, "_sums", "_times"])

        for whole in batches:
            kinds = [whole.schema.field(c).type for c in by]
            for a in range(0, whole.num_rows, DRAWN_ROWS):
                b = whole.slice(a, DRAWN_ROWS)
                places: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in by), strict=True)) if by else ((i, ()) for i in range(b.num_rows)):
                    places.setdefault(key, []).append(i)
                d, r = b.column("_d").to_numpy(), _scattered(b.column("_r").to_numpy())
                times = np.searchsorted(bounds, _scattered((r[:, None] + shift) % MODULUS) / float(MODULUS), side="right")
                for key, at in places.items():
                    s, c = held.get(key, (np.zeros(draws), np.zeros(draws, np.int64)))
                    held[key] = (s + d[at] @ times[at], c + times[at].sum(axis=0))
                if len(held) > HELD_GROUPS:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    vectors = rows.mapInArrow(run, shape).select(*by, F.posexplode(F.arrays_zip("_sums", "_times")).alias("resample", "v"))
    means = vectors.groupBy(*by, "resample").agg((F.sum("v._sums") / F.nullif(F.sum("v._times"), F.lit(0))).alias("m"))
    return means.groupBy(*by).agg(F.round(F.percentile("m", 0.025), 6).alias("ci_low"), F.round(F.percentile("m", 0.975), 6).alias("ci_high"))  # `draws` values a group


def winner(tests: DataFrame, primary: str, guards: list[str]) -> DataFrame:
    """One row: champion, challenger or no_significant_difference, from rows (metric, difference, significant)."""
    is_primary = F.col("metric") == primary
    s = tests.agg(
        F.coalesce(F.bool_or(F.col("metric").isin(guards) & F.col("significant") & (F.col("difference") < 0)), F.lit(False)).alias("guard"),
        F.coalesce(F.bool_or(is_primary), F.lit(False)).alias("there"),
        F.coalesce(F.bool_or(is_primary & F.col("significant") & (F.col("difference") > 0)), F.lit(False)).alias("better"),
        F.coalesce(F.bool_or(is_primary & F.col("significant") & (F.col("difference") < 0)), F.lit(False)).alias("worse"),
    )
    name = F.when(F.col("guard"), "champion").when(~F.col("there"), "no_significant_difference").when(F.col("better"), "challenger").when(F.col("worse"), "champion").otherwise("no_significant_difference")
    reason = F.when(F.col("guard"), "guard metric regressed").when(~F.col("there"), "primary metric not available").when(F.col("better"), "primary metric significantly better").when(F.col("worse"), "primary metric significantly worse").otherwise("no significant difference")
    return s.select(name.alias("winner"), reason.alias("reason"))


def minimum_sample_size(effect: float = 0.5, alpha: float = 0.05, power: float = 0.8) -> int:
    z = NormalDist().inv_cdf
    return math.ceil(((z(1 - alpha / 2) + z(power)) / effect) ** 2)


def sample_sizes(effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """minimum_sample_size() of a column of effects; null where there is none."""
    z = NormalDist().inv_cdf
    return F.ceil(F.pow(F.lit(z(1 - alpha / 2) + z(power)) / F.nullif(F.abs(effect), F.lit(0.0)), F.lit(2.0)))


def weighted_kappa(ratings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cohen's kappa with quadratic weights of rating pairs (x, y), missing ratings 3.

    Without spread on both sides: 1 if all pairs are equal, else NaN.
    """
    r = ratings.select(*by, F.coalesce(F.col("x").cast("double"), F.lit(3.0)).alias("x"), F.coalesce(F.col("y").cast("double"), F.lit(3.0)).alias("y"))
    s = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("x") - F.col("y")) ** 2).alias("dd"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    below = F.col("n") * F.col("xx") + F.col("n") * F.col("yy") - 2 * F.col("sx") * F.col("sy")
    kappa = F.when(below == 0, F.when(F.col("dd") == 0, 1.0).otherwise(float("nan"))).otherwise(F.round(1 - F.col("n") * F.col("dd") / F.when(below == 0, None).otherwise(below), 6))
    return s.select(*by, "n", kappa.alias("kappa"))


def spearman(pairs: DataFrame, by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Rank correlation of (x, y), ties at their mean rank; groups of under `least` pairs are left out, and rho is null without spread.

    Equal pairs are counted first; ranks come from counts of values dealt by range.
    """
    one = pairs.where("x is not null and y is not null").select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("_all", F.lit(0))
    keys = by or ("_all",)

    def ranks(side: str) -> DataFrame:
        return value_places(one, side, keys).select(*keys, F.col("value").alias(side), (F.col("lo") + (F.col("c") + 1) / 2).alias(f"r{side}"))

    cells = one.groupBy(*keys, "x", "y").agg(F.count("*").alias("w")).join(ranks("x"), [*keys, "x"]).join(ranks("y"), [*keys, "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    mean = (F.col("n") + 1) / 2  # of ranks, on either side
    sized = cells.join(one.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))
    dx, dy = rx - mean, ry - mean
    out = sized.groupBy(*keys, "n").agg(F.round(F.sum(w * dx * dy) / F.nullif(F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)), F.lit(0.0)), 6).alias("rho"))
    return out.where(F.col("n") >= least).select(*by, "n", "rho")


def annotation_means(annotations: DataFrame, dimensions: tuple[str, ...] = ("relevance", "faithfulness", "conciseness")) -> DataFrame:
    """Mean rating of each dimension for samples with two annotators or more; a dimension nobody rated is 0.

    annotations (sample_id, annotator_id, ratings map<string,int>).
    """
    means = [F.round(F.coalesce(F.avg(F.col("ratings")[d].cast("double")), F.lit(0.0)), 6).alias(d) for d in dimensions]
    return annotations.groupBy("sample_id").agg(F.count_distinct("annotator_id").alias("n_annotators"), *means).where("n_annotators >= 2")


def upsert(annotations: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("annotator_id", "sample_id"), version: str = "version") -> DataFrame:
    """The newest row of each key."""
    both = annotations.unionByName(updates)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def sample_id(number: Column | str) -> Column:
    return F.format_string("s%04d", F.col(number) if isinstance(number, str) else number)


def stratified(rows: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """About `size` rows, each stratum by its share (rounded half to even, at least 1), chosen by hash, at most `size` in all."""
    total = rows.agg(F.count("*").alias("total"))
    quota = rows.groupBy(stratum).agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(size * F.col("c") / F.col("total"))).cast("int").alias("quota"))
    h, _ = shuffled(key, seed)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key)))
    picked = ranked.where(F.col("_n") <= size).join(F.broadcast(quota), stratum).where(F.col("_n") <= F.col("quota"))
    return picked.orderBy("_n", h, key).limit(size).drop("_n", "quota")


def hashed_order(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """`size` rows in a repeatable random order."""
    return rows.orderBy(*shuffled(key, seed)).limit(size)
