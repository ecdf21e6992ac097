"""Ranks and exact quantiles of large groups, from counts of values dealt by range.

No task sees a whole group: values are counted (partial sums), an approximate
sketch gives each group at most CUTS bounds, and places are running sums inside
a range plus the sums of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def value_places(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by..., value, c, lo, n): each distinct value's count, how many values of its group are less, and the group's size.  Nulls and NaN are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("value"))
    counts = rows.groupBy(*by, "value").agg(F.count("*").alias("c"))
    sketch = rows.groupBy(*by).agg(F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], 1000).alias("_cuts"), F.count("*").alias("n"))
    if by:
        sketch = sketch.select(*[F.col(b).alias(f"_{b}") for b in by], "_cuts", "n")
        on = _same(by[0], f"_{by[0]}")
        for b in by[1:]:
            on = on & _same(b, f"_{b}")
        held = counts.join(sketch, on).drop(*[f"_{b}" for b in by])
    else:
        held = counts.crossJoin(F.broadcast(sketch))
    held = held.withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col("value")))).drop("_cuts")
    totals = held.groupBy(*by, "_range").agg(F.sum("c").alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most CUTS rows a group
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_range").alias("_r"), "_before")
    on = F.col("_range") == F.col("_r")
    for b in by:
        on = on & _same(b, f"_{b}")
    held = held.join(totals, on).drop("_r", *[f"_{b}" for b in by])
    inside = Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("lo", F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).select(*by, "value", "c", "lo", "n")


def quantiles(df: DataFrame, value: str, by: tuple[str, ...], qs: dict[str, float]) -> DataFrame:
    """(by..., one column a name of qs): exact quantiles, linear between neighbours."""
    places = value_places(df, value, by)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("lo") <= index) & (index < F.col("lo") + F.col("c")), F.col("value")))

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        return at(low) + (at(high) - at(low)) * F.max(place - low)

    return places.groupBy(*by).agg(*[quantile(q).alias(name) for name, q in qs.items()])


def with_quantiles(summary: DataFrame, df: DataFrame, value: str, by: tuple[str, ...], qs: dict[str, float], places: int = 6) -> DataFrame:
    """A summary by group (one row if there are none) with rounded quantiles; null where a group has no values."""
    q = quantiles(df, value, by, qs).select(*[F.col(b).alias(f"_{b}") for b in by], *[F.round(name, places).alias(name) for name in qs])
    if not by:
        return summary.crossJoin(F.broadcast(q))
    on = _same(by[0], f"_{by[0]}")
    for b in by[1:]:
        on = on & _same(b, f"_{b}")
    return summary.join(q, on, "left").drop(*[f"_{b}" for b in by])
