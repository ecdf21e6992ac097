"""Aggregates over per-query results, error taxonomy, regression checks and costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions import text as T
from ..sources.shared import written
from .quantiles import with_quantiles

#: Fixed values.
CATEGORIES = ("correct", "empty_response", "retrieval_failure", "hallucination", "low_context_relevance", "incomplete_answer", "verbose_answer", "wrong_answer")
FLOORS = {"f1": 0.25, "rouge_l": 0.20, "faithfulness": 0.40, "exact_match": 0.05}
#: USD for a million input and output tokens.
PRICES = {
    "qwen2.5-3b-instruct": (0.0, 0.0),
    "mistral-small-latest": (0.20, 0.60),
    "mistral-large-latest": (2.0, 6.0),
    "gpt-4o": (2.50, 10.0),
    "gpt-4o-mini": (0.15, 0.60),
    "claude-3.5-sonnet": (3.0, 15.0),
}
NOT_METRICS = ("retry_count",)


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns, booleans among them."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType | BooleanType) and f.name not in without]


def long_metrics(results: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep..., metric, value); null and NaN values are left out."""
    wide = results.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(keep, metrics, "metric", "value").where("value is not null and not isnan(value)")


def aggregate(results: DataFrame, metrics: list[str], by: tuple[str, ...] = ("config",)) -> DataFrame:
    """mean, population deviation, least, most, median and 95th percentile of each metric.

    Metrics are costly to make and read three times (summary, counts of values,
    their sketch), so they are written once, as narrow rows.
    """
    made = written(results.select(*by, *metrics), "metrics")
    v, rows = F.col("value"), long_metrics(made, metrics, list(by))
    out = rows.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"))
    return with_quantiles(out, rows, "value", (*by, "metric"), {"p50": 0.5, "p95": 0.95})


def config_deltas(aggregates: DataFrame) -> DataFrame:
    """Every pair of configurations, by name: difference of means, and its share of the first (0 if that is 0)."""
    a = aggregates.select(F.col("config").alias("config_a"), "metric", F.col("mean").alias("mean_a"))
    b = aggregates.select(F.col("config").alias("config_b"), "metric", F.col("mean").alias("mean_b"))
    d = F.col("mean_b") - F.col("mean_a")
    return a.join(b, "metric").where("config_a < config_b").select("config_a", "config_b", "metric", F.round(d, 6).alias("delta"), F.round(F.when(F.col("mean_a") == 0, 0.0).otherwise(d / F.col("mean_a")), 6).alias("relative"))


def baseline_deltas(aggregates: DataFrame, baseline: str) -> DataFrame:
    base = aggregates.where(F.col("config") == baseline).select("metric", F.col("mean").alias("base"))
    return aggregates.where(F.col("config") != baseline).join(base, "metric").select("config", "metric", F.round(F.col("mean") - F.col("base"), 6).alias("delta"))


def distribution(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Latency-style summary: mean, median, deviation, extremes, 95th and 99th percentiles (linear)."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.round(F.min(value), 6).alias("min"), F.round(F.max(value), 6).alias("max"))
    return with_quantiles(out, df.select(*by, value.cast("double").alias("_v")), "_v", by, {"median": 0.5, "p95": 0.95, "p99": 0.99})


def tracked(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Tracker-style summary with the sample deviation, 0 for a single value."""
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("min"), F.round(F.max(value), 6).alias("max"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.count(value).alias("count"))


def histogram(df: DataFrame, value: Column, low: int, high: int, step: int = 1) -> DataFrame:
    """Counts in [low, high) by step, empty bins included: what a bar chart needs."""
    bins = df.sparkSession.range(low, high, step).select(F.col("id").alias("bin"))
    counted = df.where((value >= low) & (value < high)).groupBy((F.floor((value - low) / step) * step + low).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def filled_counts(df: DataFrame, value: str) -> DataFrame:
    """Counts for 0 .. the largest value of a whole-number column, zeros included."""
    counted = df.groupBy(F.col(value).cast("long").alias(value)).agg(F.count("*").alias("n"))
    every = df.agg(F.max(F.col(value).cast("long")).alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias(value))
    return every.join(counted, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ taxonomy
def flat_metrics(results: DataFrame, nested: str = "metrics") -> DataFrame:
    """results with a struct of metrics raised to columns; a column that is there already wins unless null."""
    if nested not in results.columns:
        return results
    fields = results.schema[nested].dataType.names
    return results.withColumns({n: F.coalesce(F.col(n), F.col(f"{nested}.{n}")) if n in results.columns else F.col(f"{nested}.{n}") for n in fields}).drop(nested)


def categories(f1_threshold: float = 0.3, faithfulness_threshold: float = 0.5) -> Column:
    """The error categories of a result row (prediction, ground_truth, retrieved_contexts, f1, exact_match, rouge_l, faithfulness)."""
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    prediction, truth = T.strip(F.coalesce("prediction", F.lit(""))), F.lower(F.coalesce("ground_truth", F.lit("")))
    f1, em, rouge, faith = num("f1"), num("exact_match"), num("rouge_l"), F.col("faithfulness")
    contexts = F.filter(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), lambda c: c.isNotNull())
    missed = (F.size(F.coalesce("retrieved_contexts", F.array().cast("array<string>"))) > 0) & (truth != "") & ~F.exists(contexts, lambda c: F.contains(F.lower(c), truth))
    unfaithful = F.coalesce(faith < faithfulness_threshold, F.lit(False))
    made_up = unfaithful & (f1 > 0)
    short = (F.size(T.words(prediction)) < 3) & (f1 < f1_threshold)
    flags = {
        "retrieval_failure": missed,
        "hallucination": made_up,
        "low_context_relevance": unfaithful & ~missed & ~made_up,
        "incomplete_answer": short,
        "verbose_answer": (rouge > 0.4) & (em == 0) & (f1 < 0.5),
        "wrong_answer": (f1 < f1_threshold) & (em == 0) & ~made_up & ~short,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    one = lambda n: F.array(F.lit(n))
    return F.when((em == 1) | (f1 >= 0.8), one("correct")).when(prediction == "", one("empty_response")).when(F.size(found) == 0, one("wrong_answer")).otherwise(found)


def badness() -> Column:
    """0.5 f1 + 0.3 faithfulness (0.5 if null) + 0.2 exact match; lower is worse."""
    return 0.5 * F.coalesce("f1", F.lit(0.0)) + 0.3 * F.coalesce("faithfulness", F.lit(0.5)) + 0.2 * F.coalesce("exact_match", F.lit(0.0))


def error_distribution(categorised: DataFrame) -> DataFrame:
    """Counts of all categories, zeros included, and the share of rows that aren't correct: one pass, over a row a set of categories from then on."""
    spark = categorised.sparkSession
    names = F.broadcast(spark.createDataFrame([(i, n) for i, n in enumerate(CATEGORIES)], "ord int, category string"))
    sets = written(categorised.groupBy("categories").agg(F.count("*").alias("n")), "category-sets")
    counted = sets.select(F.explode("categories").alias("category"), "n").groupBy("category").agg(F.sum("n").alias("n"))
    right = F.sum(F.when(F.array_contains("categories", "correct"), F.col("n")).otherwise(0))
    rate = sets.agg(F.round(F.coalesce(1 - right / F.sum("n"), F.lit(0.0)), 6).alias("error_rate"))
    return names.join(counted, "category", "left").crossJoin(F.broadcast(rate)).select("category", F.coalesce("n", F.lit(0)).alias("n"), "error_rate")


def first_examples(categorised: DataFrame, order: str, most: int = 5) -> DataFrame:
    """The first rows of each category in input order."""
    rows = categorised.select(order, F.explode("categories").alias("category"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(order))).where(F.col("place") <= most)


def worst(results: DataFrame, order: str, most: int = 20) -> DataFrame:
    return results.withColumn("badness", F.round(badness(), 6)).orderBy("badness", order).limit(most)


# ---------------------------------------------------------------- regression
def regressions(current: DataFrame, baseline: DataFrame | None = None, floors: dict[str, float] | None = None, tolerance: float = 0.10) -> DataFrame:
    """(metric, kind, current, reference, threshold) of failures and warnings; current and baseline are (metric, mean).

    Every metric of the baseline counts as better when larger, latency too.
    """
    spark = current.sparkSession
    limits = F.broadcast(spark.createDataFrame(list((floors or FLOORS).items()), "metric string, floor double"))
    low = current.join(limits, "metric").withColumn("kind", F.when(F.col("mean") < F.col("floor"), "absolute").when(F.col("mean") < F.col("floor") * 1.1, "warning")).where("kind is not null")
    out = low.select("metric", "kind", F.round("mean", 6).alias("current"), F.lit(None).cast("double").alias("reference"), F.col("floor").alias("threshold"))
    if baseline is not None:
        drop = (F.col("base") - F.col("mean")) / F.col("base")
        rel = current.join(baseline.select("metric", F.col("mean").alias("base")), "metric").where((F.col("base") != 0) & (drop > tolerance))
        out = out.unionByName(rel.select("metric", F.lit("relative").alias("kind"), F.round("mean", 6).alias("current"), F.round("base", 6).alias("reference"), F.lit(tolerance).alias("threshold")))
    return out


# --------------------------------------------------------------------- costs
def price_table(spark, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in (prices or PRICES).items()], "model string, input_price double, output_price double")


def cost(input_tokens: Column | str, output_tokens: Column | str) -> Column:
    return (T.col(input_tokens) * F.col("input_price") + T.col(output_tokens) * F.col("output_price")) / 1e6


def model_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens) with cost; an unknown model is an error."""
    joined = usage.join(F.broadcast(prices), "model", "left")
    known = F.when(F.col("input_price").isNull(), F.raise_error(F.concat(F.lit("unknown model: "), "model")).cast("double")).otherwise(cost("input_tokens", "output_tokens"))
    return joined.withColumn("cost", known).drop("input_price", "output_price")


def cost_summary(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals and means of every usage row under every model's price."""
    priced = usage.crossJoin(F.broadcast(prices)).withColumn("cost", cost("input_tokens", "output_tokens"))
    return priced.groupBy("model").agg(F.count("*").alias("n_queries"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg("input_tokens"), 6).alias("avg_input"), F.round(F.avg("output_tokens"), 6).alias("avg_output"), F.round(F.sum("cost"), 8).alias("total_cost"), F.round(F.avg("cost"), 10).alias("avg_cost"))


def rough_cost(query: Column | str, answer: Column | str) -> tuple[Column, Column]:
    """Input and output tokens at four characters each; the prompt counts 2500 characters besides the query."""
    return F.expr("1") * F.floor((F.length(T.col(query)) + 2500) / 4).cast("long"), F.floor(F.length(T.col(answer)) / 4).cast("long")


def grading_cost(calls: Column, input_price: float = 0.2, output_price: float = 0.6) -> Column:
    """Cost of grader calls at 500 tokens in and 10 out."""
    return calls * F.lit((500 * input_price + 10 * output_price) / 1e6)


def routing_rates(states: DataFrame) -> DataFrame:
    """Rates over final pipeline states: retries, acceptance, fallback and web use, and scores."""
    avg = lambda c: F.round(F.avg(c.cast("double")), 6)
    return states.agg(
        F.count("*").alias("n"), avg(F.col("retry_count") > 0).alias("retry_rate"), avg(F.col("retry_count")).alias("avg_retries"), F.max("retry_count").cast("long").alias("max_retries"), avg(F.col("answer_is_acceptable")).alias("acceptable_rate"),
        avg(F.col("used_fallback_retrieval")).alias("fallback_rate"), avg(F.col("used_web_search")).alias("web_rate"), F.round(F.min("min_rerank_score"), 6).alias("score_min"), avg(F.col("min_rerank_score")).alias("score_mean"), F.round(F.max("min_rerank_score"), 6).alias("score_max"),
    )


def grader_rates(results: DataFrame, good_f1: float = 0.3) -> DataFrame:
    """False rejections (rejected though f1 is good), retries and cost of a grader."""
    return results.agg(F.round(F.avg((~F.col("answer_is_acceptable") & (F.col("f1") >= good_f1)).cast("double")), 6).alias("false_rejection_rate"), F.round(F.avg((F.col("retry_count") > 0).cast("double")), 6).alias("retry_rate"), F.round(F.sum(grading_cost(F.col("retry_count") + 1 + F.greatest(F.col("num_docs_graded"), F.lit(0)))), 8).alias("grading_cost"))


def grading_accurate(gold: Column | str, kept: Column | str) -> Column:
    """Whether at least min(2, number of gold titles) gold titles were kept."""
    g = F.array_distinct(T.col(gold))
    return F.size(F.array_intersect(g, T.col(kept))) >= F.least(F.lit(2), F.size(g))


def fallback_effect(first: DataFrame, second: DataFrame, key: str = "query_id", same: float = 1e-9) -> DataFrame:
    """F1 of two systems by whether the second (key, f1, used_fallback_retrieval) fell back: means, their difference, and how many rose, fell or stayed."""
    both = first.select(key, F.col("f1").alias("a")).join(second.select(key, F.col("f1").alias("b"), "used_fallback_retrieval"), key)
    d = F.col("b") - F.col("a")
    count = lambda c: F.sum(c.cast("long"))
    return both.groupBy("used_fallback_retrieval").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("f1_first"), F.round(F.avg("b"), 6).alias("f1_second"), F.round(F.avg(d), 6).alias("delta"), count(d > same).alias("improved"), count(F.abs(d) <= same).alias("same"), count(d < -same).alias("degraded"))


TokenEncoder = Callable[[list[str]], list]


def bert_score(results: DataFrame, encoder: TokenEncoder | None = None) -> DataFrame:
    """results with bert_score: the F1 of tokens matched greedily by cosine; null without an encoder (texts to a matrix of token vectors each)."""
    if encoder is None:
        return results.withColumn("bert_score", F.lit(None).cast("double"))
    import numpy as np
    import pandas as pd

    def unit(x) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x

    def run(prediction: pd.Series, truth: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(map(unit, encoder(prediction.fillna("").tolist())), map(unit, encoder(truth.fillna("").tolist())), strict=True):
            s = a @ b.T if len(a) and len(b) else np.zeros((1, 1))
            p, r = s.max(axis=1).mean(), s.max(axis=0).mean()
            out.append(float(2 * p * r / (p + r)) if p + r > 0 else 0.0)
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"prediction": pd.Series, "truth": pd.Series, "return": pd.Series}
    return results.withColumn("bert_score", F.pandas_udf(run, "double")("prediction", "ground_truth"))


def judged(results: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """results with `judgements`, a map of scores from an injected judge (results to (query_id, judgements)); empty without one or where it fails to answer."""
    none = F.create_map().cast("map<string,double>")
    if judge is None:
        return results.withColumn("judgements", none)
    return results.join(judge(results).select("query_id", "judgements"), "query_id", "left").withColumn("judgements", F.coalesce("judgements", none))


def mean_of_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means that leave out nulls and NaN."""
    return df.agg(*[F.round(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))), 6).alias(c) for c in columns])
