"""Ranking, fusion, reranking and rank metrics.

Rankings are rows (query_id, doc_id, rank, score).  Every top-k has a total
order: score rounded to 9 places, then id.  The filter on row_number() comes
before anything else, so that Spark keeps only k rows a group on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def top_k(scored: DataFrame, k: int, order: list[Column] | None = None, by: list[str] | None = None) -> DataFrame:
    order = order or [F.round("score", 9).desc(), F.col("doc_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or ["query_id"])).orderBy(*order))).where(F.col("rank") <= k)


def normalised_weights(dense: float, sparse: float) -> tuple[float, float]:
    return dense / (dense + sparse), sparse / (dense + sparse)


def both_sides(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Dense and sparse ranks and scores of every document that either side has."""
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    return d.join(s, ["query_id", "doc_id"], "full_outer")


def rrf_score(dense_weight: Column, sparse_weight: Column, k_rrf: int = 60) -> Column:
    part = lambda w, r: F.coalesce(w / (k_rrf + F.col(r)), F.lit(0.0))
    return part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank")


def rrf_order() -> list[Column]:
    """Best first; ties keep the dense order, then the sparse one."""
    return [F.round("rrf_score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()]


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 5, weights: tuple[float, float] = (0.5, 0.5), k_rrf: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion; a side without a document adds 0."""
    wd, ws = normalised_weights(*weights)
    return top_k(both_sides(dense, sparse).withColumn("rrf_score", rrf_score(F.lit(wd), F.lit(ws), k_rrf)), k, rrf_order())


def weight_grid(dense: DataFrame, sparse: DataFrame, gold: DataFrame, steps: int = 10, k: int = 5, k_rrf: int = 60) -> DataFrame:
    """recall and mrr at k for steps + 1 weight pairs, from one fusion: both sides are read once and crossed with the few pairs."""
    spark = dense.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(i, (steps - i) / steps, i / steps) for i in range(steps + 1)], "pair int, dense_weight double, sparse_weight double"))
    fused = both_sides(dense, sparse).crossJoin(pairs).withColumn("rrf_score", rrf_score(F.col("dense_weight"), F.col("sparse_weight"), k_rrf))
    hits = top_k(fused, k, rrf_order(), ["pair", "query_id"])
    return rank_metrics(hits, gold, [k], ["pair", "dense_weight", "sparse_weight"], pairs)


def rank_metrics(hits: DataFrame, gold: DataFrame, ks: list[int], by: list[str] | None = None, configs: DataFrame | None = None) -> DataFrame:
    """recall_at_k and mrr: the first rank of a query's gold document, over queries that have one.

    hits (query_id, doc_id, rank and the columns of by), gold (query_id, doc_id).
    """
    gold = gold.where(F.col("doc_id").isNotNull())
    base = gold.select("query_id", F.col("doc_id").alias("gold_id"))
    if by:
        base = base.crossJoin(configs if configs is not None else F.broadcast(hits.select(*by).distinct()))
    keys = ["query_id", *(by or [])]
    found = hits.select(*keys, F.col("doc_id").alias("gold_id"), "rank").groupBy(*keys, "gold_id").agg(F.min("rank").alias("first"))
    first = base.join(found, [*keys, "gold_id"], "left")
    recall = [F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")), 6).alias(f"recall_at_{k}") for k in ks]
    return first.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), *recall, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def depth_sweep(hits: DataFrame, gold: DataFrame, ks: list[int], configs: list[str]) -> DataFrame:
    """recall and mrr of every configuration (a column of hits) at every depth; a first hit below the depth counts for neither."""
    spark = hits.sparkSession
    grid = F.broadcast(spark.createDataFrame([(c, k) for c in configs for k in ks], "config string, k int"))
    base = gold.where(F.col("doc_id").isNotNull()).select("query_id", F.col("doc_id").alias("gold_id")).crossJoin(grid)
    found = hits.select("config", "query_id", F.col("doc_id").alias("gold_id"), "rank").groupBy("config", "query_id", "gold_id").agg(F.min("rank").alias("first"))
    first = base.join(found, ["config", "query_id", "gold_id"], "left")
    hit = F.coalesce(F.col("first") <= F.col("k"), F.lit(False))
    return first.groupBy("config", "k").agg(F.count("*").alias("n_queries"), F.round(F.avg(hit.cast("double")), 6).alias("recall"), F.round(F.avg(F.when(hit, 1.0 / F.col("first")).otherwise(0.0)), 6).alias("mrr"))


Scorer = Callable[[Column, Column], Column]


def lexical_scorer(query: Column, content: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: share of the query's distinct words in the content, on a logit-like scale."""
    q = F.array_distinct(T.tokens(query))
    share = F.size(F.array_intersect(q, T.tokens(content))) / F.greatest(F.size(q), F.lit(1))
    return F.round(12.0 * share - 6.0, 9)


BROADCAST_HITS = 200_000


def rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, top: int | None = None, scorer: Scorer = lexical_scorer, most_hits: int | None = None) -> DataFrame:
    """hits with rerank_score and a new rank (prior one as prior_rank), best first, ties by prior rank.

    most_hits is how many hits a query has at most, if that is known: where all
    hits together are few, they go to the corpus, so that of it only the hits'
    texts are kept and nothing of it is shuffled.  Otherwise both sides are.
    """
    asked = hits.withColumnRenamed("rank", "prior_rank").join(queries.select("query_id", "query"), "query_id")
    if most_hits is not None and queries.count() * most_hits <= BROADCAST_HITS:
        asked = F.broadcast(asked)
    scored = corpus.select("doc_id", "content").join(asked, "doc_id")
    scored = scored.withColumn("rerank_score", scorer(F.col("query"), F.col("content"))).select(*[c for c in asked.columns if c != "query"], "rerank_score")
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "prior_rank")))
    return out if top is None else out.where(F.col("rank") <= top)


def batch_rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, top: int | None = None, scorer: Scorer = lexical_scorer, most_hits: int | None = None) -> DataFrame:
    """As rerank(), but a top of 0 keeps everything."""
    return rerank(hits, queries, corpus, top or None, scorer, most_hits)


def rank_migration(before: DataFrame, after: DataFrame, absent: int = 21) -> DataFrame:
    """How documents of `after` moved against `before`; those that weren't there count as at rank `absent`."""
    pre = before.select("query_id", "doc_id", F.col("rank").alias("pre"))
    out = after.select("query_id", "doc_id", F.col("rank").alias("post_rank")).join(pre, ["query_id", "doc_id"], "left").withColumn("pre_rank", F.coalesce("pre", F.lit(absent)))
    move = F.when(F.col("pre").isNull(), "new").when(F.col("post_rank") < F.col("pre_rank"), "up").when(F.col("post_rank") > F.col("pre_rank"), "down").otherwise("same")
    return out.select("query_id", "doc_id", "pre_rank", "post_rank", (F.col("pre_rank") - F.col("post_rank")).alias("delta"), move.alias("movement"))


def failure_cases(first: DataFrame, second: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Queries that only one of two systems answers: improved, degraded and the net, with counts for both and neither."""

    def hit(hits: DataFrame, name: str) -> DataFrame:
        return hits.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn(name, F.lit(True))

    flags = gold.where(F.col("doc_id").isNotNull()).select("query_id").distinct().join(hit(first, "a"), "query_id", "left").join(hit(second, "b"), "query_id", "left").na.fill(False, ["a", "b"])
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("a"), F.col("b")
    return flags.agg(count(~a & b).alias("improved"), count(a & ~b).alias("degraded"), (count(~a & b) - count(a & ~b)).alias("net"), count(a & b).alias("both"), count(~a & ~b).alias("neither"))
