"""The registered queries of the engine's own operators; their SQL is in catalog_sql.

All of them read whole tables.  Retrieval queries are the passages of
`benchmark`; dense queries are the vectors whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_sources, catalog_sql
from .functions import text as T
from .functions.rouge import rouge_l
from .operators import bm25_index, chunking, dense, evaluation, ranking, sparse, statistics, telemetry
from .operators.bm25_index import Bm25Index
from .plans import adaptive
from .sources import qa, sinks
from .sources.shared import fresh_path, written
from .streaming import stateful
from .streaming import telemetry as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return {**QUERIES, **catalog_sources.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalog_sql.oracle_sql(), **catalog_sources.SQL}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


def passages(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(spark, d):
    return vectors(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def gold(spark, d):
    """The first document that contains each passage."""
    return qa.containing(corpus(spark, d), passages(spark, d)).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))


def bm25_hits(spark, d, k=20):
    return sparse.search(corpus(spark, d), passages(spark, d), k)


def dense_hits(spark, d, k=20):
    """A passage's vector is the one with its id."""
    v = vectors(spark, d)
    q = v.join(passages(spark, d).select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "embedding")
    return dense.search(v, q, k)


def turns(spark, d):
    """User turns with the assistant's answer to each as prediction, and the question as the truth and only context."""
    c = table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    both = user.join(reply, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "query", F.col("query").alias("ground_truth"), "prediction", F.array("query").alias("retrieved_contexts"))


def results(spark, d):
    """turns() with their metrics."""
    return turns(spark, d).withColumns({
        "exact_match": T.exact_match("prediction", "ground_truth"),
        "f1": F.round(T.token_f1("prediction", "ground_truth"), 9),
        "rouge_l": F.round(rouge_l("prediction", "ground_truth", stemmed=False), 9),
        "faithfulness": F.round(T.word_overlap("prediction", "retrieved_contexts"), 9),
    })


# ------------------------------------------------------------------ retrieval
@query
def bm25_topk(spark, d):
    return bm25_hits(spark, d, 5).withColumn("score", F.round("score", 6))


def bm25_stored_index(spark, d):
    """An index of half of the documents, to which the other half is added, merged."""
    c, path = corpus(spark, d), fresh_path(spark, "bm25")
    Bm25Index.build(c.where("doc_id % 2 = 0"), path).add(c.where("doc_id % 2 <> 0")).merge()
    return Bm25Index.open(spark, path)


@query
def bm25_stored(spark, d):
    """bm25_topk through a stored index."""
    return bm25_index.search(bm25_stored_index(spark, d), passages(spark, d), 5).withColumn("score", F.round("score", 6))


@query
def bm25_stored_reads(spark, d):
    """What that search reads of the index and as a share of the corpus' bytes."""
    index, reads = bm25_stored_index(spark, d), []
    bm25_index.search(index, passages(spark, d), 5, reads=reads)
    return bm25_index.reading(index, reads)


@query
def bm25_filled(spark, d):
    """Queries of one rare word each (a passage's longest): fewer documents than k match, and others fill up."""
    longest = F.array_sort(T.tokens("query"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))[0]
    q = passages(spark, d).select("query_id", longest.alias("query"))
    return sparse.search(corpus(spark, d), q, 5, fill=True).withColumn("score", F.round("score", 6))


@query
def bm25_index_stats(spark, d):
    return sparse.index_stats(corpus(spark, d))


@query
def bm25_idf(spark, d):
    return sparse.inverse_frequencies(sparse.spread(corpus(spark, d))).withColumn("idf", F.round("idf", 6))


@query
def dense_topk_cosine(spark, d):
    return dense.search(vectors(spark, d), vector_queries(spark, d), 10).withColumn("score", F.round("score", 6))


@query
def dense_topk_l2(spark, d):
    return dense.search(vectors(spark, d), vector_queries(spark, d), 10, "euclidean").withColumn("score", F.round("score", 6))


@query
def dense_label_precision(spark, d):
    """Share of the ten nearest other vectors with the query's label."""
    hits = dense.search(vectors(spark, d), vector_queries(spark, d), 11).where("query_id <> doc_id")
    hits = ranking.top_k(hits.drop("rank"), 10).join(vectors(spark, d).select("doc_id", "label"), "doc_id").join(vector_queries(spark, d).select("query_id", "query_label"), "query_id")
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("precision"))


@query
def rrf_hybrid(spark, d):
    out = ranking.rrf(dense_hits(spark, d), bm25_hits(spark, d), 5)
    return out.select("query_id", "rank", "doc_id", F.round("rrf_score", 9).alias("rrf_score"), "dense_rank", "sparse_rank")


@query
def rrf_weight_grid(spark, d):
    return ranking.weight_grid(dense_hits(spark, d), bm25_hits(spark, d), gold(spark, d)).drop("dense_weight", "sparse_weight")


@query
def rrf_failure_cases(spark, d):
    low = bm25_hits(spark, d)
    return ranking.failure_cases(dense_hits(spark, d), ranking.rrf(dense_hits(spark, d), low, 5), gold(spark, d))


@query
def recall_mrr(spark, d):
    return ranking.rank_metrics(bm25_hits(spark, d), gold(spark, d), [1, 5, 10])


@query
def recall_by_config(spark, d):
    low, high = bm25_hits(spark, d), dense_hits(spark, d)
    tagged = lambda df, name: df.select("query_id", "doc_id", "rank", F.lit(name).alias("config"))
    every = tagged(low, "bm25").unionByName(tagged(high, "dense")).unionByName(tagged(ranking.rrf(high, low, 20), "hybrid"))
    configs = F.broadcast(spark.createDataFrame([("bm25",), ("dense",), ("hybrid",)], "config string"))
    return ranking.rank_metrics(every, gold(spark, d), [1, 5], ["config"], configs)


@query
def gold_documents(spark, d):
    return qa.containing(corpus(spark, d), passages(spark, d))


@query
def rerank_lexical(spark, d):
    out = ranking.rerank(bm25_hits(spark, d), passages(spark, d), corpus(spark, d), 5, most_hits=20)
    return out.select("query_id", "rank", "doc_id", "prior_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query
def rank_migration(spark, d):
    hits = bm25_hits(spark, d)
    return ranking.rank_migration(hits, ranking.rerank(hits, passages(spark, d), corpus(spark, d), 5, most_hits=20))


# ------------------------------------------------------------------- chunking
@query
def chunk_fixed(spark, d):
    return chunking.fixed(corpus(spark, d), 128, 16)


@query
def chunk_sliding(spark, d):
    return chunking.sliding(corpus(spark, d), 128, 96)


@query
def chunk_semantic(spark, d):
    return chunking.semantic(corpus(spark, d), 60, 10, 100)


@query
def chunk_stats(spark, d):
    c = corpus(spark, d)
    tagged = [chunking.by_strategy(c, s, 128, 16).select(F.lit(s).alias("strategy"), "content") for s in ("fixed", "sliding")]
    return chunking.stats(tagged[0].unionByName(tagged[1]), "strategy")


@query
def doc_eda(spark, d):
    n, w = F.length("text"), F.size(T.words("text"))
    return table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.sum(w).alias("words"), F.round(F.avg(w), 6).alias("avg_words"), F.count_distinct("source").alias("sources"), F.round(F.avg((F.col("lang") == "en").cast("double")), 6).alias("english_share"))


@query
def doc_dedup_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    return qa.first_by(rows, "text", "doc_id").select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query
def top_sources(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


# -------------------------------------------------------------- answer metrics
@query
def qa_exact_match(spark, d):
    return turns(spark, d).select("pair_id", T.exact_match("prediction", "ground_truth").alias("exact_match"), F.md5(T.normalised("ground_truth")).alias("normalised_md5"))


@query
def qa_token_f1(spark, d):
    return turns(spark, d).select("pair_id", F.round(T.token_f1("prediction", "ground_truth"), 6).alias("f1"))


@query
def qa_rouge_l(spark, d):
    return turns(spark, d).select("pair_id", F.round(rouge_l("prediction", "ground_truth", stemmed=False), 6).alias("rouge_l"))


@query
def qa_rouge_l_stemmed(spark, d):
    return turns(spark, d).select("pair_id", F.round(rouge_l("prediction", "ground_truth"), 6).alias("rouge_l"))


@query
def word_overlap_faithfulness(spark, d):
    return turns(spark, d).select("pair_id", F.round(T.word_overlap("prediction", "retrieved_contexts"), 6).alias("faithfulness"), T.contributing_contexts("prediction", "retrieved_contexts").cast("long").alias("contributing"))


@query
def sentence_faithfulness(spark, d):
    """Share of the answer's sentences whose vector is within 0.65 cosine of a context's."""
    t = turns(spark, d)
    s = dense.encoded(t.select("pair_id", F.explode(F.filter(F.transform(F.split("prediction", r"\."), T.strip), lambda x: x != "")).alias("sentence")), "sentence", out="a")
    c = dense.encoded(t.select("pair_id", F.explode("retrieved_contexts").alias("context")), "context", out="b")
    best = s.withColumn("n", F.monotonically_increasing_id()).join(c, "pair_id").groupBy("pair_id", "n").agg(F.max(T.dot("a", "b")).alias("best"))
    return best.groupBy("pair_id").agg(F.round(F.avg((F.col("best") >= 0.65).cast("double")), 6).alias("faithfulness"))


# ------------------------------------------------------------------ aggregates
METRICS = ["f1", "exact_match", "rouge_l", "faithfulness"]


def tagged_results(spark, d):
    """Results under two configurations: all metrics, and with the roles of question and answer changed for faithfulness."""
    turned = F.round(T.word_overlap("ground_truth", F.array("prediction")), 9)
    one = lambda name, c: F.struct(F.lit(name).alias("config"), c.alias("faithfulness"))
    r = results(spark, d).withColumn("as", F.explode(F.array(one("direct", F.col("faithfulness")), one("reversed", turned))))
    return r.withColumn("faithfulness", F.col("as.faithfulness")).select("as.config", "pair_id", *METRICS)


@query
def metric_aggregate(spark, d):
    return evaluation.aggregate(tagged_results(spark, d), METRICS)


@query
def config_deltas(spark, d):
    return evaluation.config_deltas(evaluation.aggregate(tagged_results(spark, d), METRICS))


@query
def latency_stats(spark, d):
    return evaluation.distribution(table(spark, d, "events"), F.col("value"), "event_type")


@query
def tracked_values(spark, d):
    return evaluation.tracked(table(spark, d, "events"), F.col("value"), "user_id")


@query
def value_histogram(spark, d):
    return evaluation.histogram(table(spark, d, "events"), F.col("value"), 0, 500, 10)


@query
def turn_histogram(spark, d):
    return evaluation.filled_counts(table(spark, d, "conversations"), "turn")


@query
def error_taxonomy(spark, d):
    return results(spark, d).select("pair_id", F.array_join(evaluation.categories(), ",").alias("categories"))


def categorised(spark, d):
    return results(spark, d).withColumn("categories", evaluation.categories())


@query
def error_distribution(spark, d):
    return evaluation.error_distribution(categorised(spark, d))


@query
def examples_per_category(spark, d):
    """The categories are written first: under an explode Spark makes them, and the metrics in them, again for its filter and each use."""
    return evaluation.first_examples(written(categorised(spark, d).select("pair_id", "categories"), "categorised"), "pair_id")


@query
def worst_predictions(spark, d):
    return evaluation.worst(results(spark, d), "pair_id").select("pair_id", "badness")


# ------------------------------------------------------------------ statistics
def ab_pairs(spark, d):
    """Users' mean value and number of events: views against clicks."""

    def side(kind):
        e = table(spark, d, "events").where(F.col("event_type") == kind)
        return e.groupBy(F.col("user_id").alias("query_id")).agg(F.round(F.avg("value"), 9).alias("f1"), F.count("*").alias("faithfulness"))

    return statistics.paired(side("view"), side("click"), ["f1", "faithfulness"])


@query
def ab_paired_stats(spark, d):
    return statistics.paired_stats(ab_pairs(spark, d))


@query
def ab_p_values(spark, d):
    return statistics.tested(statistics.paired_stats(ab_pairs(spark, d))).select("metric", F.round("p_value", 6).alias("p_value"), "significant")


@query
def ab_winner(spark, d):
    return statistics.winner(statistics.tested(statistics.paired_stats(ab_pairs(spark, d))), "f1", ["faithfulness"])


@query
def ab_bootstrap_ci(spark, d):
    return statistics.bootstrap(ab_pairs(spark, d), number=F.col("query_id"))


@query
def kappa_quadratic(spark, d):
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return statistics.weighted_kappa(labels.select("lang", (F.col("quality") * 4 + 1).alias("x"), (5 - F.col("toxic") * 4).alias("y")), ("lang",))


@query
def spearman_ties(spark, d):
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return statistics.spearman(labels.select("lang", F.col("n_chars").alias("x"), F.col("quality").alias("y")), ("lang",))


def annotations(spark, d):
    """Two annotators: one rates all labelled documents, the other the English ones."""
    rated = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    a = rated.select(F.lit("a").alias("annotator_id"), statistics.sample_id("doc_id").alias("sample_id"), F.create_map(F.lit("relevance"), F.col("quality") * 4 + 1, F.lit("faithfulness"), 5 - F.col("toxic") * 4).alias("ratings"), F.lit(1).alias("version"))
    b = rated.where("lang = 'en'").select(F.lit("b").alias("annotator_id"), statistics.sample_id("doc_id").alias("sample_id"), F.create_map(F.lit("relevance"), F.lit(3)).alias("ratings"), F.lit(1).alias("version"))
    return a.unionByName(b)


@query
def annotation_means(spark, d):
    return statistics.annotation_means(annotations(spark, d))


@query
def annotation_upsert(spark, d):
    base = annotations(spark, d)
    new = base.where("annotator_id = 'b'").withColumns({"ratings": F.create_map(F.lit("relevance"), F.lit(5)), "version": F.lit(2)})
    return statistics.upsert(base, new).select("annotator_id", "sample_id", F.col("ratings")["relevance"].alias("relevance"), "version")


@query
def stratified_sample(spark, d):
    return statistics.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query
def regression_check(spark, d):
    now = evaluation.aggregate(tagged_results(spark, d).where("config = 'direct'"), METRICS).select("metric", "mean")
    base = spark.createDataFrame([("f1", 0.3), ("faithfulness", 0.01), ("exact_match", 0.0)], "metric string, mean double")
    return evaluation.regressions(now, base)


@query
def cost_summary(spark, d):
    usage = turns(spark, d).select(T.token_estimate("query").cast("long").alias("input_tokens"), T.token_estimate("prediction").cast("long").alias("output_tokens"))
    return evaluation.cost_summary(usage, evaluation.price_table(spark))


# --------------------------------------------------------------------- prompts
@query
def context_format(spark, d):
    """The context block of each passage's five best documents, as its length and digest."""
    hits = bm25_hits(spark, d, 5).join(corpus(spark, d), "doc_id")
    docs = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("docs"))
    block = T.context_block("docs")
    return docs.select("query_id", F.length(block).cast("long").alias("n_chars"), F.md5(block).alias("block_md5"), F.md5(T.numbered("docs")).alias("numbered_md5"))


@query
def prompt_build(spark, d):
    hits = bm25_hits(spark, d, 5).join(corpus(spark, d), "doc_id").join(passages(spark, d), "query_id")
    docs = hits.groupBy("query_id", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("docs"))
    return docs.select("query_id", F.md5(T.fill_template(adaptive.PROMPT, context=T.context_block("docs"), question=F.col("query"))).alias("prompt_md5"))


@query
def answer_cleanup(spark, d):
    c = T.clean_answer(F.concat(F.lit("Answer: "), "prediction", F.lit(" Note: more.")))
    return turns(spark, d).select("pair_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("answer_md5"))


@query
def rewrite_cleanup(spark, d):
    c = T.clean_rewrite(F.concat(F.lit('Rewritten query: "'), "prediction", F.lit('"')), "query")
    return turns(spark, d).select("pair_id", c.alias("rewritten"))


@query
def grade_parse(spark, d):
    """Graders' responses made from labels: JSON, JSON in prose, words, and nothing usable."""
    p = table(spark, d, "labels")
    q, t = (F.col("quality") == 1).cast("string"), (F.col("toxic") == 0).cast("string")
    forms = [F.format_string('{"grades": [%s, %s]}', q, t), F.format_string('Sure. {"grades": [%s, %s]} ok', q, t), F.format_string("first %s then %s", q, t), F.lit("hard to say")]
    response = F.element_at(F.array(*forms), (F.col("doc_id") % 4 + 1).cast("int"))
    g = T.grades(response, F.lit(2))
    return p.select("doc_id", g[0].alias("first"), g[1].alias("second"), T.yes_no(F.when(F.col("quality") == 1, "Yes.").otherwise("I know it is no.")).alias("said_yes"))


# -------------------------------------------------------------------- adaptive
def route_threshold():
    return 0.0


@query
def adaptive_route(spark, d):
    """The least rerank score among the five best of each passage, and where it sends the query."""
    low = ranking.rerank(bm25_hits(spark, d), passages(spark, d), corpus(spark, d), 5, most_hits=20).groupBy("query_id").agg(F.round(F.min("rerank_score"), 6).alias("min_rerank_score"))
    out = passages(spark, d).select("query_id").join(low, "query_id", "left").withColumn("min_rerank_score", F.coalesce("min_rerank_score", F.lit(0.0)))
    return out.withColumn("route", F.when(F.col("min_rerank_score") >= route_threshold(), "acceptable").otherwise("fallback"))


def final_states(spark, d):
    settings = adaptive.Settings(retrieval_threshold=route_threshold(), grade_documents=True, grade_answers=True, max_retries=1)
    return adaptive.Pipeline(corpus(spark, d), settings=settings).adaptive(passages(spark, d))


@query
def retry_unrolled(spark, d):
    s = final_states(spark, d)
    return s.select("query_id", F.size("documents").alias("n_docs"), F.round("min_rerank_score", 6).alias("min_rerank_score"), "used_fallback_retrieval", "num_docs_graded", "answer_is_acceptable", "retry_count", F.size("intermediate_steps").alias("n_steps"))


@query
def agentic_rates(spark, d):
    return evaluation.routing_rates(final_states(spark, d))


@query
def web_merge(spark, d):
    """Local documents first, then the page with the passage's id; the first five of them are used."""
    local = bm25_hits(spark, d, 4).select("query_id", F.col("rank").alias("ord"), F.col("doc_id").cast("string").alias("document"))
    web = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.lit(100).alias("ord"), F.col("url").alias("document")).join(passages(spark, d).select("query_id"), "query_id", "left_semi")
    return ranking.top_k(local.unionByName(web), 5, [F.col("ord"), F.col("document")]).select("query_id", "rank", "document")


@query
def linear_answers(spark, d):
    out = adaptive.Pipeline(corpus(spark, d)).linear(passages(spark, d))
    return out.select("query_id", F.size("documents").alias("n_docs"), F.md5("answer").alias("answer_md5"))


# --------------------------------------------------------------------- sources
@query
def gt_match_three_tier(spark, d):
    """Passages' first words as questions, in changed case and with signs, matched back to their documents' ids."""
    b = table(spark, d, "benchmark")
    answers = b.select(F.concat(F.lit("q"), "item_id").alias("question_id"), F.substring("text", 1, 40).alias("question"), F.col("item_id").cast("string").alias("answer"))
    asked = b.select(F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("q"), "item_id")).otherwise(F.concat(F.lit("x"), "item_id")).alias("query_id"), F.when(F.col("item_id") % 3 == 1, F.translate(F.substring("text", 1, 40), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.concat(F.lit("- "), F.substring("text", 1, 40), F.lit("?!"))).alias("query"))
    return qa.with_answers(asked, answers)


@query
def resume_antijoin(spark, d):
    done = table(spark, d, "labels").select("doc_id")
    return sinks.undone(table(spark, d, "documents").select("doc_id", "lang"), done, "doc_id")


@query
def supporting_facts_recall(spark, d):
    """Of the documents that contain a passage, the share among its ten best."""
    g = qa.containing(corpus(spark, d), passages(spark, d)).groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))
    h = bm25_hits(spark, d, 10).groupBy("query_id").agg(F.collect_list("doc_id").alias("found"))
    none = F.array().cast("array<bigint>")
    out = passages(spark, d).select("query_id").join(g, "query_id", "left").join(h, "query_id", "left").withColumns({"gold": F.coalesce("gold", none), "found": F.coalesce("found", none)})
    return out.select("query_id", F.round(T.supporting_recall("gold", "found"), 6).alias("recall"), evaluation.grading_accurate("gold", "found").alias("accurate"))


# ------------------------------------------------------------------- telemetry
def spends(spark, d):
    tokens = F.col("value") * 100
    return table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("ord"), telemetry.spend(tokens, tokens / 10).alias("cost"))


@query
def breaker_anchored(spark, d):
    return telemetry.breaker(spends(spark, d), 50.0, 86_400.0)


@query
def rate_1m(spark, d):
    return telemetry.minute_rates(table(spark, d, "events"))


@query
def hist_quantile(spark, d):
    e = table(spark, d, "events")
    return telemetry.histogram_quantile(e, F.col("value") / 10, 0.95, telemetry.QUERY_BUCKETS, "event_type")


@query
def hist_buckets(spark, d):
    return telemetry.bucket_counts(table(spark, d, "events"), F.col("value") / 10, telemetry.QUERY_BUCKETS, "event_type")


@query
def gauge_latest(spark, d):
    return telemetry.latest(table(spark, d, "events"), "value", "event_type")


@query
def semantic_cache_ttl(spark, d):
    """Vectors written a minute apart, by id; each looks for an earlier one within two hours at a cosine of 0.5."""
    at = F.timestamp_micros(F.col("doc_id") * 60_000_000)
    v = vectors(spark, d).select("doc_id", at.alias("ts"), "embedding")
    return telemetry.cache_lookups(v.withColumnRenamed("doc_id", "lookup_id"), v.withColumnRenamed("doc_id", "entry_id"), 0.5, 7200)


@query
def stream_window_counts(spark, d):
    """Daily counts from a stream with a watermark, drained; the open last windows aren't out yet in append mode, so complete mode."""
    e = live.event_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    return live.drain(live.window_counts(e, "1 day"), "window-counts", "complete").select("start", "event_type", "n", F.round("total", 4).alias("total"))


def out_of_order(spark, df, name, slices=4):
    """A stream of df (with ts) by files of a slice of its time each, every two neighbours changed, and how late a row can be.  A last file's row has a time only: it closes what is open."""
    path, (lo, hi) = fresh_path(spark, name), df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = ((hi or 0) - (lo or 0)) // slices + 1
    own = F.least(F.lit(slices - 1), F.floor((F.unix_micros("ts") - (lo or 0)) / width))
    for n in range(slices):
        df.where(own == (n ^ 1 if n ^ 1 < slices else n)).write.parquet(f"{path}/{n:03d}")
    end = spark.range(1).select(F.timestamp_micros(F.lit((hi or 0) + 4 * width + 1)).alias("ts"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != "ts"])
    end.select(df.columns).write.parquet(f"{path}/{slices:03d}")
    files = max(4, df.rdd.getNumPartitions())  # a slice has that many at most: triggers don't grow with the table
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    return stream, f"{2 * width // 1_000_000 + 1} seconds"


@query
def stream_breaker(spark, d):
    """Files out of order over several triggers; the buffers put a key's spends in order."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tokens = F.col("value") * 100
    stream, late = out_of_order(spark, e.select("user_id", "ts", F.col("event_id").alias("ord"), telemetry.spend(tokens, tokens / 10).alias("cost")), "spends")
    with stateful.rocks(spark):
        return live.drain(stateful.breaker(stream, 50.0, 86_400.0, late), "breaker")


@query
def stream_cache(spark, d):
    """semantic_cache_ttl as a stream, a day later: the first watermark is time 0, and what isn't after it is late."""
    v = vectors(spark, d).select(F.col("doc_id").alias("id"), F.timestamp_micros((F.col("doc_id") + 1440) * 60_000_000).alias("ts"), "embedding")
    stream, late = out_of_order(spark, v, "requests")
    with stateful.rocks(spark):
        return live.drain(stateful.cache_lookups(stream, 64, 0.5, 7200, late), "cache")
