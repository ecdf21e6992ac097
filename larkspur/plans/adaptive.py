"""Linear and adaptive answering as plans over a table of queries.

Every conditional edge is a predicate on the state's columns: the rows that
take a branch go through it, the others pass by, and both come together again.
The retry loop is bounded and goes over the rows that are left, until there are
none.  The state is checkpointed before each split, so retrieval isn't computed
once a branch and plans stay small.

Model calls are providers: functions of Columns.  The defaults are
deterministic stand-ins for models, not equals of them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, ranking, sparse, telemetry
from ..sources.shared import shared_dir

Hits = Callable[[DataFrame, int, int], DataFrame]
DOC = "struct<doc_id:bigint,content:string,score:double,rerank_score:double,source:string>"

#: The prompts' texts.
PROMPT = """Answer the question using ONLY the provided context. Be direct and concise (1-3 sentences maximum).

DO NOT:
- Repeat the question
- Say "Based on the context" or similar phrases
- Continue after answering

Context:
{context}

Question: {question}

Direct answer:"""
RETRY_PROMPT = """The previous answer was not satisfactory. Using ONLY the provided context, give a precise and factual answer.

Rules:
- Quote specific facts from the context
- If the context doesn't clearly answer the question, say so
- Be concise (1-2 sentences)

Context:
{context}

Question: {question}

Precise answer:"""


def overlap_grader(least: float = 0.1) -> Callable[[Column, Column], Column]:
    """Grades documents by the share of the query's distinct words that they have."""

    def grade(query: Column, contents: Column) -> Column:
        q = F.array_distinct(T.tokens(query))
        return F.transform(contents, lambda c: F.size(F.array_intersect(q, T.tokens(c))) / F.greatest(F.size(q), F.lit(1)) >= least)

    return grade


def grounded_answer(least: float = 0.5) -> Callable[[Column, Column, Column], Column]:
    """Accepts non-empty answers whose long words the documents have."""
    return lambda query, answer, contents: (T.strip(F.coalesce(answer, F.lit(""))) != "") & (T.word_overlap(answer, contents) >= least)


def first_sentence(query: Column, prompt: Column, contents: Column, attempt: int) -> Column:
    """Answers with the first sentence of the document at the attempt's place."""
    return F.coalesce(F.get(T.sentences(F.get(contents, F.lit(attempt))), F.lit(0)), F.lit(""))


def no_rewrite(query: Column, total: Column, relevant: Column) -> Column:
    return query


@dataclass
class Providers:
    scorer: ranking.Scorer = ranking.lexical_scorer
    generate: Callable[[Column, Column, Column, int], Column] = first_sentence
    grade_documents: Callable[[Column, Column], Column] = field(default_factory=overlap_grader)
    grade_answer: Callable[[Column, Column, Column], Column] = field(default_factory=grounded_answer)
    rewrite: Callable[[Column, Column, Column], Column] | None = None
    web: Callable[[DataFrame], DataFrame] | None = None  # queries to (query_id, web array of DOC); failures are empty arrays


@dataclass
class Settings:
    k_retrieve: int = 20
    k_rerank: int = 5
    k_retriever: int = 50
    retrieval_threshold: float = 0.0
    fallback_factor: int = 2
    fallback_k_retriever: int = 100
    grade_documents: bool = False
    min_relevant: int = 2
    web_threshold: float | None = None
    grade_answers: bool = False
    max_retries: int = 2
    rerank_threshold: float | None = None
    max_chunks: int = 5


def hybrid(corpus: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> Hits:
    """A retriever: BM25 alone, or fused with dense search where vectors are given."""

    def search(queries: DataFrame, k: int, k_retriever: int) -> DataFrame:
        low = sparse.search(corpus, queries, k_retriever)
        if vectors is None:
            return low.where(F.col("rank") <= k)
        high = dense.search(vectors, query_vectors.join(queries.select("query_id"), "query_id", "left_semi"), k_retriever)
        return ranking.rrf(high, low, k, weights).select("query_id", "rank", "doc_id", F.col("rrf_score").alias("score"))

    return search


def cut(df: DataFrame) -> DataFrame:
    """df worked out once, as a reliable checkpoint in the folder all executors share; the plan of what follows starts here."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Pipeline:
    def __init__(self, corpus: DataFrame, retriever: Hits | None = None, settings: Settings | None = None, providers: Providers | None = None) -> None:
        self.corpus, self.settings, self.providers = corpus.select("doc_id", "content"), settings or Settings(), providers or Providers()
        self.retriever = retriever or hybrid(self.corpus)

    # ------------------------------------------------------------ retrieval
    def search(self, queries: DataFrame, k: int | None = None, k_retriever: int | None = None, reranked: bool = True) -> DataFrame:
        """The final hits of each query."""
        s = self.settings
        hits = self.retriever(queries, k or s.k_retrieve, k_retriever or s.k_retriever)
        if not reranked:
            return hits.where(F.col("rank") <= s.k_rerank)
        return ranking.rerank(hits, queries, self.corpus, s.k_rerank, self.providers.scorer, most_hits=k or s.k_retrieve)

    def documents(self, queries: DataFrame, k: int, k_retriever: int) -> DataFrame:
        """query_id, documents in rank order and the least rerank score (0 without any)."""
        hits = self.search(queries, k, k_retriever).join(self.corpus, "doc_id")
        doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "content", F.col("score").cast("double").alias("score"), F.col("rerank_score").cast("double").alias("rerank_score"), F.lit(None).cast("string").alias("source"))
        found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", doc.alias("d")))), lambda x: x["d"]).alias("documents"), F.min("rerank_score").alias("low"))
        return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("documents", F.array().cast(f"array<{DOC}>")).alias("documents"), F.coalesce("low", F.lit(0.0)).alias("min_rerank_score"))

    def prompt(self, retry: bool = False) -> Column:
        context = T.context_block(contents(), self.settings.max_chunks)
        return T.fill_template(RETRY_PROMPT if retry else PROMPT, context=context, question=F.col("query"))

    def linear(self, queries: DataFrame) -> DataFrame:
        """query_id, query, documents, prompt and answer."""
        s = self.settings
        state = cut(queries.select("query_id", "query").join(self.documents(queries, s.k_retrieve, s.k_retriever), "query_id").withColumn("prompt", self.prompt()))
        return state.withColumn("answer", T.clean_answer(self.providers.generate(F.col("query"), F.col("prompt"), contents(), 0)))

    def timed(self, queries: DataFrame) -> DataFrame:
        """linear() with retrieval_ms, rerank_ms and generation_ms (a stage's time over all queries, shared among them), total_ms, tokens and cost.

        Stages run for all queries at once, each to a table, so a query has no latency of its own.
        """
        s, p = self.settings, self.providers
        took: dict[str, float] = {}
        n = max(queries.count(), 1)

        def stage(name: str, df: DataFrame) -> DataFrame:
            began = time.perf_counter()
            out = cut(df)
            took[name] = (time.perf_counter() - began) * 1000 / n
            return out

        hits = stage("retrieval_ms", self.retriever(queries, s.k_retrieve, s.k_retriever))
        hits = stage("rerank_ms", ranking.rerank(hits, queries, self.corpus, s.k_rerank, p.scorer, most_hits=s.k_retrieve).join(self.corpus, "doc_id"))
        doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "content")
        found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", doc.alias("d")))), lambda x: x["d"]).alias("documents"))
        state = queries.select("query_id", "query").join(found, "query_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<struct<doc_id:bigint,content:string>>")))
        out = stage("generation_ms", state.withColumn("prompt", self.prompt()).withColumn("answer", T.clean_answer(p.generate(F.col("query"), F.col("prompt"), contents(), 0))))
        spent = telemetry.spend(F.col("input_tokens"), F.col("output_tokens"))
        out = out.withColumns({**{k: F.lit(round(v, 3)) for k, v in took.items()}, "total_ms": F.lit(round(sum(took.values()), 3)), "input_tokens": T.token_estimate("prompt"), "output_tokens": T.token_estimate("answer")})
        return out.withColumn("cost", F.round(spent, 9))

    # ------------------------------------------------------- adaptive nodes
    def start(self, queries: DataFrame) -> DataFrame:
        s = self.settings
        state = queries.select("query_id", "query").join(self.documents(queries, s.k_retrieve, s.k_retriever), "query_id")
        step = F.format_string("Retrieved %d docs (min_rerank=%.2f)", F.size("documents"), F.col("min_rerank_score"))
        return state.withColumns({"generation": F.lit(""), "retry_count": F.lit(0), "used_fallback_retrieval": F.lit(False), "used_web_search": F.lit(False), "answer_is_acceptable": F.lit(False), "num_docs_graded": F.lit(-1), "intermediate_steps": F.array(step)})

    def fallback(self, state: DataFrame) -> DataFrame:
        """Queries whose least rerank score is under the threshold are retrieved anew, more widely."""
        s = self.settings
        k = s.k_retrieve * s.fallback_factor
        state = cut(state)
        good = F.col("min_rerank_score") >= s.retrieval_threshold
        poor = state.where(~good)
        if poor.isEmpty():
            return state
        again = poor.drop("documents", "min_rerank_score").join(self.documents(poor.select("query_id", "query"), k, s.fallback_k_retriever), "query_id")
        step = F.format_string(f"Fallback retrieved %d docs (k={k}, min_rerank=%.2f)", F.size("documents"), F.col("min_rerank_score"))
        again = again.withColumns({"used_fallback_retrieval": F.lit(True), "intermediate_steps": F.concat("intermediate_steps", F.array(step))})
        return state.where(good).unionByName(again)

    def grade(self, state: DataFrame) -> DataFrame:
        """Keeps relevant documents; with too few and a rewriter, retrieves for the rewritten query.  The query and the score stay."""
        s, p = self.settings, self.providers
        docs = F.col("documents")

        def kept(query: Column) -> Column:
            g = p.grade_documents(query, contents())
            return F.filter(docs, lambda d, i: F.get(g, i))

        state = state.withColumns({"_all": docs, "_kept": kept(F.col("query"))})
        if p.rewrite is not None:
            state = cut(state)
            few = (F.size("_kept") < s.min_relevant) & (F.size("documents") > 0)
            redo = state.where(few).withColumn("_asked", F.col("query")).withColumn("query", p.rewrite(F.col("query"), F.size("documents"), F.size("_kept")))
            fresh = redo.drop("documents").join(self.documents(redo.select("query_id", "query"), s.k_retrieve, s.k_retriever).drop("min_rerank_score"), "query_id")
            second = kept(F.col("query"))
            fresh = fresh.withColumn("_kept", F.when(F.size(second) > 0, second).when(F.size("documents") > 0, docs).otherwise(F.col("_kept")))
            state = state.where(~few).unionByName(fresh.withColumn("query", F.col("_asked")).drop("_asked"))
        step = F.when(F.size("_all") == 0, F.lit("Doc grading: no documents to grade")).otherwise(F.format_string("Doc grading: %d/%d relevant", F.size("_kept"), F.size("_all")))
        return state.withColumns({"documents": F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_all")), "num_docs_graded": F.size("_kept"), "intermediate_steps": F.concat("intermediate_steps", F.array(step))}).drop("_all", "_kept")

    def web(self, state: DataFrame) -> DataFrame:
        """Appends web documents, after the local ones, where the score is under the web threshold."""
        s = self.settings
        low = F.col("min_rerank_score") < s.web_threshold
        found = self.providers.web(state.where(low).select("query_id", "query")).select("query_id", F.col("web").cast(f"array<{DOC}>").alias("_web"))
        state = state.join(found, "query_id", "left").withColumn("_web", F.coalesce("_web", F.array().cast(f"array<{DOC}>")))
        step = F.format_string("Web search: %d results", F.size("_web"))
        return state.withColumns({"documents": F.concat("documents", "_web"), "used_web_search": low, "intermediate_steps": F.when(low, F.concat("intermediate_steps", F.array(step))).otherwise(F.col("intermediate_steps"))}).drop("_web")

    def generate(self, state: DataFrame, attempt: int) -> DataFrame:
        prompt = self.prompt(attempt > 0)
        answer = T.clean_answer(self.providers.generate(F.col("query"), prompt, F.slice(contents(), 1, self.settings.max_chunks), attempt))
        return state.withColumns({"generation": answer, "intermediate_steps": F.concat("intermediate_steps", F.array(F.lit(f"Generated answer (attempt {attempt + 1})")))})

    def judge(self, state: DataFrame) -> DataFrame:
        ok = self.providers.grade_answer(F.col("query"), F.col("generation"), contents())
        return state.withColumn("answer_is_acceptable", ok).withColumns({"retry_count": F.col("retry_count") + (~F.col("answer_is_acceptable")).cast("int"), "intermediate_steps": F.concat("intermediate_steps", F.array(F.when(F.col("answer_is_acceptable"), "Answer accepted").otherwise("Answer rejected")))})

    def adaptive(self, queries: DataFrame) -> DataFrame:
        """The final state of each query; at most max_retries + 1 generations."""
        s = self.settings
        state = cut(self.fallback(self.start(queries)))
        if s.grade_documents:
            state = cut(self.grade(state))
        if s.web_threshold is not None and self.providers.web is not None:
            state = self.web(state)
        if not s.grade_answers:
            return self.generate(state, 0)
        done: DataFrame | None = None
        for attempt in range(s.max_retries + 1):
            state = cut(self.judge(cut(self.generate(state, attempt))))
            accepted = F.col("answer_is_acceptable") | (F.col("retry_count") > s.max_retries)
            if s.rerank_threshold is not None:
                accepted = accepted | (F.col("min_rerank_score") < s.rerank_threshold)
            if attempt == s.max_retries:
                return state if done is None else done.unionByName(state)
            done = state.where(accepted) if done is None else done.unionByName(state.where(accepted))
            state = state.where(~accepted)
            if state.isEmpty():  # from the checkpoint: no attempt is planned for nobody
                return done
        return done


def contents() -> Column:
    return F.transform("documents", lambda d: d["content"])
