"""BM25 scored where a document is.

Document frequencies and lengths need one pass and one shuffle of partial
counts by term, written as a table.  After that a document is one row and its
score needs nothing else: the queries' terms and weights go to the executors in
blocks of a checked size, every Arrow batch of tokenised documents is scored
against a block and sends on its own best k a query.  So the shuffle has k rows
a query and batch, not a row for every document that shares a word with a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .ranking import top_k

#: Query terms and queries broadcast at once; more go in further blocks.  Documents scored at once: a task holds a number for each of them and each query.
BLOCK_TERMS, BLOCK_QUERIES = 500_000, 4096
BATCH = 1024


@dataclass(frozen=True)
class Okapi:
    k1: float = 1.2
    b: float = 0.75
    epsilon: float = 0.25


SMALL = 64


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its source gives fewer tasks than there are cores, and SMALL at most: a table of one or a few files.  Others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SMALL) else df


def tokenised(corpus: DataFrame) -> DataFrame:
    """doc_id, its tokens and their number."""
    return corpus.select("doc_id", T.tokens(F.coalesce("content", F.lit(""))).alias("toks")).withColumn("dl", F.size("toks"))


def index_stats(corpus: DataFrame) -> DataFrame:
    """One row: documents, vocabulary size and mean length."""
    toks = tokenised(corpus)
    terms = toks.select(F.explode("toks").alias("term")).groupBy("term").count().agg(F.count("*").alias("vocabulary"))
    return toks.agg(F.count("*").alias("n_docs"), F.round(F.avg("dl"), 6).alias("avg_length")).crossJoin(terms)


def _counted(corpus: DataFrame) -> DataFrame:
    """(term, df, total) in one pass over the corpus; the row of the null term has the number of documents and their total length."""
    each = F.transform(F.array_distinct("toks"), lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("n")))
    length = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("dl").cast("long").alias("n")))
    rows = tokenised(corpus).select(F.explode(F.concat(each, length)).alias("e"))
    return written(rows.groupBy(F.col("e.term").alias("term")).agg(F.count("*").alias("df"), F.sum("e.n").alias("total")), "terms")


def _weighted(counted: DataFrame, okapi: Okapi) -> tuple[DataFrame, float]:
    """(term, df, idf) of a counted corpus, and its mean length."""
    n, total = counted.where("term is null").select("df", "total").first() or (0, 0)
    raw = counted.where("term is not null").select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, okapi.epsilon * mean).otherwise(F.col("raw"))
    return raw.select("term", "df", idf.alias("idf")), total / n if total else 1.0


def inverse_frequencies(corpus: DataFrame, okapi: Okapi = Okapi()) -> DataFrame:
    """(term, df, idf): ln(N - df + 0.5) - ln(df + 0.5); where negative, epsilon times the mean over all terms."""
    return _weighted(_counted(corpus), okapi)[0]


def query_terms(idf: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, term, g): how often a query has a term of idf (term, df, idf), times its idf."""
    terms = queries.select("query_id", F.explode(T.tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return terms.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("g"))


def _block(corpus: DataFrame, rows: pa.Table, k: int, okapi: Okapi, average: float) -> tuple[DataFrame, Broadcast]:
    """(query_id, doc_id, score): each batch's best k for the queries of a block; and what was sent to the tasks for it."""
    queries, query_at = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
    term_at = rows.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(term_at.indices.to_numpy(), kind="stable")
    bounds = np.searchsorted(term_at.indices.to_numpy()[order], np.arange(len(term_at.dictionary) + 1))
    shared = corpus.sparkSession.sparkContext.broadcast((queries, term_at.dictionary.to_pylist(), query_at[order], rows.column("g").to_numpy()[order], bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, terms, query_at, g, bounds = shared.value
        vocabulary = pa.array(terms, pa.string())
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                b = whole.slice(a, BATCH)
                toks, doc = b.column("toks"), b.column("doc_id").to_numpy()
                size = toks.value_lengths().to_numpy()
                term = pc.index_in(toks.flatten(), vocabulary)
                here = pc.is_valid(term).to_numpy(zero_copy_only=False)
                place = np.repeat(np.arange(len(doc)), size)[here]
                pair, tf = np.unique(term.drop_null().to_numpy().astype(np.int64) * len(doc) + place, return_counts=True)
                term, place = np.divmod(pair, len(doc))
                w = tf * (okapi.k1 + 1) / (tf + okapi.k1 * (1 - okapi.b + okapi.b * size[place] / average))
                score, hit = np.zeros((len(queries), len(doc))), np.zeros((len(queries), len(doc)), dtype=bool)
                cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else []
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    t = term[i]
                    at = np.ix_(query_at[bounds[t] : bounds[t + 1]], place[i:j])  # a query has a term once
                    score[at] += g[bounds[t] : bounds[t + 1], None] * w[i:j]
                    hit[at] = True
                q, d = np.nonzero(hit)
                order = np.lexsort((doc[d], -np.round(score[q, d], 9), q))
                q, d = q[order], d[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, d = q[best], d[best]
                yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(doc[d]), pa.array(score[q, d])], names=["query_id", "doc_id", "score"])

    toks = tokenised(corpus).select(F.col("doc_id").cast("long").alias("doc_id"), "toks")
    return toks.mapInArrow(run, "query_id long, doc_id long, score double"), shared


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, okapi: Okapi = Okapi(), fill: bool = False) -> DataFrame:
    """The k best documents for each query (ids are whole numbers).  fill: queries that match fewer get documents of score 0, by id, up to k.

    The queries are a stated set: their terms pass through the driver a block at a time, and where there are several a block's result
    is written before the next is taken.
    """
    corpus = spread(corpus.select("doc_id", "content"))
    idf, average = _weighted(_counted(corpus), okapi)
    terms = query_terms(idf, queries).withColumn("query_id", F.col("query_id").cast("long"))
    n_terms, n_queries = queries.agg(F.sum(F.size(T.tokens("query"))), F.count_distinct("query_id")).first()
    blocks = max(-(-(n_terms or 0) // BLOCK_TERMS), -(-n_queries // BLOCK_QUERIES)) if n_terms else 0
    found = corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    for i in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if len(rows):
            part, shared = _block(corpus, rows, k, okapi, average)
            if blocks == 1:
                found = part
            else:
                found = found.unionByName(written(top_k(part, k).drop("rank"), "block-hits"))
                shared.destroy()
    if fill:
        found = top_k(found, k).drop("rank")
        spare = F.broadcast(corpus.select("doc_id").distinct().orderBy("doc_id").limit(2 * k))  # enough: fewer than k of them match
        short = queries.select("query_id").distinct().join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
        more = short.crossJoin(spare).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
        found = found.unionByName(more)
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")
