"""Exact nearest neighbours and encoding.

Queries are sent to the executors in blocks of a bounded size, one after the
other, each block's result written before the next is taken; STEP rows of the
corpus at a time are scored against a block by one matrix product.  A task holds
the best k rows a query that it has seen, so that of a score there is nothing to
do but to compare it with the least of them, and the shuffle has k rows a query
and task whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..sources.shared import written
from .ranking import top_k

QUERY_BLOCK, STEP = 4096, 1024


class Best:
    """The best k documents of each of n queries so far: greatest key first, then least id; a value goes with each."""

    def __init__(self, n: int, k: int):
        self.k, self.seen, self.pending, self.waiting = k, np.zeros(n, np.int64), [], 0
        self.key, self.doc, self.value = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k))

    def add(self, rows: np.ndarray, s: np.ndarray, doc: np.ndarray, keyed=None, value: float | None = None, nan: float = np.inf) -> None:
        """Scores s (rows, which are distinct queries, by doc).  keyed: makes keys of scores, none further from its score than rounding to 9 places takes it; value: of all, else the score; nan: where NaN is sorted, which to Spark is above all numbers."""
        if not s.size:
            return
        self.seen[rows] += s.shape[1]
        raw = s
        if not np.isfinite(s.sum()):
            s = np.where(np.isnan(s), nan, s)
        least = self.key[rows, -1]
        low = least
        if s.shape[1] > self.k and (new := np.flatnonzero(np.isneginf(least))).size:  # rows without k documents yet: the k-th best here is a bound as well
            low = least.copy()
            low[new] = np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        finite = np.where(np.isfinite(low), low, 0.0)
        r, c = np.nonzero(s >= (low - (2e-9 + 1e-15 * np.abs(finite)))[:, None])
        score, d = s[r, c], doc[c]
        key = keyed(score) if keyed else score
        at = rows[r]
        keep = (key > least[r]) | ((key == least[r]) & (d < self.doc[at, -1]))
        self.pending.append((at[keep], key[keep], d[keep], raw[r, c][keep] if value is None else np.full(int(keep.sum()), value)))
        self.waiting += int(keep.sum())
        if self.waiting > max(self.key.size, 1 << 16):
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        at, key, doc, value = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending, self.waiting = [], 0
        own, place = np.unique(at, return_inverse=True)
        held = np.repeat(np.arange(len(own)), self.k)
        place, key, doc, value = (np.concatenate(x) for x in ((place, held), (key, self.key[own].ravel()), (doc, self.doc[own].ravel()), (value, self.value[own].ravel())))
        order = np.lexsort((doc, -key, place))
        best = order[np.searchsorted(place[order], np.arange(len(own)))[:, None] + np.arange(self.k)]
        self.key[own], self.doc[own], self.value[own] = key[best], doc[best], value[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, document, key and value of all that is held."""
        self._merge()
        query, at = np.nonzero(np.arange(self.k)[None] < self.seen[:, None])
        return query, self.doc[query, at], self.key[query, at], self.value[query, at]


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, doc_id, score): inner product, best first, or squared distance ("euclidean"), least first.

    corpus (doc_id, embedding), queries (query_id, embedding).  Rows whose
    embedding is null are left out; another length than the queries' is an error.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric: {metric}")
    first = F.round("score", 9)
    order = [first.asc() if metric == "euclidean" else first.desc(), F.col("doc_id")]
    blocks = -(-queries.count() // QUERY_BLOCK)
    out = queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    for i in range(blocks):
        part, shared = _block(corpus, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries, k, metric)
        if blocks == 1:
            out = part
        else:
            out = out.unionByName(written(top_k(part, k, order).drop("rank"), "block-hits"))
            shared.destroy()
    return top_k(out, k, order).select("query_id", "rank", "doc_id", "score")


def _block(corpus: DataFrame, queries: DataFrame, k: int, metric: str) -> tuple[DataFrame, Broadcast]:
    rows = queries.where("embedding is not null").select("query_id", "embedding").collect()  # a block at most
    ids = np.array([r.query_id for r in rows], dtype=np.int64)
    q = np.array([r.embedding for r in rows], dtype=np.float64)
    shared = corpus.sparkSession.sparkContext.broadcast((ids, q))
    sign = -1.0 if metric == "euclidean" else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best, every = Best(len(ids), k), np.arange(len(ids))
        for b in (whole.slice(a, STEP) for whole in batches for a in range(0, whole.num_rows if len(ids) else 0, STEP)):
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(b.num_rows, -1)
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"embeddings have {x.shape[1]} dimensions, queries {q.shape[1]}")
            s = q @ x.T
            if metric == "euclidean":
                s = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * s
            best.add(every, sign * s, b.column("doc_id").to_numpy(), lambda v: np.round(v, 9), nan=sign * np.inf)
        query, doc, _, score = best.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(sign * score)], names=["query_id", "doc_id", "score"])

    rows = corpus.where("embedding is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "embedding")
    return rows.mapInArrow(run, "query_id long, doc_id long, score double"), shared


# ------------------------------------------------------------ inverted lists
def _unit_sample(corpus: DataFrame, sample: int, seed: int) -> np.ndarray:
    rows = corpus.where("embedding is not null").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").select("embedding").limit(sample).toArrow()
    x = np.array(rows.column("embedding").to_pylist(), dtype=np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def ivf_probes(corpus: DataFrame, centres: np.ndarray, k: int = 10, recall: float = 0.95, sample: int = 10_000, asked: int = 200, seed: int = 11) -> int:
    """The fewest cells to search for `recall` of the k nearest, as measured among at most `sample` rows for `asked` of them."""
    x = _unit_sample(corpus, sample, seed)
    q = x[:asked]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], 1)
    needed = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(axis=1)[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def ivf_centroids(corpus: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of `lists` cells of unit vectors, by spherical k-means on at most `sample` rows (chosen by hash)."""
    x = _unit_sample(corpus, sample, seed)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                m = x[own == i].mean(axis=0)
                centres[i] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def ivf_index(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row of corpus (doc_id, embedding) with the cell it is nearest to; written by cell, a search reads its cells only."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("embedding"), pa.array((x @ shared.value.T).argmax(axis=1).astype(np.int32))], names=["doc_id", "embedding", "cell"])

    rows = corpus.where("embedding is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "doc_id long, embedding array<float>, cell int")


def ivf_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(query_id, rank, doc_id, score) by inner product among the `probes` cells nearest to each query: approximate."""
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for i in range(blocks):
        rows = queries.where("embedding is not null").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "embedding").collect()  # a block at most
        q = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), -1)
        cells = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes] if len(rows) else np.zeros((0, probes), int)
        shared = index.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows], dtype=np.int64), q, cells))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, cells = shared.value
            best = Best(len(ids), k)
            for b in (whole.slice(a, STEP) for whole in batches for a in range(0, whole.num_rows if len(ids) else 0, STEP)):
                x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                doc, cell = b.column("doc_id").to_numpy(), b.column("cell").to_numpy()
                for c in np.unique(cell):
                    at, asks = np.flatnonzero(cell == c), np.flatnonzero((cells == c).any(axis=1))
                    if len(asks):
                        best.add(asks, q[asks] @ x[at].T, doc[at], lambda v: np.round(v, 9))
            query, doc, _, score = best.rows()
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

        wanted = sorted({int(c) for c in cells.ravel()})
        part = index.where(F.col("cell").isin(wanted)).select("doc_id", "embedding", "cell").mapInArrow(run, "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")


def index_stats(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("total"), F.max(F.size("embedding")).alias("dimension"))


def add(index: DataFrame, more: DataFrame, dimension: int) -> DataFrame:
    """index and more rows, whose embeddings must have the index's dimension; stored as 32-bit floats."""
    checked = more.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit("wrong dimension")).cast("array<float>")))
    return index.unionByName(checked, allowMissingColumns=True)


def prefixed(query: Column | str, instruction: str) -> Column:
    return F.concat_ws(" ", F.lit(instruction), T.col(query))


Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(dimension: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed hashes of words, summed."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h & 0x80000000 else -1
        return out

    return encode


def encoded(df: DataFrame, text: str, encoder: Encoder | None = None, batch: int = 32, out: str = "embedding") -> DataFrame:
    """df with the L2-normalised vectors of a text column; the encoder, a small one that goes with the task, sees `batch` texts at a time."""
    make = encoder or hashed_encoder()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = []
            for a in range(0, len(part), batch):
                v = np.asarray(make(part.iloc[a : a + batch].fillna("").tolist()), dtype=np.float32)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                rows += list(v / np.where(norm == 0, 1, norm))
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # names in this function's scope aren't resolved from strings
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def encoded_by(df: DataFrame, text: str, name: str, factory: Callable[[], Encoder], pace: models.Pace = models.Pace(), out: str = "embedding", error: str = "error") -> DataFrame:
    """encoded() by a model that each worker makes for itself, called by token budget; rows it fails on have a null vector and the error."""

    def unit() -> models.Model:
        encode = factory()

        def run(texts: list[str]) -> list[list[float]]:
            v = np.asarray(encode(texts), dtype=np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return (v / np.where(norm == 0, 1, norm)).tolist()

        return run

    return models.modelled(df, text, name, unit, "array<float>", out, error, pace)
