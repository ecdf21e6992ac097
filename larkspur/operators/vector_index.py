"""Stored inverted lists with residual product quantisation.

Centres of cells and codebooks are trained on at most `sample` rows, and on no
more than half of all; every row is stored in the folder of the cell that it is
nearest to, with its residual from the centre as one byte a subspace and its
exact vector beside it in another column.  Large cells have several files.

A search takes the queries in blocks of neighbours: sorted along the cells'
order, a block is closed before its cells pass a share of all.  The scan of a
block names its cells, so other folders aren't opened, and reads the codes only;
codes are scored by a matrix product of the queries and the vectors they stand
for, and a task sends its best ones of each query.
Each query's best codes (`refine` times k) are then scored again by their exact
vectors, which are read from the cells that hold any.  Where these would be more
than one row in FEW, as codes tell little, the exact vectors of the cells are
scored at once: that finds all that the codes would have, and a query's share of
the rows is then not shuffled.  How many cells a query needs, and how many
codes, is measured when the index is built, by exact search over all rows for
rows that the training didn't see, and which don't count as their own
neighbours.  Vectors without any structure need nearly all cells, and then there
is nothing to gain from small blocks: all queries are one.

The result is approximate; `dense.search` stays the exact default.  Rows with a
null vector are left out; another number of dimensions is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import hadoop_path, written
from . import dense
from .ranking import top_k

SUBSPACES = 8
FILE_ROWS = 1_000_000
QUERY_BLOCK = 4096
#: Numbers that a task holds at once while it scores codes.
SCORES = 1 << 22
#: Codes that a task holds for its queries at most.
HELD = 1 << 20
#: To send a code on and score it again takes as long as to score some hundred vectors in a product.
FEW = 256
MODEL = "name string, shape array<int>, data binary"
HITS = "query_id long, doc_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """Centres of k clusters of the rows of x; `unit` keeps them on the sphere."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        gap = (centres**2).sum(axis=1)[None] - 2 * x @ centres.T
        own = gap.argmin(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = x[own == i].mean(axis=0)
                if unit:
                    centres[i] /= max(np.linalg.norm(centres[i]), 1e-12)
    return centres


def chained(centres: np.ndarray) -> np.ndarray:
    """Centres in an order in which each is followed by the nearest one left."""
    left, order = set(range(1, len(centres))), [0]
    while left:
        rest = np.array(sorted(left))
        order.append(int(rest[(centres[rest] @ centres[order[-1]]).argmax()]))
        left.discard(order[-1])
    return centres[order]


def _rows(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(x) != len(column) * size:
        raise ValueError(f"a vector has another number of dimensions than {size}")
    return x.reshape(len(column), size)


@dataclass(frozen=True)
class Model:
    """Centres (cells x dimensions) and codebooks (subspaces x codes x dimensions of a subspace)."""

    centres: np.ndarray
    books: np.ndarray
    probes: int = 1
    refine: int = 10

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The nearest code of each subspace of the residuals, rows x subspaces."""
        left = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        out = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            out[:, m] = ((book**2).sum(axis=1)[None] - 2 * left[:, m] @ book.T).argmin(axis=1)
        return out

    def decoded(self, codes: np.ndarray, cell: int) -> np.ndarray:
        """The vectors that codes of a cell stand for."""
        return self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1) + self.centres[cell]

    def nearest_cells(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]


def trained(corpus: DataFrame, cells: int, sample: int, seed: int) -> Model:
    """A model of at most `sample` rows, chosen by hash."""
    n = corpus.where("embedding is not null").count()
    rows = _by_hash(corpus, seed).limit(max(1, min(sample, n // 2))).toArrow()
    x = np.array(rows.column("embedding").to_pylist(), dtype=np.float64)
    if not len(x):
        raise ValueError("no vectors to build an index of")
    size, rng = x.shape[1], np.random.default_rng(seed)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = chained(kmeans(unit, min(cells, len(x)), 10, rng, unit=True))
    parts = max(m for m in range(1, SUBSPACES + 1) if size % m == 0)
    left = (x - centres[(x @ centres.T).argmax(axis=1)]).reshape(len(x), parts, -1)
    k = min(256, max(1, len(x) // 4))
    return Model(centres, np.stack([kmeans(left[:, m], k, 8, rng) for m in range(parts)]))


def _by_hash(corpus: DataFrame, seed: int) -> DataFrame:
    return corpus.where("embedding is not null").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    model: Model

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        p, fs = hadoop_path(spark, f"{path}/model/_SUCCESS")
        if not fs.exists(p):
            raise ValueError(f"no index at {path}: build one first")
        stored = {r.name: np.frombuffer(r.data, "<f8").reshape(r.shape) for r in spark.read.schema(MODEL).parquet(f"{path}/model").collect()}
        return cls(spark, path, Model(stored["centres"], stored["books"], int(stored["probes"][0]), int(stored["refine"][0])))

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cells: int = 64, sample: int = 20_000, recall: float = 0.98, k: int = 10, asked: int = 200, seed: int = 7) -> VectorIndex:
        """An index of corpus (doc_id, embedding).  recall: of the k nearest, the share that lies in the cells searched."""
        corpus = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding")
        index = cls(corpus.sparkSession, path, trained(corpus, cells, sample, seed))
        index._write(corpus, "overwrite")
        index = index._calibrated(corpus, recall, k, asked, sample, seed)
        parts = {"centres": index.model.centres, "books": index.model.books, "probes": np.array([float(index.model.probes)]), "refine": np.array([float(index.model.refine)])}
        rows = [(name, list(x.shape), x.astype("<f8").tobytes()) for name, x in parts.items()]
        index.spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")  # the index is there when this is
        return index

    def add(self, more: DataFrame) -> VectorIndex:
        """More rows, in the same cells."""
        self._write(more.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding"), "append")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, code binary, embedding array<float>, cell int").parquet(f"{self.path}/rows")

    def _write(self, corpus: DataFrame, mode: str) -> None:
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _rows(b.column("embedding"), model.dimension)
                    cell = model.cells(x)
                    codes = pa.array([c.tobytes() for c in model.codes(x, cell)], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), codes, b.column("embedding"), pa.array(cell.astype(np.int32))], names=["doc_id", "code", "embedding", "cell"])

        rows = corpus.where("embedding is not null").select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"))
        coded = written(rows.mapInArrow(run, "doc_id long, code binary, embedding array<float>, cell int"), "coded")
        sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))  # a row a cell
        salted = coded.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("files"))).repartition("cell", "salt").sortWithinPartitions("cell")
        salted.select("doc_id", "code", "embedding", "cell").write.partitionBy("cell").option("compression", "zstd").mode(mode).parquet(f"{self.path}/rows")

    def _calibrated(self, corpus: DataFrame, recall: float, k: int, asked: int, sample: int, seed: int) -> VectorIndex:
        """With the fewest cells that hold `recall` of the k nearest of `asked` rows outside the training sample, and then the fewest codes, in doublings, that find as much of what these hold."""
        n = corpus.where("embedding is not null").count()
        trained_on = max(1, min(sample, n // 2))
        rest = _by_hash(corpus, seed).offset(trained_on).limit(asked) if n > trained_on else corpus
        queries = written(rest.select(F.col("doc_id").alias("query_id"), "embedding"), "asked")
        near = written(dense.search(corpus, queries, k + 1).where("query_id <> doc_id").select("query_id", "doc_id").join(self.rows().select("doc_id", "cell", "code"), "doc_id"), "asked-near")
        pairs, vectors = near.collect(), {r.query_id: r.embedding for r in queries.collect()}  # asked * k rows
        if not pairs:
            return self
        ids = sorted(vectors)
        order = self.model.nearest_cells(np.array([vectors[i] for i in ids], dtype=np.float64), len(self.model.centres))
        place = {q: {int(c): j for j, c in enumerate(order[i])} for i, q in enumerate(ids)}
        needed = sorted(place[p.query_id][p.cell] for p in pairs)
        probes = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1
        held = [p for p in pairs if place[p.query_id][p.cell] < probes]
        ranks = code_ranks(self, vectors, held, {q: order[i][:probes] for i, q in enumerate(ids)})
        refine = self.model.refine
        while sum(r <= refine * (k + 1) for r in ranks.values()) < recall * len(held) and refine * k < n:
            refine *= 2
        return replace(self, model=replace(self.model, probes=probes, refine=refine))


def blocks(cells: np.ndarray, most_cells: int) -> list[np.ndarray]:
    """Rows of cells (queries x probes) in blocks of neighbours that open at most `most_cells` cells together (a single query may open more)."""
    order = np.lexsort((*cells.T[1:][::-1], cells[:, 0])) if len(cells) else np.zeros(0, int)
    out, held, opened = [], [], set()
    for i in order.tolist():
        more = opened | set(cells[i].tolist())
        if held and (len(more) > most_cells or len(held) >= QUERY_BLOCK):
            out.append(np.array(held))
            held, more = [], set(cells[i].tolist())
        held.append(i)
        opened = more
    return [*out, np.array(held)] if held else out


def _code_scores(model: Model, ids: np.ndarray, q: np.ndarray, cells: np.ndarray, keep: int):
    """The best `keep` rows a query by their codes: a task's, or where these are too many to hold, each batch's."""

    def sent(best: dense.Best) -> Iterator[pa.RecordBatch]:
        query, doc, score, cell = best.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(cell.astype(np.int32)), pa.array(score)], names=["query_id", "doc_id", "cell", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = len(ids) * keep <= HELD
        best = dense.Best(len(ids), keep if hold else 0)
        for b in batches:
            doc, cell = b.column("doc_id").to_numpy(), b.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(doc), -1)
            if not hold:
                best = dense.Best(len(ids), min(keep, len(doc)))
            for c in np.unique(cell).tolist():
                asks = np.flatnonzero((cells == c).any(axis=1))
                every = np.flatnonzero(cell == c)
                step = max(1, SCORES // max(len(asks), 1))
                for a in range(0, len(every) if len(asks) else 0, step):
                    at = every[a : a + step]
                    best.add(asks, q[asks] @ model.decoded(codes[at], c).T, doc[at], value=c)
            if not hold:
                yield from sent(best)
        if hold:
            yield from sent(best)

    return run


def _exact_scores(model: Model, ids: np.ndarray, q: np.ndarray, cells: np.ndarray, k: int):
    """A task's best k rows a query by their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = dense.Best(len(ids), k)
        for b in (whole.slice(a, dense.STEP) for whole in batches for a in range(0, whole.num_rows, dense.STEP)):
            x, doc, cell = _rows(b.column("embedding"), model.dimension), b.column("doc_id").to_numpy(), b.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                asks, at = np.flatnonzero((cells == c).any(axis=1)), np.flatnonzero(cell == c)
                if len(asks):
                    best.add(asks, q[asks] @ x[at].T, doc[at], lambda v: np.round(v, 9))
        query, doc, _, score = best.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run


def code_ranks(index: VectorIndex, asked: dict[int, list[float]], near: list, cells: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """The place of each row of near (query_id, doc_id, cell, code), few of a query, among the codes of the cells of its query: one scan that counts what is before it."""
    model, ids = index.model, sorted({p.query_id for p in near})
    q, own = np.array([asked[i] for i in ids], dtype=np.float64), np.array([cells[i] for i in ids])
    marks = []
    for i in ids:
        mine = [p for p in near if p.query_id == i]
        code = np.frombuffer(b"".join(bytes(p.code) for p in mine), np.uint8).reshape(len(mine), -1)
        marks.append([(p.doc_id, round(float(np.round(model.decoded(code[j : j + 1], p.cell)[0] @ np.array(asked[i], dtype=np.float64), 9)), 9)) for j, p in enumerate(mine)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(len(m), np.int64) for m in marks]
        for b in (whole.slice(a, dense.STEP) for whole in batches for a in range(0, whole.num_rows, dense.STEP)):
            doc, cell = b.column("doc_id").to_numpy(), b.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(doc), -1)
            for c in np.unique(cell).tolist():
                asks, at = np.flatnonzero((own == c).any(axis=1)), np.flatnonzero(cell == c)
                s = np.round(q[asks] @ model.decoded(codes[at], c).T, 9)
                for row, i in zip(s, asks.tolist(), strict=True):
                    for j, (d, t) in enumerate(marks[i]):
                        before[i][j] += int((row > t).sum()) + int(((row == t) & (doc[at] < d)).sum())
        rows = [(ids[i], d, int(before[i][j])) for i, m in enumerate(marks) for j, (d, _) in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.int64()) for x in range(3)], names=["query_id", "doc_id", "before"])

    counted = index.rows().select("doc_id", "cell", "code").mapInArrow(run, "query_id long, doc_id long, before long")
    return {(r.query_id, r.doc_id): r.before + 1 for r in counted.groupBy("query_id", "doc_id").agg(F.sum("before").alias("before")).collect()}


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int | None = None, share: float = 0.25, opened: list[list[int]] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) by inner product, approximate.  share: of all cells, those that a block of queries may open.

    The queries are a stated set and pass through the driver by QUERY_BLOCK rows; a block's result is written before the
    next block begins.  opened: gets the cells of each block.
    """
    spark, model, n = index.spark, index.model, max(1, -(-queries.count() // QUERY_BLOCK))
    probes, refine = min(probes or model.probes, len(model.centres)), refine or model.refine
    direct = refine * k * FEW > index.rows().count()
    most_cells = int(share * len(model.centres))
    most_cells = max(1, most_cells) if probes <= max(1, most_cells) else len(model.centres)
    out = spark.createDataFrame([], HITS)
    for i in range(n):
        part = queries.where("embedding is not null").where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).select(F.col("query_id").cast("long").alias("query_id"), "embedding").toArrow()
        ids, x = part.column("query_id").to_numpy(), _rows(part.column("embedding").combine_chunks(), model.dimension) if len(part) else np.zeros((0, model.dimension))
        cells = model.nearest_cells(x, probes)
        for own in blocks(cells, most_cells):
            wanted = np.unique(cells[own]).tolist()
            rows = index.rows().where(F.col("cell").isin(wanted))
            if opened is not None:
                opened.append(wanted)
            if direct:
                scored = rows.select("doc_id", "cell", "embedding").mapInArrow(_exact_scores(model, ids[own], x[own], cells[own], k), HITS)
                out = out.unionByName(written(top_k(scored, k).select("query_id", "doc_id", "score"), "near"))
                continue
            coded = rows.select("doc_id", "cell", "code").mapInArrow(_code_scores(model, ids[own], x[own], cells[own], refine * k), "query_id long, doc_id long, cell int, score double")
            short = written(top_k(coded, refine * k).select("query_id", "doc_id", "cell"), "shortlist")
            asked = F.broadcast(spark.createDataFrame(pa.table({"query_id": ids[own], "q": pa.array(list(x[own]), pa.list_(pa.float64()))})))  # a block of queries
            exact = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            scored = rows.select("doc_id", "cell", "embedding").join(short, ["cell", "doc_id"]).join(asked, "query_id").select("query_id", "doc_id", exact.alias("score"))
            out = out.unionByName(written(top_k(scored, k).select("query_id", "doc_id", "score"), "near"))
    return top_k(out, k).select("query_id", "rank", "doc_id", "score")


def files(index: VectorIndex, cells: list[int] | None = None) -> int:
    """Files of the index, or those that a scan of some cells reads."""
    rows = index.rows() if cells is None else index.rows().where(F.col("cell").isin(cells))
    return rows.select(F.col("_metadata.file_path").alias("f")).distinct().count()
