"""Centroid clustering of integer vectors, screened by the norms of their segments.

Every vector is cut into segments of eight components, and the segments' norms
are computed once and stored with it: its compressed form.  A round does the
same for the centroids.  By Cauchy-Schwarz a segment's part of the squared
distance is at least the squared difference of the two norms, so eight numbers
bound a distance from below; the float errors of the bound are taken off.  The
centroid of the least bound gets an exact distance first, and then only those
whose bound isn't above it.  Exact distances are integers.

A round is one pass over the stored vectors: a task sends one row of integer
sums a cluster, the driver gets at most SUM_PARTS of them a cluster.

Defined results: vectors with another number of components, a null or a
non-finite one, and null vectors, are left out.  Equal distances go to the
smaller number.  A repeated row counts each time; among first centroids, rows of
one vec_id are ordered by their components, and a null vec_id is hashed as an
empty text.  With fewer vectors than centroids all of them are centroids; with none the
result is empty.  Components of 2^27 or more are computed in Python's integers;
a distance or sum that a long can't hold is given as 2^63 - 1.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SIZE, SEGMENT = 64, 8
#: Components below this have squared distances that a long holds.
NARROW = 1 << 27
MOST = (1 << 63) - 1
SUM_PARTS = 64
BATCH = 8192
#: Relative error that a float bound may have at most, several times what rounding makes.
SLACK = 2.0**-45
STORED = "vec_id long, q binary, norms binary, wide array<double>"


def floors(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) in Python's integers."""
    return [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values]


def segment_norms(q: np.ndarray) -> np.ndarray:
    """n x SIZE integers (or floats) to n x SIZE/SEGMENT norms."""
    x = q.astype(np.float64).reshape(len(q), -1, SEGMENT)
    return np.sqrt(np.einsum("nsk,nsk->ns", x, x))


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and the components, as doubles, of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where((F.size("embedding") == size) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def stored(vectors: DataFrame, scale: int) -> DataFrame:
    """The vectors in their integer form with their segments' norms, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x")
            f = np.floor(x.flatten().to_numpy(zero_copy_only=False).reshape(len(b), SIZE) * scale)
            narrow = (np.abs(f) < NARROW).all(axis=1)
            q = np.where(narrow[:, None], f, 0).astype("<i4")
            n = segment_norms(q).astype("<f8")
            wide = [None if ok else v.as_py() for ok, v in zip(narrow.tolist(), x, strict=True)] if not narrow.all() else [None] * len(b)
            cols = [b.column("vec_id"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array([r.tobytes() for r in n], pa.binary()), pa.array(wide, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "q", "norms", "wide"])

    return written(kept(vectors).mapInArrow(run, STORED), "vectors")


def fixed(column: pa.Array, kind: str) -> np.ndarray:
    """A column of binaries of one size as the rows of an array."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    return flat.reshape(len(column), -1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of q from c; both narrow as int64, otherwise Python's integers."""
    d = q - c
    return np.einsum("nk,nk->n", d, d) if d.dtype != object else (d * d).sum(axis=1)


@dataclass
class Screen:
    """Centroids with their segments' norms; counts the exact distances that it computes."""

    centroids: list[list[int]]
    computed: int = 0
    rows: int = 0
    norms: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.norms = segment_norms(np.array([[float(x) for x in c] for c in self.centroids]))
        wide = any(abs(x) >= NARROW for c in self.centroids for x in c)
        self.table = np.array(self.centroids, dtype=object if wide else np.int64)

    def bounds(self, norms: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, n x centroids."""
        out = np.empty((len(norms), len(self.norms)))
        for k, c in enumerate(self.norms):
            gap = np.maximum(np.abs(norms - c) - SLACK * (norms + c), 0)
            out[:, k] = np.einsum("ns,ns->n", gap, gap) * (1 - SLACK)
        return out

    def nearest(self, q: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, and its squared distance."""
        q = q.astype(self.table.dtype if q.dtype != object else object)
        low = self.bounds(norms)
        best = low.argmin(axis=1)
        dist = np.empty(len(q), dtype=object if object in (q.dtype, self.table.dtype) else np.int64)
        for k in range(len(self.table)):
            mine = np.flatnonzero(best == k)
            dist[mine] = exact(q[mine], self.table[k])
        first = best.copy()
        self.rows += len(q)
        self.computed += len(q)
        for k in range(len(self.table)):
            open_ = np.flatnonzero((first != k) & (low[:, k] <= dist.astype(np.float64) * (1 + SLACK)))
            if not len(open_):
                continue
            self.computed += len(open_)
            d = exact(q[open_], self.table[k])
            nearer = (d < dist[open_]) | ((d == dist[open_]) & (k < best[open_]))
            best[open_[nearer]], dist[open_[nearer]] = k, d[nearer]
        return best, dist


def assigned(b: pa.RecordBatch, screen: Screen, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, integer vectors, clusters and distances of a batch of stored vectors: the narrow ones, then the wide."""
    if not len(b):
        return
    wide = b.column("wide").is_valid().to_numpy(zero_copy_only=False)
    q, norms = fixed(b.column("q"), "<i4"), fixed(b.column("norms"), "<f8")
    at = np.flatnonzero(~wide)
    if len(at):
        yield at, q[at], *screen.nearest(q[at], norms[at])
    for i in np.flatnonzero(wide).tolist():
        v = np.array([floors(b.column("wide")[i].as_py(), scale)], dtype=object)
        yield np.array([i]), v, *screen.nearest(v, segment_norms(v))


def summed(vectors: DataFrame, centroids: list[list[int]], scale: int) -> tuple[dict[int, tuple[int, list[int]]], float]:
    """One round: {cluster: (vectors, sums of their components)}, and the share of exact distances that were computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        screen, n = Screen(centroids), np.zeros(len(centroids), np.int64)
        total = [[0] * SIZE for _ in centroids]
        for b in batches:
            for _, q, cluster, _ in assigned(b, screen, scale):
                for k in np.unique(cluster).tolist():
                    mine = q[cluster == k]
                    n[k] += len(mine)
                    s = mine.sum(axis=0, dtype=object if mine.dtype == object else np.int64).tolist()
                    total[k] = [x + y for x, y in zip(total[k], s, strict=True)]
        held = np.flatnonzero(n)
        if len(held):
            part = TaskContext.get().partitionId() % SUM_PARTS
            more = [screen.computed, *[0] * (len(held) - 1)]
            cols = [pa.array(held.astype(np.int32)), pa.array(np.full(len(held), part, np.int32)), pa.array(n[held]), pa.array(more, pa.int64()), pa.array([[str(x) for x in total[k]] for k in held], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["cluster", "part", "n", "computed", "sums"])

    def add(t: pa.Table) -> pa.Table:
        sums = [sum(map(int, column)) for column in zip(*t.column("sums").to_pylist(), strict=True)]
        one = lambda name: [sum(t.column(name).to_pylist())]
        return pa.table({"cluster": t.column("cluster")[:1], "part": t.column("part")[:1], "n": one("n"), "computed": one("computed"), "sums": pa.array([[str(x) for x in sums]], pa.list_(pa.string()))}, schema=pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("computed", pa.int64()), ("sums", pa.list_(pa.string()))]))

    shape = "cluster int, part int, n long, computed long, sums array<string>"
    out: dict[int, tuple[int, list[int]]] = {}
    computed = rows = 0
    for r in vectors.mapInArrow(run, shape).groupBy("cluster", "part").applyInArrow(add, shape).collect():
        n, sums = out.get(r.cluster, (0, [0] * SIZE))
        out[r.cluster] = (n + r.n, [a + int(b) for a, b in zip(sums, r.sums, strict=True)])
        computed, rows = computed + r.computed, rows + r.n
    return out, computed / max(rows * len(centroids), 1)


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The integer vectors of the k rows of least hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [floors(r.x, scale) for r in kept(vectors).orderBy(F.sha2(name, 256), "x").limit(k).collect()]


@dataclass
class Clustering:
    """Final centroids over stored vectors; exact_shares are the shares of exact distances, round by round."""

    centroids: list[list[int]]
    vectors: DataFrame
    scale: int
    exact_shares: list[float]

    def assignments(self) -> DataFrame:
        """vec_id, cluster, squared distance (capped at MOST) of every vector."""
        centroids, scale = self.centroids, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            screen = Screen(centroids)
            for b in batches:
                cluster, dist = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64)
                for at, _, c, d in assigned(b, screen, scale):
                    cluster[at], dist[at] = c, np.minimum(d, MOST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster), pa.array(dist)], names=["vec_id", "cluster", "distance"])

        return self.vectors.mapInArrow(run, "vec_id long, cluster int, distance long")

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> Clustering:
    """k centroids after `rounds` rounds; rounds end early where a round changes none."""
    table = stored(vectors, scale)
    centroids, shares = first_centroids(vectors, k, seed, scale), []
    for _ in range(rounds if centroids else 0):
        sums, share = summed(table, centroids, scale)
        shares.append(share)
        new = [[s // sums[i][0] for s in sums[i][1]] if i in sums else c for i, c in enumerate(centroids)]
        if new == centroids:
            break
        centroids = new
    return Clustering(centroids, table, scale, shares)


REPORT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_report(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """A row a kept vector: its cluster, squared distance, the sums of these, and the digest of its centroid."""
    spark = vectors.sparkSession
    found = cluster_vectors(vectors, k, rounds, seed, scale)
    if not found.centroids:
        return spark.createDataFrame([], REPORT)
    rows = written(found.assignments(), "assigned")
    per = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(per.values()), MOST)
    sides = spark.createDataFrame([(i, min(s, MOST), total, found.digests()[i]) for i, s in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(sides), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid
