"""Connected components of a graph of long ids, by alternating large and small stars.

Each round is two aggregates and two joins on the node.  Nodes with very many
neighbours, at most `HUBS` of them, are joined by broadcast, so that no task
gets all edges of one.  Rounds end when the edges stay the same; their number
grows with the logarithm of the longest chain, and beyond `most_rounds`, which no
chain of fewer than 2^50 nodes needs, an error is raised.  Every round is a
table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


HUBS = 100_000
HUB_EDGES = 1000


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """edges with the m of their a; least is (a, m, c), c the edges of a."""
    most = max(HUB_EDGES, 2 * n_edges // HUBS)
    hubs = F.broadcast(least.where(F.col("c") > most).select("a", F.col("m").alias("hub_m")))  # at most HUBS rows
    own = F.when(F.col("hub_m").isNull(), F.col("a")).otherwise(F.xxhash64("a", "b"))  # edges of a hub are dealt anywhere, and have its m already
    marked = edges.join(hubs, "a", "left").select("a", "b", "hub_m", own.alias("own"))
    found = marked.join(least.select(F.col("a").alias("own"), "m"), "own", "left")
    return found.select("a", "b", F.coalesce("hub_m", "m").alias("m"))


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One star step over edges (a, b) with a > b: links towards the least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
        out = _with_least(both, least, 2 * n_edges).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        joined = _with_least(edges, least, n_edges)
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))), F.lit(0))).first())


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the least node that links (a, b) reach, for every node with a link."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = _state(edges)
    for _ in range(most_rounds if before[0] else 0):
        edges = written(_star(_star(edges, True, before[0]), False, before[0]), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
