"""Web search as a provider.  The network is injected; any failure gives no results.

`OfflinePages` is a stand-in that searches a table of pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sparse

WEB = "array<struct<doc_id:bigint,content:string,score:double,rerank_score:double,source:string>>"


def from_function(search: Callable[[str, int], list[tuple[str, str, str]]], most: int = 5):
    """A provider from a function of (query, most) to (title, body, address) rows, called on executors."""

    import pyarrow as pa

    found = pa.list_(pa.struct([("doc_id", pa.int64()), ("content", pa.string()), ("score", pa.float64()), ("rerank_score", pa.float64()), ("source", pa.string())]))

    def one(query: str) -> list[dict]:
        try:
            return [{"content": f"{t}\n{b}", "source": u} for t, b, u in search(query, most)[:most]]
        except Exception:  # noqa: BLE001  a failed search is an empty one
            return []

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([one(q) for q in b.column("query").to_pylist()], found)], names=["query_id", "web"])

    def provide(queries: DataFrame) -> DataFrame:
        return queries.select("query_id", "query").mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, web {WEB}")

    return provide


def offline_pages(pages: DataFrame, most: int = 5):
    """A provider over pages (doc_id, url, title, content): the best by BM25."""

    def search(queries: DataFrame) -> DataFrame:
        hits = sparse.search(pages.select("doc_id", "content"), queries, most).join(pages, "doc_id")
        doc = F.struct(F.lit(None).cast("long").alias("doc_id"), F.concat_ws("\n", "title", "content").alias("content"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("rerank_score"), F.col("url").alias("source"))
        return hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", doc.alias("d")))), lambda x: x["d"]).alias("web"))

    return search
