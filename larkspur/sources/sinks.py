"""Sinks: results, baselines, indexes, checkpoints that can be resumed, and cache entries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import drop_path, fresh_path, hadoop_path, written


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_index(vectors: DataFrame, path: str, metric: str = "cosine") -> None:
    """Vectors as parquet and what they are as JSON beside them."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    facts = vectors.agg(F.count("*").alias("ntotal"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension")).withColumns({"metric": F.lit(metric), "type": F.lit("Flat")})
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/facts")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.json(f"{path}/facts").first().asDict()


def rebuilt_chunks(index: DataFrame) -> DataFrame:
    """The chunks of the sparse side from an index that has their content: each from 0 to its own length."""
    return index.select("doc_id", "content", F.lit(0).alias("start_char"), F.length("content").alias("end_char"))


def save_baseline(means: DataFrame, path: str, name: str = "baseline") -> None:
    """(metric, mean) as one JSON file of (name, metric, mean)."""
    means.select(F.lit(name).alias("name"), "metric", F.col("mean").cast("double").alias("mean")).coalesce(1).write.mode("overwrite").json(path)  # a row a metric


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, metric string, mean double").json(path).select("metric", "mean")


def write_error_report(categorised: DataFrame, path: str, order: str, most: int = 5) -> None:
    """(category, n, error_rate, examples): the distribution with the first rows of each category.  Categories are costly, so they are written once."""
    from ..operators import evaluation

    categorised = written(categorised.select(order, "categories"), "categorised")
    shown = evaluation.first_examples(categorised, order, most).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", order))), lambda x: x[order]).alias("examples"))
    evaluation.error_distribution(categorised).join(shown, "category", "left").write.mode("overwrite").json(path)


TASK = "sample_id string, query string, prediction string, contexts array<string>, ratings map<string,int>, notes string"


def write_tasks(samples: DataFrame, path: str, dimensions: tuple[str, ...] = ("relevance", "faithfulness", "conciseness")) -> None:
    """Tasks for annotators: samples (sample_id, query, prediction, contexts) with an empty rating for each dimension."""
    empty = F.map_from_arrays(F.array(*map(F.lit, dimensions)), F.array_repeat(F.lit(None).cast("int"), len(dimensions)))
    samples.select("sample_id", "query", "prediction", "contexts", empty.alias("ratings"), F.lit("").alias("notes")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def undone(todo: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """What a run that was broken off has still to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


#: Rows of a batch that are dealt to one task.
FILE_ROWS = 10_000
LEDGER = "batch string, n_rows long, first string, last string"


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """What the ledger at path says is done; None where nothing is.  Rows of a batch that broke off are not in it."""
    p, fs = hadoop_path(spark, f"{path}/ledger")
    batches = [r.batch for r in spark.read.schema(LEDGER).parquet(f"{path}/ledger").select("batch").collect()] if fs.exists(p) else []
    return spark.read.parquet(*[f"{path}/batches/{b}" for b in batches]) if batches else None


def resume(todo: DataFrame, path: str, work, key: str = "query_id", batch_rows: int = 100_000) -> DataFrame:
    """work(rows that path doesn't have yet), a batch of about `batch_rows` after the other; all results.

    A batch's results are written to a folder of their own, and then one row in
    the ledger makes them count.  A run that breaks off keeps every batch of the
    ledger; the next one deletes what isn't in it and does only the rest.  What is
    left is dealt into batches by the key's hash as one table, so each batch reads
    its own part, in files of about FILE_ROWS rows.  One run at a time.
    """
    spark = todo.sparkSession
    done = committed(spark, path)
    left = (undone(todo, done, key) if done is not None else todo).withColumn("_key", F.col(key))
    _drop_broken(spark, path)
    rows = left.count()
    n = max(1, -(-rows // batch_rows))
    files = max(1, -(-rows // n // FILE_ROWS))
    parts = fresh_path(spark, "todo")
    left.withColumn("_batch", F.pmod(F.xxhash64("_key"), F.lit(n)).cast("int")).repartitionByRange(n * files, F.col("_batch"), F.hash("_key")).write.partitionBy("_batch").parquet(parts)
    rows = spark.read.schema(StructType([*left.schema.fields, StructField("_batch", IntegerType())])).parquet(parts)
    for i in range(n):
        batch, name = rows.where(F.col("_batch") == i), uuid.uuid4().hex
        size, first, last = batch.agg(F.count("*"), F.min("_key").cast("string"), F.max("_key").cast("string")).first()
        if size or (done is None and i == 0):
            work(batch.drop("_batch", "_key")).write.parquet(f"{path}/batches/{name}")
            spark.createDataFrame([(name, size, first, last)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    drop_path(spark, parts)
    return committed(spark, path)


def _drop_broken(spark: SparkSession, path: str) -> None:
    """Deletes the folders of batches that the ledger doesn't have."""
    p, fs = hadoop_path(spark, f"{path}/batches")
    if fs.exists(p):
        ledger, lfs = hadoop_path(spark, f"{path}/ledger")
        kept = {r.batch for r in spark.read.schema(LEDGER).parquet(f"{path}/ledger").select("batch").collect()} if lfs.exists(ledger) else set()
        for f in fs.listStatus(p):
            if f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)


def write_annotations(rows: DataFrame, path: str) -> None:
    """One folder an annotator."""
    rows.write.mode("overwrite").partitionBy("annotator_id").json(path)


def read_annotations(spark: SparkSession, path: str, annotator: str | None = None) -> DataFrame:
    df = spark.read.schema("sample_id string, ratings map<string,int>, notes string, timestamp string, annotator_id string").json(path)
    return df.where(F.col("annotator_id") == annotator) if annotator else df


def cache_set(path: str, rows: DataFrame, now: Column) -> None:
    """Entries (embedding, query, result) with a fresh id and their time."""
    rows.select(F.expr("uuid()").alias("entry_id"), "embedding", "query", "result", now.alias("ts")).write.mode("append").parquet(path)


def cache_clear(spark: SparkSession, path: str) -> None:
    """An empty cache takes the old one's place by two renames; the old one is deleted last, so a crash loses nothing."""
    spark.read.parquet(path).limit(0).write.mode("overwrite").parquet(f"{path}-cleared")
    (old, fs), (new, _), (gone, _) = (hadoop_path(spark, x) for x in (path, f"{path}-cleared", f"{path}-gone"))
    fs.delete(gone, True)
    fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)
