"""The corpus pipeline: documents to packed training sequences.

Stages, in order: language ID (rejected documents go), line dedup (lines of ten
or more documents stay only where they are first; a document left without a
solid line goes), n-gram Jaccard join (one document of each group of near
copies stays: five words, similarity 0.8), mixing (sources repeated towards
temperature weights, nothing dropped), best-fit packing.

Null, empty and repeated rows: see each operator's module.  All stages but the
last keep the columns of documents as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import written
from larkspur.llm.language_id import known_languages
from larkspur.llm.line_dedup import without_repeated_lines
from larkspur.llm.ngram_join import one_of_each_group
from larkspur.llm.packing import default_tokenizer, pack
from larkspur.llm.source_mixing import mixed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs, min_docs=10, keep_first=True)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, width=5, similarity=(80, 100))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, most_repetition=1.25)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer(), length=1024, end_id=2)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("source_mixing", source_mixing), ("packing", packing)]

#: Training a classifier and tokenising are beyond SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
