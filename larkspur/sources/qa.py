"""Question-answering sources as plans: nested records to documents, queries and gold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions import text as T


def first_by(rows: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The first row of each key in input order.  Keys meet by their 128-bit digest, after each task has kept its own first rows."""
    digest = F.md5((F.col(key) if isinstance(key, str) else key).cast("string")).alias("_digest")
    return rows.groupBy(digest).agg(F.min_by(F.struct(*rows.columns), F.struct(order)).alias("_row")).select("_row.*")


def distinct_contexts(rows: DataFrame, order: str = "idx") -> DataFrame:
    """A document for each distinct context of (idx, context, question, title, has_answer), as first seen."""
    kept = first_by(rows, "context", order)
    return kept.select(F.substring(F.md5("context"), 1, 16).alias("doc_id"), F.col("context").alias("content"), "title", "question", "has_answer", F.col(order).alias("original_index"))


def answer_map(nested: DataFrame) -> DataFrame:
    """(question_id, question, answer) of a nested dataset (data array of paragraphs array of qas array): answerable ones, first answer."""
    qa = nested.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select(F.explode("p.qas").alias("q")).select("q.*")
    return qa.where(~F.coalesce("is_impossible", F.lit(False)) & (F.size("answers") > 0)).select(F.col("id").alias("question_id"), "question", F.col("answers")[0]["text"].alias("answer"))


def shuffled(key: str, seed: int = 42) -> list[Column]:
    """A repeatable random order."""
    return [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)]


def sampled(rows: DataFrame, key: str, size: int, kind: str | None = None, seed: int = 42) -> DataFrame:
    """`size` questions in a repeatable random order; those of the wanted type first, others fill up."""
    return rows.orderBy(*([(F.col("type") != kind).cast("int")] if kind else []), *shuffled(key, seed)).limit(size)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, content, title) as JSON, an object a line."""
    return spark.read.schema("doc_id string, content string, title string").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries (query_id, query, ground_truth) as JSON, an object a line; `question` and `answer` are other names of the last two."""
    raw = spark.read.schema("query_id string, query string, question string, ground_truth string, answer string").json(path)
    return raw.select("query_id", F.coalesce("query", "question").alias("query"), F.coalesce("ground_truth", "answer").alias("ground_truth"))


def pooled_paragraphs(rows: DataFrame, order: str = "idx") -> DataFrame:
    """(doc_id, content) of the paragraphs (context struct of title and sentences arrays) of all questions, first of each title."""
    flat = rows.select(order, F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("pos", "z"))
    text = flat.select(F.struct(order, "pos").alias("at"), F.col("z.title").alias("doc_id"), T.strip(F.array_join("z.sentences", " ")).alias("content")).where("content <> ''")
    return text.groupBy("doc_id").agg(F.min_by("content", "at").alias("content"))


def question_titles(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", F.col("context.title").alias("titles"))


def supporting_facts(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", "question", "answer", "type", F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id")).alias("supporting_facts"))


def with_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """queries (query_id, query) with answers by id, else by lower-cased question, else by letters and digits only, else ''.

    answers (question_id, question, answer); of equal questions the one with the least id counts.
    """

    def key(c: Column | str) -> Column:
        return T.strip(F.lower(c))

    def bare(c: Column | str) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")

    by_id = answers.groupBy(F.col("question_id").alias("query_id")).agg(F.min("answer").alias("a1"))
    by_question = answers.groupBy(key("question").alias("k2")).agg(F.min_by("answer", "question_id").alias("a2"))
    by_bare = answers.groupBy(bare("question").alias("k3")).agg(F.min_by("answer", "question_id").alias("a3")).where("k3 <> ''")
    q = queries.withColumns({"k2": key("query"), "k3": bare("query")})
    out = q.join(by_id, "query_id", "left").join(by_question, "k2", "left").join(by_bare, "k3", "left")
    return out.select(*queries.columns, F.coalesce("a1", "a2", "a3", F.lit("")).alias("answer"))


def more_queries(raw: DataFrame, documents: DataFrame, size: int, order: str = "idx") -> DataFrame:
    """Distinct questions whose context is a document's content, in input order."""
    hit = raw.join(documents.select(F.col("content").alias("context"), "doc_id"), "context")
    return first_by(hit, "question", order).orderBy(order).limit(size).select(F.col("question").alias("query"), "doc_id", "has_answer", "title")


SHORT_BLOCK = 10_000
#: Passages that go to every task; of more, windows and texts are joined.
SENT, SCANNED = 10_000, 256


def _scanned(corpus: DataFrame, passages: DataFrame, anchor: int) -> DataFrame:
    """(query_id, doc_id) of documents that contain a passage (query_id, query, w): one pass, nothing of the corpus is shuffled."""
    shape = StructType([StructField("query_id", passages.schema["query_id"].dataType), StructField("doc_id", corpus.schema["doc_id"].dataType)])
    kind = to_arrow_type(shape["query_id"].dataType)
    rows = [(r.query_id, r.query, r.w) for r in passages.where("query_id is not null").select("query_id", "query", F.slice("w", 2, anchor).alias("w")).collect()]  # SENT at most
    place = {t: i for i, t in enumerate(sorted({t for *_, w in rows for t in w}))}
    asked: dict[int, list[int]] = {}
    for n, (_, _, w) in enumerate(rows):
        code = 0
        for t in w:
            code = code * len(place) + place[t]
        asked.setdefault(code, []).append(n)
    codes = np.array(sorted(asked), dtype=np.int64)
    shared = corpus.sparkSession.sparkContext.broadcast((rows, list(place), codes, [asked[c] for c in codes.tolist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vocabulary, codes, asked = shared.value
        words = pa.array(vocabulary, pa.string())
        for b in (whole.slice(a, SCANNED) for whole in batches for a in range(0, whole.num_rows if len(codes) else 0, SCANNED)):
            text = b.column("content")
            parts = pc.split_pattern_regex(text, r"[ \t\n\x0b\f\r]+")  # what T.words splits at
            flat = parts.flatten()
            solid = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), parts.value_lengths().to_numpy())[solid]
            own = pc.index_in(flat, words).fill_null(-1).to_numpy()[solid].astype(np.int64)
            size = max(len(own) - anchor + 1, 0)
            code, ok = np.zeros(size, dtype=np.int64), doc[:size] == doc[len(doc) - size :]
            for i in range(anchor):
                ok &= own[i : i + size] >= 0
                code = code * len(vocabulary) + own[i : i + size]
            at = np.searchsorted(codes, code)
            ok &= codes[np.minimum(at, len(codes) - 1)] == code
            found_q, found_d = [], []
            for i, c in sorted(set(zip(doc[:size][ok].tolist(), at[ok].tolist(), strict=True))):
                whole = text[i].as_py()
                for n in asked[c]:
                    if rows[n][1] in whole:
                        found_q.append(rows[n][0])
                        found_d.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(found_q, kind), b.column("doc_id").take(pa.array(found_d, pa.int64()))], names=["query_id", "doc_id"])

    return corpus.select("doc_id", "content").where("doc_id is not null and content is not null").mapInArrow(run, shape)


def containing(corpus: DataFrame, passages: DataFrame, anchor: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """(query_id, doc_id) for every document that contains a passage.

    Passages are a stated query set.  A passage's words 2 to 1 + anchor, whole
    words wherever the passage stands, are looked up among the documents' word
    windows; only documents with the anchor are searched.  Passages too short
    for an anchor are searched in all documents, a block of them at a time.
    """
    p = passages.select("query_id", "query", T.words("query").alias("w"))
    long = p.where(F.size("w") >= anchor + 2).withColumn("anchor", F.array_join(F.slice("w", 2, anchor), " "))
    short = p.where(F.size("w") < anchor + 2).select("query_id", "query")
    n_long = long.count()
    few = n_long <= broadcast_rows
    hint = F.broadcast if few else (lambda df: df)
    if n_long <= min(SENT, broadcast_rows) and (n_long * anchor) ** anchor < 1 << 62:
        found = _scanned(corpus, long, anchor)
    else:
        words = corpus.select("doc_id", "content", T.words("content").alias("w"))
        windows = F.when(F.size("w") >= anchor, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - anchor + 1), lambda i: F.array_join(F.slice("w", i, F.lit(anchor)), " ")))).otherwise(F.array().cast("array<string>"))
        hits = words.select("doc_id", F.explode(windows).alias("anchor")).join(hint(long.select("query_id", "anchor")), "anchor").select("doc_id", "query_id").distinct()
        found = hits.join(hint(long.select("query_id", "query")), "query_id").join(corpus.select("doc_id", "content"), "doc_id").where(F.contains("content", F.col("query"))).select("query_id", "doc_id")
    blocks = -(-short.count() // SHORT_BLOCK)
    for i in range(blocks):
        some = F.broadcast(short.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
        found = found.unionByName(corpus.select("doc_id", "content").join(some, F.contains("content", F.col("query"))).select("query_id", "doc_id"))
    return found
