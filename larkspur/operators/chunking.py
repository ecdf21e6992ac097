"""Chunking: documents (doc_id, content) to chunks, one explode each, all on the JVM side.

The tokenizer is a strategy: a function from a text column to an array of
tokens, joined by a blank.  The default is white-space words.  A document
without tokens (or with null content) has no chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Tokenizer = Callable[[Column], Column]
CHUNK = ("chunk_id", "doc_id", "chunk_index", "start_char", "end_char", "n_tokens", "content")


def chunk_id(doc_id: Column, index: Column, start: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", doc_id.cast("string"), index.cast("string"), start.cast("string"))), 1, 16)


def document_id(content: Column | str) -> Column:
    return F.substring(F.md5(T.col(content)), 1, 16)


def _windows(docs: DataFrame, size: int, stride: int, to_the_end: bool, tokenizer: Tokenizer) -> DataFrame:
    d = docs.where(F.col("content").isNotNull()).select("doc_id", tokenizer(F.col("content")).alias("toks"), F.length("content").alias("chars")).where(F.size("toks") > 0)
    n = F.size("toks")
    starts = F.sequence(F.lit(0), n - 1, F.lit(stride))
    if to_the_end:  # stop at the first window that reaches the end
        starts = F.filter(starts, lambda p: (p == 0) | (p - stride + size < n))
    d = d.select("doc_id", "toks", "chars", F.posexplode(starts).alias("chunk_index", "pos"))
    end = F.least(F.col("pos") + size, n)
    start_char = (F.col("pos") / n * F.col("chars")).cast("int")
    out = d.select("doc_id", "chunk_index", start_char.alias("start_char"), (end / n * F.col("chars")).cast("int").alias("end_char"), (end - F.col("pos")).alias("n_tokens"), F.array_join(F.slice("toks", F.col("pos") + 1, F.lit(size)), " ").alias("content"))
    return out.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("start_char"))).select(*CHUNK)


def fixed(docs: DataFrame, size: int = 512, overlap: int = 50, tokenizer: Tokenizer = T.words) -> DataFrame:
    """Windows of `size` tokens every size - overlap, while one begins inside the text: the last may lie in the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and 0 <= overlap < size")
    return _windows(docs, size, size - overlap, False, tokenizer)


def sliding(docs: DataFrame, window: int = 512, stride: int = 384, tokenizer: Tokenizer = T.words) -> DataFrame:
    """Windows of `window` tokens every `stride`, up to the first that reaches the end; a stride over the window leaves gaps."""
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    return _windows(docs, window, stride, True, tokenizer)


GROUP = "array<struct<first:int,size:int,at:int,forced:boolean>>"


def _packer(target: int, most: int):
    """An Arrow function of sentences' token counts and lengths: which sentences make a chunk, and where it starts."""

    def pack(counts: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for ns, chars in zip(counts, lengths, strict=True):
            groups, first, n, at, here = [], 0, 0, 0, 0
            for i, (k, c) in enumerate(zip(ns, chars, strict=True)):
                if i > first and (k > most or n + k > target):
                    groups.append((first, i - first, at, False))
                    first, n, at = i, 0, here
                here += c
                n += k
                if k > most:
                    groups.append((i, 1, at, True))
                    first, n, at = i + 1, 0, here
            if first < len(ns):
                groups.append((first, len(ns) - first, at, False))
            out.append([{"first": f, "size": s, "at": a, "forced": x} for f, s, a, x in groups])
        return pd.Series(out, dtype=object)

    pack.__annotations__ = {"counts": pd.Series, "lengths": pd.Series, "return": pd.Series}
    return F.pandas_udf(pack, GROUP)


def semantic(docs: DataFrame, target: int = 512, least: int = 100, most: int = 1000, tokenizer: Tokenizer = T.words) -> DataFrame:
    """Sentences packed up to `target` tokens; one over `most` is cut into pieces of `most`.

    Paragraphs end at blank lines, and the packing goes on across them.  The
    start of a chunk is the summed length of the sentences before it, without
    the blanks between them, so starts drift left of the text; `least` is
    checked but has no part in the packing.  Tokens are counted once a sentence;
    only the counts, whole numbers, leave the JVM.
    """
    if not 0 < least < target < most:
        raise ValueError("0 < least < target < most is needed")
    paragraphs = F.filter(F.transform(F.split("content", "\n\n"), T.strip), lambda p: p != "")
    parts = F.filter(F.flatten(F.transform(paragraphs, lambda p: F.transform(T.sentences(p), T.strip))), lambda s: s != "")
    d = docs.where(F.col("content").isNotNull()).select("doc_id", parts.alias("parts"))
    counts = F.transform("parts", lambda s: F.size(tokenizer(s)))
    d = d.select("doc_id", "parts", _packer(target, most)(counts, F.transform("parts", lambda s: F.length(s))).alias("groups"))

    def cuts(g: Column) -> Column:
        sentence = F.get(F.col("parts"), g["first"])

        def pieces(toks: Column) -> Column:
            n, chars = F.size(toks), F.length(sentence)
            return F.transform(
                F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(most)),
                lambda p: F.struct((g["at"] + (p / n * chars).cast("int")).alias("start_char"), (g["at"] + (F.least(p + most, n) / n * chars).cast("int")).alias("end_char"), F.array_join(F.slice(toks, p + 1, F.lit(most)), " ").alias("content")),
            )

        return T.let(tokenizer(sentence), pieces)

    def one(g: Column) -> Column:
        return T.let(F.array_join(F.slice(F.col("parts"), g["first"] + 1, g["size"]), " "), lambda t: F.array(F.struct(g["at"].alias("start_char"), (g["at"] + F.length(t)).alias("end_char"), t.alias("content"))))

    chunks = F.flatten(F.transform("groups", lambda g: F.when(g["forced"], cuts(g)).otherwise(one(g))))
    out = d.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")
    return out.withColumns({"n_tokens": F.size(tokenizer(F.col("content"))), "chunk_id": chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("start_char"))}).select(*CHUNK)


def by_strategy(docs: DataFrame, strategy: str, size: int = 512, overlap: int = 50, tokenizer: Tokenizer = T.words) -> DataFrame:
    if strategy == "fixed":
        return fixed(docs, size, overlap, tokenizer)
    if strategy == "sliding":
        return sliding(docs, size, size - overlap, tokenizer)
    if strategy == "semantic":
        return semantic(docs, size, size // 4, size * 2, tokenizer)
    raise ValueError(f"unknown strategy: {strategy}")


def stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Count, mean, least, most and population deviation of chunk lengths in characters."""
    n = F.length("content")
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.round(F.stddev_pop(n), 6).alias("std_chars"))
