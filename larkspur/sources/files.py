"""File sources: text, markdown, JSON, JSON lines and CSV to documents (doc_id, content, metadata).

All are DataFrame readers; nothing is opened on the driver.  A path without an
extension is a folder: the files with the reader's extension at any depth, and
a file that can't be read is passed over.  A row without content is dropped,
and so is a broken JSON line; `rejected` says which, and `unread` names the
files of a folder that gave nothing.  A document's id is the
first 16 hex digits of its content's MD5 unless given.  Rows are numbered from
their file's blocks: the blocks before a row's own add their counts, so a large
file is still read by many tasks.  A path to a folder that has the reader's
extension is one file in parts, as Spark writes it: its parts by name, numbered
through.

A path that ends in `.packed` holds many small files as rows of a table (`pack`
writes it): a file costs a row there, and not a folder's entry, a listing and a
share of a task.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

DOCUMENT = "doc_id string, content string, metadata map<string,string>"


def _document(df: DataFrame, content: Column, **metadata: Column) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    out = df.select(content.alias("content"), F.create_map(*pairs).alias("metadata")).where(F.col("content").isNotNull())
    return out.select(F.substring(F.md5("content"), 1, 16).alias("doc_id"), "content", F.map_filter("metadata", lambda k, v: v.isNotNull()).alias("metadata"))


def names(extension: str) -> str:
    """A folder's files of an extension, packed ones too."""
    return f"*.{{{extension},{extension}.gz,{extension}.bz2,{extension}.zst}}"


def _reader(spark: SparkSession, path: str, extension: str):
    if PurePosixPath(path).suffix:
        return spark.read
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names(extension)).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)


def _numbered(df: DataFrame, path: str, extension: str) -> DataFrame:
    """df, read from path, with source and the row's number in its file, from 1.  Only a row a block is shuffled: a task reads a block's rows one after the other, so they are counted from its first."""
    file = F.col("_metadata.file_path")
    source = F.regexp_replace(file, rf"(\.{extension})/[^/]*$", "$1") if PurePosixPath(path).suffix else file
    rows = df.select("*", source.alias("source"), file.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    before = Window.partitionBy("source").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = rows.groupBy("source", "_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(blocks), ["_file", "_block"]).withColumn("row_number", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_file", "_block", "_at", "_first", "_before")


PACKED, WHOLE = ".packed", "source string, value string"


def pack(whole: DataFrame, path: str) -> str:
    """Whole files (source, value) as a table; path must end in .packed."""
    if not path.endswith(PACKED):
        raise ValueError(f"a path of packed files ends in {PACKED}: {path}")
    whole.select("source", "value").write.parquet(path)
    return path


def _whole(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """(source, value): files, or packed ones, each in one piece."""
    if path.endswith(PACKED):
        return spark.read.schema(WHOLE).parquet(path)
    return _reader(spark, path, extension).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")


def text(spark: SparkSession, path: str, extension: str = "txt", file_type: str = "text") -> DataFrame:
    """A document a file."""
    df = _reader(spark, path, extension).text(path, wholetext=True)
    return _document(df, F.col("value"), source=F.col("_metadata.file_path"), filename=F.col("_metadata.file_name"), file_type=F.lit(file_type), loaded_at=F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    return text(spark, path, "md", "markdown")


def _items(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """(source, index, o): the objects of JSON files, from 0 in each file; an object may stand alone or in an array."""
    item = StructType([StructField(n, StringType()) for n in dict.fromkeys(fields)])
    df = _whole(spark, path, "json")
    many = F.from_json("value", ArrayType(item))
    return df.select("source", F.posexplode(F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), many).otherwise(F.array(F.from_json("value", item)))).alias("index", "o"))


def json(spark: SparkSession, path: str, content: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """An object or an array of objects a file; index counts from 0 in each file."""
    return _document(_items(spark, path, (content, *metadata)), F.col(f"o.{content}"), source=F.col("source"), index=F.col("index"), **{m: F.col(f"o.{m}") for m in metadata})


def _lines(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """(source, index, o) of the lines of JSON lines files that aren't blank; index is the line's number, from 1, blank lines counted."""
    item = StructType([StructField(n, StringType()) for n in dict.fromkeys(fields)])
    rows = _numbered(_reader(spark, path, "jsonl").text(path), path, "jsonl").where(F.trim("value") != "")
    return rows.select("source", F.col("row_number").alias("index"), F.from_json("value", item).alias("o"))


def jsonl(spark: SparkSession, path: str, content: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """A document a line."""
    return _document(_lines(spark, path, (content, *metadata)), F.col(f"o.{content}"), source=F.col("source"), index=F.col("index"), **{m: F.col(f"o.{m}") for m in metadata})


def rejected(spark: SparkSession, path: str, content: str = "text") -> DataFrame:
    """(source, index) of the JSON objects or lines that have no content or can't be read: what the readers drop."""
    rows = (_lines if path.endswith(".jsonl") else _items)(spark, path, (content,))
    return rows.where(F.col(f"o.{content}").isNull()).select("source", "index")


def unread(spark: SparkSession, path: str, extension: str, read: DataFrame) -> DataFrame:
    """(source, length) of the files below a folder from which `read`, documents of a reader, has no row: they are broken and were passed over, or hold nothing that the reader takes.  Files of no bytes are not listed."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names(extension)).load(path).select("path", "length")  # names and sizes only
    plain = lambda c: F.regexp_replace(c, "^file:/*", "file:/").alias("_source")
    seen = read.select(plain(F.col("metadata")["source"])).distinct()
    return there.withColumn("_source", plain("path")).join(seen, "_source", "left_anti").select(F.col("path").alias("source"), "length")


def csv(spark: SparkSession, path: str, columns: tuple[str, ...] = (), separator: str = ", ") -> DataFrame:
    """A document a row, the columns (all, or those named that are there) joined; a missing cell reads None.  row_number counts from 1."""
    df = _reader(spark, path, "csv").csv(path, header=True)
    used = [c for c in columns if c in df.columns] or df.columns
    joined = F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`"), F.lit("None")) for c in used])
    return _document(_numbered(df.select(joined.alias("_joined"), "_metadata"), path, "csv"), F.col("_joined"), source=F.col("source"), row_number=F.col("row_number"), row_columns=F.lit(",".join(used)))


READERS = {".txt": text, ".json": json, ".jsonl": jsonl, ".csv": csv, ".md": markdown, ".markdown": lambda s, p, **kw: text(s, p, "markdown", "markdown")}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """The reader for the path's extension; another extension is an error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file type: {suffix}")
    return READERS[suffix](spark, path, **options)
