import hashlib
import random
import zlib

from hypothesis import given
from hypothesis import strategies as st

from larkspur.llm import media


@given(st.binary(min_size=1, max_size=40))
def test_round_trip(data):
    samples = data + bytes(-len(data) % 64)
    image = media.png(samples)
    assert media.png_header(image[:33]) == (64, len(samples) // 64) and media.png_samples(image) == samples


def test_payloads_come_back(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/media"
    placed = media.store(odd_docs, folder)
    rows = media.read_back(media.headers(placed)).collect()
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str) == sorted(want, key=str)
    places = placed.collect()
    shards = {r.shard for r in places}
    names = [n for s in shards for n in media.members(s)]
    assert set(names) == {f"{r.digest}.png" for r in places} and len(names) <= len(places)
    fs, path = media.filesystem(places[0].shard)
    with fs.open_input_file(path) as f:
        image = f.read_at(places[0].length, places[0].offset)
    assert hashlib.sha256(image).hexdigest() == places[0].digest
    assert {(r.digest, r.width, r.height) for r in media.headers(placed).collect()} == {(r.media_sha256, r.width, r.height) for r in rows}
    assert {(r.media_sha256, r.shard, r.offset, r.length) for r in rows} == {(r.digest, r.shard, r.offset, r.length) for r in places}
    assert {(r.payload_sha256, r.feature) for r in rows} == {(hashlib.sha256(p).hexdigest(), plain_feature(p)) for p in ((lambda b: b + bytes(-len(b) % 64 if b else 64))((r.text or "").encode()) for r in odd_docs.collect())}
    assert media.media_columns(no_docs).count() == 0


def plain_feature(samples):
    mean = sum(samples) / len(samples)
    deviation = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
    return f"{mean:.4f};{deviation:.4f};" + ",".join(str(sum(x // 16 == k for x in samples)) for k in range(16))


def test_headers_read_no_payload(spark, tmp_path):
    """Metadata come from the first 33 bytes: an image whose rest is damaged still has them, and read_back says what is wrong."""
    import pytest

    docs = spark.createDataFrame([(1, "a" * 100)], "doc_id long, text string")
    placed = media.store(docs, f"file://{tmp_path}/media")
    (p,) = placed.collect()
    path = p.shard.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(p.offset + 33)
        f.write(b"damaged")
    (r,) = media.headers(placed).collect()
    assert (r.width, r.height) == (64, 2)
    with pytest.raises(Exception, match="differ from their digest"):
        media.read_back(media.headers(placed)).collect()


def test_registered_query_gives_equal_values_for_equal_texts(spark):
    from larkspur.llm.catalog import op8_media_columns

    rows = op8_media_columns(spark, "/root/testdata/sf0.001").collect()
    values = {}
    for r in rows:
        values.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert len(rows) > len(values) and all(len(v) == 1 for v in values.values())


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "d", "s", 5, 6)], "doc_id long, text string, digest string, shard string, offset long, length long")
    (r,) = media.media_columns(docs).collect()
    assert r.payload_bytes == 64 and r.shard.endswith(".tar")


def test_no_more_tasks_have_rows_than_stretches(spark, monkeypatch, tmp_path):
    """However many partitions a cluster deals to; before, 200 small images went to as many of them, and each wrote a file."""
    from pyspark.sql import functions as F

    docs = spark.range(0, 200, 1, 2).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("text"))
    placed = media.store(docs, f"file://{tmp_path}/media")
    monkeypatch.setattr(media, "READ_BYTES", 500)
    dealt = media.by_place(placed)
    assert dealt.rdd.getNumPartitions() <= 3
    used = dealt.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.countDistinct("shard", "stretch").alias("n")).collect()
    assert len(used) == placed.select("shard", "stretch").distinct().count() == 2 and all(r.n == 1 for r in used)


def test_stretches_count_copies_too(spark, tmp_path):
    """Rows of one image are dealt to several tasks where they are many."""
    from pyspark.sql import functions as F

    text = "".join(random.Random(1).choices("abcdefghijklmnop", k=200_000))
    docs = spark.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    placed = media.store(docs, f"file://{tmp_path}/media")
    (r,) = placed.agg(F.countDistinct("offset").alias("images"), F.sum("length").alias("bytes"), F.countDistinct("stretch").alias("stretches")).collect()
    assert r.images == 1 and r.stretches == (r.bytes - r.bytes // 100) // media.STRETCH_BYTES + 1 > 4
    assert {(x.doc_id, x.payload_bytes) for x in media.read_back(media.headers(placed)).collect()} == {(i, 200_000) for i in range(100)}


def test_workers_give_memory_back(monkeypatch):
    """At the end of a task; before, a worker kept what it had freed."""
    from types import SimpleNamespace

    calls = []
    monkeypatch.setattr(media, "trim", lambda: calls.append(1), raising=False)
    monkeypatch.setattr(media, "by_place", lambda placed: placed)
    frame = SimpleNamespace(mapInArrow=lambda run, schema: run)
    assert [list(step(frame)(iter([]))) for step in (media.headers, media.read_back)] == [[], []] and calls == [1, 1]
