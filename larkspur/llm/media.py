"""Media columns: payloads in content-addressed tar shards.

Each text becomes an 8-bit greyscale PNG, 64 samples a line, whose samples are
the text's bytes and then the bytes 0 up to the next multiple of 64.  A task
appends its images to tar shards in the shared folder; a member's name is the
SHA-256 of the image, and equal images are stored once a shard.  Rows carry
digest, shard, offset and length, and the stretch of the shard's rows, of about
STRETCH_BYTES of media, that they are in.  `headers` deals whole stretches,
as many as READ_BYTES of media a task, and reads only each image's first 33 bytes
to fill the metadata columns; `read_back` goes on from there, reads whole ranges
and decodes them for the features.
Give `folder` to keep the shards; without it they go with the session.

Shards appear under their name only when complete, with a random part for the
attempt, so a task that runs again never meets half a shard.

Defined results: a null text is empty (64 zero bytes); equal texts give equal
values; every row has its own result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, trim, written

WIDTH = 64
SHARD_BYTES = 128 << 20
READ_BYTES = 32 << 20
STRETCH_BYTES = 2 << 20
PLACED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long, stretch int"
FEATURES = "doc_id long, n_bytes long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, length long"
PNG_MARK = b"\x89PNG\r\n\x1a\n"


def png(samples: bytes) -> bytes:
    """A greyscale image, WIDTH wide, whose samples these are (a positive multiple of WIDTH)."""
    import numpy as np

    rows = len(samples) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(rows, WIDTH)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int]:
    """Width and height from an image's first 33 bytes."""
    if head[:8] != PNG_MARK or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">II", head[16:24])


def png_samples(image: bytes) -> bytes:
    import numpy as np

    width, height = png_header(image)
    at, body = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            body.append(image[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("/") else f"file://{uri}")


class Shard:
    """A tar file in the making; add() gives a member's place of data in it."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = filesystem(folder)
        self.final, self.temp = f"{root}/{name}.tar", f"{root}/_{name}.part"
        self.fs.create_dir(root, recursive=True)
        self.out, self.at, self.held = self.fs.open_output_stream(self.temp), 0, {}

    def add(self, digest: str, image: bytes) -> int:
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + image + bytes(-len(image) % 512))
            self.held[digest] = self.at + len(head)
            self.at += len(head) + len(image) + -len(image) % 512
        return self.held[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.fs.move(self.temp, self.final)


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """PLACED: where the payload of every row of docs is, after writing the shards."""
    folder = folder or fresh_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, shard = TaskContext.get().partitionId(), 0, None
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            shard.close()
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=[x.split()[0] for x in PLACED.split(", ")])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                image = png(raw + bytes((-len(raw) % WIDTH) or (0 if raw else WIDTH)))
                if shard is None:
                    name = f"shard-{task:06d}-{n:04d}-{uuid.uuid4().hex[:8]}"
                    shard, n, taken = Shard(folder, name), n + 1, 0
                digest = hashlib.sha256(image).hexdigest()
                rows.append((doc, len(raw), digest, f"{folder}/{name}.tar", shard.add(digest, image), len(image), taken // STRETCH_BYTES))
                taken += len(image)  # copies too: a text in very many rows has many stretches
                if shard.at >= SHARD_BYTES:
                    yield flush()
                    shard = None
        if shard is not None:
            yield flush()
        trim()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PLACED), "media-index")


def feature_of(samples: bytes) -> str:
    """Mean, standard deviation and a 16-bin histogram of the samples."""
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{x.mean():.4f};{x.std():.4f};" + ",".join(map(str, bins.tolist()))


def by_place(placed: DataFrame) -> DataFrame:
    """placed, dealt by the media's bytes (the index's own are few) in whole stretches, and in the shards' order.

    However many partitions there are, no more than the stretches have rows, and only those write files.
    """
    n = max(placed.sparkSession.sparkContext.defaultParallelism, -(-int(placed.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    return placed.repartitionByRange(n, "shard", "stretch").sortWithinPartitions("shard", "offset")


class Ranges:
    """Reads of ranges of shards, one shard open at a time."""

    def __init__(self) -> None:
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            self.close()
            store_fs, path = filesystem(shard)
            self.shard, self.file = shard, store_fs.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


HEADED = PLACED + ", width int, height int"


def headers(placed: DataFrame) -> DataFrame:
    """placed, by_place(), with width and height from 33 bytes of each row's image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, last, size = Ranges(), None, (0, 0)
        for b in batches:
            sizes = []
            for place in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True):
                if place != last:  # equal images stand together
                    last, size = place, png_header(ranges.read(*place, 33))
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in sizes], pa.int32()) for i in (0, 1))], names=[*b.schema.names, "width", "height"])
        ranges.close()
        trim()

    return by_place(placed).mapInArrow(run, HEADED)


def read_back(headed: DataFrame) -> DataFrame:
    """FEATURES of every row of headers(), from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in FEATURES.split(", ")]
        ranges, last, found = Ranges(), None, ()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["shard"], r["offset"]) != last:
                    image = ranges.read(r["shard"], r["offset"], r["length"])
                    if hashlib.sha256(image).hexdigest() != r["digest"]:
                        raise OSError(f"{r['shard']} at {r['offset']}: stored bytes differ from their digest")
                    s = png_samples(image)
                    if len(s) != r["width"] * r["height"]:
                        raise OSError(f"{r['shard']} at {r['offset']}: {len(s)} samples, but the header has {r['width']} x {r['height']}")
                    last = r["shard"], r["offset"]
                    found = len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(image), r["digest"], feature_of(s)
                out.append((r["doc_id"], r["n_bytes"], r["width"], r["height"], *found, r["shard"], r["offset"], r["length"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        ranges.close()
        trim()

    return headed.mapInArrow(run, FEATURES)


def members(shard: str) -> list[str]:
    """Names in a shard, as any tar reader sees them."""
    store_fs, path = filesystem(shard)
    with store_fs.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
        return t.getnames()


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    return read_back(headers(store(docs, folder)))
