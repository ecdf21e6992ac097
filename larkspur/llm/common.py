"""Shared pieces of the training-data operators.

Text is handled a chunk of a few MB at a time as UTF-8 bytes in numpy arrays:
bytes below 0x80 never occur inside a multi-byte character, so splitting at
ASCII white space and lower-casing A-Z on bytes equal the same steps on
characters.  Nulls count as empty texts throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..sources.shared import drop_path, fresh_path, shared_dir, written  # noqa: F401
from ..sources.shared import give_back as trim  # noqa: F401

CHUNK_BYTES = 2 << 20


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of the column text; sizes the partitions of later steps."""
    from pyspark.sql import functions as F

    return int(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)


def counters(df: DataFrame, slots_of, size: int, ranges: int = 64) -> np.ndarray:
    """How often slots_of(batch), arrays of places below size, names each place over all of df.

    A sketch of a fixed size: a task keeps one array, sends it in `ranges`
    compressed parts, and the driver gets `size` sums of 32 bits (at most 2^32 - 1).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint64)
        for b in batches:
            for x in slots_of(b):
                np.add.at(total, x, np.uint64(1))
        parts = [(r, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for r, x in enumerate(np.split(total, ranges)) if x.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["r", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size // ranges, dtype=np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(pa.decompress(x.as_buffer(), 8 * len(total), codec="zstd", asbytes=True), dtype=np.uint64)
        return pa.table({"r": table.column("r")[:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros((ranges, size // ranges), dtype=np.uint32)
    for r, counts in df.mapInArrow(count, "r int, counts binary").groupBy("r").applyInArrow(add, "r int, counts binary").collect():
        out[r] = np.frombuffer(counts, dtype="<u4")
    return out.ravel()


# ------------------------------------------------------------------- hashing
def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: Spans of more bytes than this go through BLAKE2b, one by one.
LONG_SPAN = 256
HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class SpanHasher:
    """64-bit hashes of any spans of a byte buffer.

    Eight bytes at a time go through splitmix64 with the state so far; the
    length is the first state.  Spans of up to eight bytes and one length never
    meet, and no pattern in the bytes makes longer ones meet more often than
    chance does.  Longer spans than LONG_SPAN go through BLAKE2b.
    """

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix(size.astype(np.uint64), 3)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes at every place
        live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        at, left, state = starts[live], size[live], out[live]
        while len(live):
            state = mix(state ^ (eight[at] & HEADS[np.minimum(left, 8)]), 3)
            more = left > 8
            out[live[~more]] = state[~more]
            live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
        for i in np.flatnonzero(size > LONG_SPAN).tolist():
            out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True


# -------------------------------------------------------------------- chunks
@dataclass
class Chunk:
    """Rows [first, first + n) of a batch: bytes of text, joined, and where each row's begin."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Pieces of a string column of about `limit` bytes; a row is never cut."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for part in parts:
        part = part.cast(pa.large_string()).fill_null("") if part.null_count or part.type != pa.large_string() else part
        if not len(part):
            continue
        _, offs, data = part.buffers()
        off = np.frombuffer(offs, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < len(part):
            b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
            b = min(max(b, a + 1), len(part))
            yield Chunk(first + a, raw[off[a] : off[b]], off[a : b + 1] - off[a])
            a = b
        first += len(part)


def word_spans(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the first word of each row (with a last bound)."""
    word = np.zeros(len(c.data) + 2, dtype=bool)
    word[1:-1] = ~IS_SPACE[c.data]
    begins = word[1:] & ~word[:-1]
    finishes = word[:-1] & ~word[1:]
    inner = c.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(c.data))]
    cut = inner[word[inner] & word[inner + 1]]  # two rows that touch without white space
    begins[cut] = True
    finishes[cut] = True
    starts, ends = np.flatnonzero(begins[:-1]), np.flatnonzero(finishes)
    return starts, ends, np.searchsorted(starts, c.offsets)


def line_spans(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (split at \\n) of every row, and each row's first line; an empty row has one line."""
    breaks = np.flatnonzero(c.data == 10)
    starts = np.sort(np.concatenate([c.offsets[:-1], breaks + 1]), kind="stable")
    row_of_break = np.searchsorted(c.offsets, breaks, side="right") - 1
    per_row = np.ones(c.n, dtype=np.int64) + np.bincount(row_of_break, minlength=c.n)
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(c.n), per_row)
    last = np.zeros(len(row), dtype=bool)
    last[first[1:] - 1] = True
    ends = np.empty(len(row), dtype=np.int64)
    starts = np.empty(len(row), dtype=np.int64)
    ends[last] = c.offsets[1:]
    ends[~last] = breaks
    starts[first[:-1]] = c.offsets[:-1]
    inner = np.ones(len(row), dtype=bool)
    inner[first[:-1]] = False
    starts[inner] = breaks + 1
    return starts, ends, first


def shingles(c: Chunk, hasher: SpanHasher, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every row and where each row's begin.

    A row of fewer words than `width` has its whole sequence as its one
    shingle; a row without words has none.  Not yet distinct.
    """
    starts, ends, first = word_spans(c)
    w = hasher.spans(LOWER[c.data], starts, ends)
    n = np.diff(first)
    if not len(w):
        return w, np.zeros(c.n + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        mul = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(width)]
        all_h = np.zeros(len(w), dtype=np.uint64)
        for i in range(width):
            all_h[: len(w) - i] += w[i:] * mul[i]
        keep = np.ones(len(w), dtype=bool)
        for i in range(1, width):  # the last words of a row begin no shingle
            at = first[1:][n >= i] - i
            keep[at] = False
        short = np.flatnonzero((n > 0) & (n < width))
        for r in short:
            h = np.uint64(n[r]) * np.uint64(0xA24BAED4963EE407)
            for i in range(n[r]):
                h = h + w[first[r] + i] * mul[i]
            all_h[first[r]] = h
            keep[first[r]] = True
    count = np.add.reduceat(np.concatenate([keep, [False]]).astype(np.int64), np.minimum(first[:-1], len(keep))) * (n > 0)
    return mix(all_h[keep], 11), np.concatenate([[0], np.cumsum(count)])


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, or with underscores after it, so that it clashes with no column."""
    low = {c.lower() for c in columns}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def widened(df: DataFrame, **more: str) -> StructType:
    """df's schema and more columns; a copy, as StructType.add changes the schema that df holds."""
    return StructType([*df.schema.fields, *(StructField(n, {"string": StringType(), "double": DoubleType(), "boolean": BooleanType()}[t]) for n, t in more.items())])
