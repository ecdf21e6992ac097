"""Substring dedup: fixed-block anchors.

A repeat of `width` words holds at least one whole block of width / 2 words of
the text it repeats, wherever it begins, if that text is cut into
non-overlapping blocks.  So the index holds only these blocks' hashes, and the
rolling window of a block's length probes it at every word of every document.  A
window that is some document's block and is found in two documents or more is
a hit, on both sides.  Every hit is extended to all windows of `width` words
around it; these are compared by 96-bit hashes, each with the least document
that holds it, and the ones that a smaller document holds join to maximal
exact repeats.  No pairs of documents are formed, so a passage in a third of all
documents costs a row a chunk and not its square.

Documents are dealt to chunks of some MB by their ids, as a table bucketed by
chunk.  In both exchanges (probes, then windows) a chunk sends its distinct
hashes once, sorted, delta-coded and cut by hash range; a range answers with
one bit a hash.  The chunk's texts are not shuffled again: hashes are computed anew
when the answer is there.

Defined results: a null or empty text has no words; a text of fewer words than
`width` loses nothing; a null doc_id counts as smaller than any other; rows of one
doc_id are no repeats of each other, and a repeat inside one document stays;
windows are judged on the input, not on what is left.  Words are compared by
64-bit hashes of their bytes, windows by 96 bits of two hashes of those.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, chunks, fresh_path, mix, text_bytes, trim, word_spans, written

NO_ID = -(1 << 63)
#: Text of a chunk, of a bucket of chunks, and of what one hash range answers for, in bytes.
CHUNK, BUCKET, RANGE = 4 << 20, 64 << 20, 32 << 20
MOST_BUCKETS = 50_000
ASKED = "part int, chunk long, n int, keys binary, more binary"
ANSWER = "chunk long, part int, step int, bits binary"
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def block_size(width: int) -> int:
    """The longest block of which every window of `width` words holds a whole one."""
    return (width + 1) // 2


# ------------------------------------------------------------------- hashing
def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of every window of `width` words, from sums of powers: a window's costs the same whatever its width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), np.uint64(base))]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(base, -1, 1 << 64)))]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])
        return mix((sums[width:] - sums[:n]) * down[:n], width)


@dataclass
class Words:
    """The words of a chunk's documents: hashes, and each document's first word (with a last bound)."""

    h: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.ChunkedArray) -> Words:
        hasher, hs, first = SpanHasher(), [], [0]
        for c in chunks(texts):
            starts, ends, at = word_spans(c)
            hs.append(hasher.spans(c.data, starts, ends))
            first.extend((first[-1] + at[1:]).tolist())
        return cls(np.concatenate(hs) if hs else np.zeros(0, np.uint64), np.array(first, dtype=np.int64))

    def inside(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where a window begins that lies in one document, and the documents' numbers there."""
        n = np.maximum(np.diff(self.first) - width + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[:-1][row], row


# -------------------------------------------------------------- packed hashes
def packed(sorted_keys: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte plane by byte plane."""
    gaps = np.diff(sorted_keys, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def ranges_of(high: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of a 64-bit hash, and the 32 bits that name it there.  Both rise with the hash."""
    wide = (high >> np.uint64(32)) * np.uint64(parts) + ((high & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32))
    return (wide >> np.uint64(32)).astype(np.int64), wide.astype(np.uint32)


# -------------------------------------------------------------------- probes
@dataclass
class Probes:
    """A chunk's distinct probes in order, and which of them each window is."""

    places: np.ndarray  # where windows begin
    which: np.ndarray  # each one's number among the distinct ones
    part: np.ndarray
    key: np.ndarray
    block: np.ndarray  # is a block of some document here
    two: np.ndarray  # is in two rows here

    @classmethod
    def of(cls, w: Words, width: int, parts: int) -> Probes:
        block = block_size(width)
        places, row = w.inside(block)
        part, key = ranges_of(rolling(w.h, block, BASES[0])[places] if len(places) else np.zeros(0, np.uint64), parts)
        name, which = np.unique((part.astype(np.uint64) << np.uint64(32)) | key, return_inverse=True)
        anchored = np.zeros(len(name), bool)
        anchored[which[(places - w.first[:-1][row]) % block == 0]] = True
        low, high = np.full(len(name), len(w.first), np.int64), np.full(len(name), -1, np.int64)
        np.minimum.at(low, which, row)
        np.maximum.at(high, which, row)
        return cls(places, which, (name >> np.uint64(32)).astype(np.int64), name.astype(np.uint32), anchored, low < high)


@dataclass
class Windows:
    """A chunk's distinct windows around hits, in order, with the least document of each here."""

    places: np.ndarray
    row: np.ndarray
    which: np.ndarray
    part: np.ndarray
    key: np.ndarray
    more: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, w: Words, docs: np.ndarray, hit: np.ndarray, width: int, parts: int) -> Windows:
        """hit: for every word, whether a hit begins there."""
        places, row = w.inside(width)
        hits = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        around = hits[places + width - block_size(width) + 1] > hits[places]
        places, row = places[around], row[around]
        if len(places):
            high, low = rolling(w.h, width, BASES[0])[places], rolling(mix(w.h, 7), width, BASES[1])[places]
        else:
            high = low = np.zeros(0, np.uint64)
        order = np.lexsort((docs[row], low, high))
        h, lo = high[order], low[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])]) if len(h) else np.zeros(0, bool)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        part, key = ranges_of(h[new], parts)
        more = np.stack([((h[new] & np.uint64(0xFFFFFFFF))).astype("<u4"), (lo[new] >> np.uint64(32)).astype("<u4")], axis=1).copy().view("<u8").ravel()
        return cls(places, row, which, part, key, more, docs[row][order][new])


def cut(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, begin, end) of the runs of a sorted array."""
    if not len(part):
        return []
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True))


def sent(chunk: int, part: np.ndarray, key: np.ndarray, more) -> pa.Table:
    rows = [(p, chunk, z - a, packed(key[a:z]), more(a, z)) for p, a, z in cut(part)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "chunk", "n", "keys", "more"])


def bits_by_chunk(t: pa.Table, flags: np.ndarray, step: int) -> pa.Table:
    """One row of bits for each row of a range's questions."""
    ends = np.cumsum(t.column("n").to_numpy())
    bits = [pa.compress(np.packbits(flags[a:z]).tobytes(), codec="zstd", asbytes=True) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return pa.table([t.column("chunk"), t.column("part"), pa.array(np.full(len(t), step, np.int32)), pa.array(bits, pa.binary())], names=["chunk", "part", "step", "bits"])


def shared_blocks(t: pa.Table) -> pa.Table:
    """Of a range's probes: which are a block somewhere and in two documents."""
    n = t.column("n").to_pylist()
    key = np.concatenate([unpacked(k, m) for k, m in zip(t.column("keys").to_pylist(), n, strict=True)])
    flags = [np.unpackbits(np.frombuffer(pa.decompress(x, 2 * -(-m // 8), codec="zstd", asbytes=True), np.uint8).reshape(2, -1), axis=1)[:, :m] for x, m in zip(t.column("more").to_pylist(), n, strict=True)]
    block, two = np.concatenate(flags, axis=1).astype(bool)
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(at, append=len(k))
    hit = np.logical_or.reduceat(block[order], at) & ((size > 1) | np.logical_or.reduceat(two[order], at))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(hit, size)
    trim()
    return bits_by_chunk(t, out, 1)


def held_before(t: pa.Table) -> pa.Table:
    """Of a range's windows: which a document smaller than the chunk's least holds."""
    n = t.column("n").to_pylist()
    key = np.concatenate([unpacked(k, m) for k, m in zip(t.column("keys").to_pylist(), n, strict=True)])
    both = [pa.decompress(x, 16 * m, codec="zstd", asbytes=True) for x, m in zip(t.column("more").to_pylist(), n, strict=True)]
    planes = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(16, m).T).view("<u8").reshape(m, 2) for x, m in zip(both, n, strict=True)]
    more, least = np.concatenate([p[:, 0] for p in planes]), np.concatenate([p[:, 1].view(np.int64) for p in planes])
    order = np.lexsort((least, more, key))
    k, m = key[order], more[order]
    at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]))
    first = np.repeat(least[order][at], np.diff(at, append=len(k)))
    out = np.empty(len(key), bool)
    out[order] = first < least[order]
    trim()
    return bits_by_chunk(t, out, 2)


# -------------------------------------------------------------------- chunks
def answered(answers: pa.Table, step: int, part: np.ndarray) -> np.ndarray:
    """The answers of one step in the order of the chunk's distinct hashes."""
    out = np.zeros(len(part), bool)
    begins = {p: (a, z) for p, a, z in cut(part)}
    for p, s, bits in zip(answers.column("part").to_pylist(), answers.column("step").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        if s == step:
            a, z = begins[p]
            out[a:z] = np.unpackbits(np.frombuffer(pa.decompress(bits, -(-(z - a) // 8), codec="zstd", asbytes=True), np.uint8))[: z - a]
    return out


def windows_around(t: pa.Table, answers: pa.Table, width: int, parts: int) -> tuple[Words, np.ndarray, Windows]:
    """The words of a chunk, its documents, and the windows around its hits."""
    w, docs = Words.of(t.column("sd_text")), t.column("sd_doc").to_numpy()
    p = Probes.of(w, width, parts)
    hit = np.zeros(len(w.h), bool)
    hit[p.places] = answered(answers, 1, p.part)[p.which]
    return w, docs, Windows.of(w, docs, hit, width, parts)


def repeated(t: pa.Table, answers: pa.Table, width: int, parts: int) -> tuple[Words, np.ndarray]:
    """The words of a chunk, and which of them are in a window that a smaller document holds."""
    w, docs, win = windows_around(t, answers, width, parts)
    gone = answered(answers, 2, win.part)[win.which] | (docs[win.row] > win.least[win.which])
    edge = np.zeros(len(w.h) + 1, np.int64)
    np.add.at(edge, win.places[gone], 1)
    np.add.at(edge, win.places[gone] + width, -1)
    return w, np.cumsum(edge[:-1]) > 0


@dataclass
class SubstringDedup:
    """The documents dealt to chunks, and the answers of both exchanges."""

    chunked: DataFrame
    answers: DataFrame
    width: int
    parts: int

    @classmethod
    def of(cls, docs: DataFrame, width: int = 50) -> SubstringDedup:
        size = text_bytes(docs)
        parts = max(1, size // RANGE)
        chunked = by_chunk(docs, size)
        asked = chunked.select("sd_chunk", "sd_text")

        def probes(t: pa.Table) -> pa.Table:
            p = Probes.of(Words.of(t.column("sd_text")), width, parts)
            both = lambda a, z: pa.compress(np.packbits(np.stack([p.block[a:z], p.two[a:z]]), axis=1).tobytes(), codec="zstd", asbytes=True)
            return sent(t.column("sd_chunk")[0].as_py(), p.part, p.key, both)

        def windows(key, t: pa.Table, answers: pa.Table) -> pa.Table:
            if not len(t):
                return sent(0, np.zeros(0, np.int64), np.zeros(0, np.uint32), None)
            win = windows_around(t, answers, width, parts)[2]
            both = lambda a, z: squeezed(np.stack([win.more[a:z].view(np.int64), win.least[a:z]], axis=1))
            return sent(key[0].as_py(), win.part, win.key, both)

        one = written(asked.groupBy("sd_chunk").applyInArrow(probes, ASKED).groupBy("part").applyInArrow(shared_blocks, ANSWER), "shared-blocks")
        pairs = chunked.select("sd_chunk", "sd_doc", "sd_text").groupBy("sd_chunk").cogroup(one.groupBy("chunk"))
        two = written(pairs.applyInArrow(windows, ASKED).groupBy("part").applyInArrow(held_before, ANSWER), "held-before")
        return cls(chunked, one.unionByName(two), width, parts)

    def applied(self, f, schema) -> DataFrame:
        """f(chunk's rows, its words, which of these go) of every chunk."""
        width, parts = self.width, self.parts

        def run(key, t: pa.Table, answers: pa.Table) -> pa.Table:
            return f(t, *(repeated(t, answers, width, parts) if len(t) else (Words(np.zeros(0, np.uint64), np.zeros(1, np.int64)), np.zeros(0, bool))))

        return self.chunked.groupBy("sd_chunk").cogroup(self.answers.groupBy("chunk")).applyInArrow(run, schema)


def by_chunk(docs: DataFrame, size: int) -> DataFrame:
    """(sd_id, sd_doc, sd_text, sd_chunk, sd_row) of docs, sd_row being the other columns, as a table bucketed by chunk in the shared folder."""
    spark, path, name = docs.sparkSession, fresh_path(docs.sparkSession, "chunks"), f"chunks_{uuid.uuid4().hex}"
    n = max(1, size // CHUNK)
    buckets = min(max(size // BUCKET, min(n, spark.sparkContext.defaultParallelism)), MOST_BUCKETS)
    long_id = F.col("doc_id").cast("long")
    rows = docs.select(
        long_id.alias("sd_id"),
        F.coalesce(long_id, F.lit(NO_ID)).alias("sd_doc"),
        F.coalesce("text", F.lit("")).alias("sd_text"),
        F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).alias("sd_chunk"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("sd_row"),
    )
    rows = rows.repartition(buckets, "sd_chunk").sortWithinPartitions("sd_chunk")
    rows.write.bucketBy(buckets, "sd_chunk").sortBy("sd_chunk").format("parquet").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its entry; the files are external and stay
    return table


def kept_text(text: bytes, gone: np.ndarray) -> bytes:
    words = text.split()
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)


def substring_report(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every row of docs."""

    def report(t: pa.Table, w: Words, gone: np.ndarray) -> pa.Table:
        n, removed, sha = np.diff(w.first), [], []
        for i, text in enumerate(t.column("sd_text")):
            g = gone[w.first[i] : w.first[i + 1]]
            removed.append(int(g.sum()))
            sha.append(hashlib.sha256(kept_text(text.as_py().encode(), g)).hexdigest())
        return pa.table([t.column("sd_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return SubstringDedup.of(docs.select("doc_id", "text"), width).applied(report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, first_word, end_word): the maximal runs of removed words."""

    def spans(t: pa.Table, w: Words, gone: np.ndarray) -> pa.Table:
        ids, a, z = t.column("sd_id").to_pylist(), [], []
        doc = []
        for i in range(len(t)):
            edge = np.flatnonzero(np.diff(gone[w.first[i] : w.first[i + 1]].astype(np.int8), prepend=0, append=0))
            a, z, doc = [*a, *edge[::2].tolist()], [*z, *edge[1::2].tolist()], [*doc, *[ids[i]] * (len(edge) // 2)]
        return pa.table([pa.array(doc, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["doc_id", "first_word", "end_word"])

    return SubstringDedup.of(docs.select("doc_id", "text"), width).applied(spans, "doc_id long, first_word long, end_word long")


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with the removed words taken out of text, the others joined by one space; a text that loses none stays as it is.  All columns and rows stay."""
    names, others = docs.columns, [c for c in docs.columns if c != "text"]

    def cut_out(t: pa.Table, w: Words, gone: np.ndarray) -> pa.Table:
        texts, out = t.column("sd_text").to_pylist(), []
        for i, text in enumerate(texts):
            g = gone[w.first[i] : w.first[i + 1]]
            out.append(kept_text(text.encode(), g).decode() if g.any() else text)
        columns = dict(zip(others, t.column("sd_row").flatten(), strict=True)) | {"text": pa.array(out, pa.string())}
        return pa.table([columns[c] for c in names], names=names)

    return SubstringDedup.of(docs, width).applied(cut_out, docs.schema)
