"""Line dedup: range-partitioned line hashes, secondary sort, keep bitmaps.

Every different line of a text becomes a row (hash of its key, document, first
position, and the packed positions of its repeats).  The rows are
range-partitioned by (hash, document) and sorted by (hash, document, position),
so a line that a third of all documents hold spreads over many partitions.
Each partition is read as a stream: a run of one hash is decided as soon as it
shows `min_docs` documents, so at most min_docs - 1 documents' rows are held.  Runs at a partition's ends go out undecided with
their counts; those counts, two rows a partition at most, are added up and
broadcast back.  What returns is a compressed bitmap of kept lines a document.

Defined results: a null text is one empty line; an empty key (nothing but
white space) is never dropped; documents are counted by distinct doc_id, nulls
as one; repeated rows share their decisions; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, SpanHasher, chunks, free_name, line_spans, trim, widened, written

NO_ID = -(1 << 63)
BROADCAST_BYTES = 32 << 20
HIT = "doc long, rk long, pos int, more binary"


def row_key(docs: DataFrame) -> DataFrame:
    """docs with doc (doc_id, nulls as the least long) and rk (a hash of doc_id and text)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("rk"), "text")


def line_rows(docs: DataFrame) -> DataFrame:
    """(h, doc, rk, pos, more) of every key with a character and row with it: its first line there, and the packed places of its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for b in batches:
            doc, rk = (b.column(n).to_numpy(zero_copy_only=False) for n in ("doc", "rk"))
            for c in chunks(b.column("text")):
                starts, ends, first = line_spans(c)
                solid = np.flatnonzero(~IS_SPACE[c.data])
                if not len(solid):
                    continue
                a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
                full = np.flatnonzero(a < z)
                h = hasher.spans(LOWER[c.data], solid[a[full]], solid[z[full] - 1] + 1)
                row = np.searchsorted(first, full, side="right") - 1
                pos = (full - first[row]).astype("<i4")
                order = np.lexsort((pos, h, row))
                h, row, pos = h[order], row[order], pos[order]
                begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                more = np.full(len(begin), None, dtype=object)
                for i in np.flatnonzero(np.diff(begin, append=len(h)) > 1).tolist():
                    more[i] = zlib.compress(pos[begin[i] + 1 : begin[i + 1] if i + 1 < len(begin) else len(h)].tobytes(), 1)
                at = c.first + row[begin]
                yield pa.RecordBatch.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(doc[at]), pa.array(rk[at]), pa.array(pos[begin]), pa.array(more, pa.binary())], names=["h", "doc", "rk", "pos", "more"])
        trim()

    return row_key(docs).mapInArrow(run, "h long, " + HIT)


def scan_runs(min_docs: int, keep_first: bool):
    """The streaming pass over sorted (h, doc, rk, pos, more).  What is held of a run is a row a document, up to min_docs.

    kind 0: a row to drop (a pos of -1 stays, its `more` goes); kind 1: a row of a run at the partition's border,
    undecided; kind 2: such a run's number of documents and first row.
    """

    def batch(kind: int, h, n, rows) -> pa.RecordBatch:
        doc, rk, pos, more = rows
        size = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, h, np.int64)), pa.array(np.full(size, n, np.int64)), pa.array(doc), pa.array(rk), pa.array(pos), pa.array(more, pa.binary())], names=["kind", "h", "n", "doc", "rk", "pos", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = None  # the open run: hash, documents, last document, first row, rows held
        n, last, head, held, border = 0, None, None, [], True

        def add(rows) -> Iterator[pa.RecordBatch]:
            nonlocal n, last, head
            doc = rows[0]
            if head is None:
                head = (*(x[:1] for x in rows[:3]), np.full(1, None, dtype=object))
                if keep_first:
                    rows = (rows[0], rows[1], np.concatenate([[-1], rows[2][1:]]).astype(np.int32), rows[3])
                    if border:
                        yield batch(1, h, 0, head)
            before = n
            n += int((doc[1:] != doc[:-1]).sum()) + int(last is None or last != doc[0])
            last = doc[-1]
            if n >= min_docs:
                if before < min_docs:
                    for r in held:
                        yield batch(0, h, 0, r)
                    held.clear()
                yield batch(0, h, 0, rows)
            else:
                held.append(rows)

        def close(at_end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n, last, head
            if border or at_end:
                for r in held:
                    yield batch(1, h, 0, r)
                yield batch(2, h, n, head)
            held.clear()
            n, last, head = 0, None, None

        for b in batches:
            if not b.num_rows:
                continue
            hs, *rows = (b.column(x).to_numpy(zero_copy_only=False) for x in ("h", "doc", "rk", "pos", "more"))
            cut = np.flatnonzero(hs[1:] != hs[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(hs)]])
            if h is not None and hs[0] != h:
                yield from close(False)
                border = False
            h = hs[0]
            yield from add([x[: ends[0]] for x in rows])
            if len(starts) == 1:
                continue
            yield from close(False)
            border = False
            if len(starts) > 2:  # whole runs inside the batch
                new = np.ones(len(hs), dtype=np.int64)
                new[1:] = (rows[0][1:] != rows[0][:-1]) | (hs[1:] != hs[:-1])
                docs = np.add.reduceat(new[: starts[-1]], starts[1:-1])
                sel = np.zeros(len(hs), dtype=bool)
                sel[starts[1] : starts[-1]] = np.repeat(docs >= min_docs, (ends - starts)[1:-1])
                drop = rows
                if keep_first:
                    stay = rows[2].copy()
                    stay[starts] = -1
                    drop = [rows[0], rows[1], stay, rows[3]]
                    sel[starts] &= b.column("more").is_valid().to_numpy(zero_copy_only=False)[starts]
                if sel.any():
                    yield batch(0, 0, 0, [x[sel] for x in drop])
            h = hs[-1]
            yield from add([x[starts[-1] :] for x in rows])
        if h is not None:
            yield from close(True)
        trim()

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc, rk, pos, more) of the lines to drop."""
    lines = written(line_rows(docs), "lines")
    ranged = lines.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "pos", "rk")
    out = written(ranged.mapInArrow(scan_runs(min_docs, keep_first), "kind int, h long, n long, " + HIT), "line-runs")
    total = out.where("kind = 2").groupBy("h").agg(F.sum("n").alias("docs"), F.min(F.struct("doc", "pos", "rk")).alias("head"))
    open_rows = out.where("kind = 1").select("h", "doc", "rk", "pos", "more").join(F.broadcast(total), "h").where(F.col("docs") >= min_docs)  # two rows a partition at most
    if keep_first:
        open_rows = open_rows.where(~((F.col("doc") == F.col("head.doc")) & (F.col("pos") == F.col("head.pos")) & (F.col("rk") == F.col("head.rk"))))
    return out.where("kind = 0").select("doc", "rk", "pos", "more").unionByName(open_rows.select("doc", "rk", "pos", "more"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc, rk, keep): for each document that loses lines, zlib-compressed bits of the kept lines.

    Lines beyond the bitmap's end stay.  doc and rk are those of row_key().
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for ps, ms in zip(b.column("ps").to_pylist(), b.column("ms").to_pylist(), strict=True):
                p = np.concatenate([np.array([x for x in ps if x >= 0], dtype=np.int64), *(np.frombuffer(zlib.decompress(m), "<i4") for m in ms)]).astype(np.int64)
                keep = np.ones(-(-(int(p.max(initial=-1)) + 1) // 8) * 8, dtype=np.uint8)
                keep[p] = 0
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("rk"), pa.array(bits, pa.binary())], names=["doc", "rk", "keep"])
        trim()

    return dropped_lines(docs, min_docs, keep_first).groupBy("doc", "rk").agg(F.collect_set("pos").alias("ps"), F.collect_set("more").alias("ms")).mapInArrow(pack, "doc long, rk long, keep binary")


def kept_flags(keep: bytes | None, n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[:n]
        out[: len(bits)] = bits.astype(bool)
    return out


def with_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> tuple[DataFrame, str]:
    """docs with the bitmap of each row (null: all lines stay), and that column's name."""
    maps = written(keep_bitmaps(docs, min_docs, keep_first), "keep")
    size = maps.agg(F.coalesce(F.sum(F.length("keep") + 24), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        maps = F.broadcast(maps)
    doc, rk, keep = (free_name(docs.columns, x) for x in ("ld_doc", "ld_rk", "ld_keep"))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), rk: F.xxhash64("doc_id", "text")})
    return keyed.join(maps.select(F.col("doc").alias(doc), F.col("rk").alias(rk), F.col("keep").alias(keep)), [doc, rk], "left").drop(doc, rk), keep


def line_report(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept lines of every row of docs."""
    joined, keep = with_bitmaps(docs.select("doc_id", "text"), min_docs, keep_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for text, bits in zip(b.column("text").to_pylist(), b.column(keep).to_pylist(), strict=True):
                text = text or ""
                size, out = text.count("\n") + 1, 0
                if bits is not None:
                    flags = kept_flags(bits, size)
                    out = int(size - flags.sum())
                    text = "\n".join(x for x, k in zip(text.split("\n"), flags, strict=True) if k)
                n.append(size)
                gone.append(out)
                sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
        trim()

    return joined.select("doc_id", "text", keep).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = True) -> DataFrame:
    """docs with the dropped lines taken out of text; rows that lose their last solid line go.  All columns stay."""
    joined, keep = with_bitmaps(docs, min_docs, keep_first)
    fields = [f.name for f in docs.schema.fields]
    gone = free_name(joined.columns, "ld_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lost = b.column("text").to_pylist(), []
            for i, bits in enumerate(b.column(keep).to_pylist()):
                lost.append(False)
                if bits is not None:
                    lines = texts[i].split("\n")
                    texts[i] = "\n".join(x for x, k in zip(lines, kept_flags(bits, len(lines)), strict=True) if k)
                    lost[i] = not texts[i].strip(" \t\n\v\f\r")
            cols = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lost, pa.bool_())], names=[*fields, gone])
        trim()

    return joined.select(*fields, keep).mapInArrow(run, widened(docs, **{gone: "boolean"})).where(~F.col(gone)).drop(gone)
