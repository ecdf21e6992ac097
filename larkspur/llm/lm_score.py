"""Stupid-backoff trigram scores from hash-partitioned n-gram counts.

1. Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased.  Every word of the corpus is
   in the model with its own count; there is no closed vocabulary and no common
   entry for rare words, so texts of words seen nowhere else score lowest.  A
   document's first word follows one start mark.
2. An n-gram of two or three words counts as seen from `least_count` times on:
   score(w | t u) = count(t u w) / count(t u) if t u w is seen, else
   backoff * score(w | u); score(w | u) = count(u w) / count(u) if u w is seen,
   else backoff * count(w) / N.  The first word has no t: score(w | start).
3. Texts are read once, into a table of chunks of about FLUSH words: the words'
   hashes, most frequent first, and the texts as ranks in them.  No table of
   n-grams is ever collected or broadcast: a chunk sends each distinct key with
   its multiplicity to the partition of the key's hash, once; there the keys of
   all chunks are summed, and each chunk gets the sums of its own keys back.  A
   frequent key so brings a partition no more than one entry a chunk.
4. Words and bigrams go first.  A trigram can only be seen as often as both of
   its bigrams, so trigrams go a second time where both are seen; no other can
   count.  What needs the number of documents or of all tokens is kept as
   multiples of their logarithms to the end.  Every exchange ends in a table, and
   its files go then.

N-grams are told apart by 64-bit hashes.

Defined results: a null text, or one without words, has n_tokens 0, logprob 0
and a null score; repeated rows count as often as they are there; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import LOWER, SpanHasher, chunks, mix, text_bytes, trim, word_spans, written

PID_BYTES = 8 << 20
FLUSH = 1_500_000
START = np.uint64(0x14057B7EF767814F)
#: A chunk: its documents, their numbers of words, their words as places in `words`, and those words' hashes.
CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("n", pa.binary()), ("w", pa.binary()), ("words", pa.binary())])
ASKED = pa.schema([("pid", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
SUMMED = pa.schema([("chunk", pa.int64()), ("step", pa.int64()), ("pid", pa.int64()), ("sums", pa.binary())])
#: `known` is the part of logprob that needs no more counts; the others are what multiplies the logarithms.
SUMS = "doc_id long, n_tokens long, known double, of_start long, of_total long"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, after their number and width."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return np.array([len(x), width], "<i8").tobytes() + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(b: bytes, kind: type = np.int64) -> np.ndarray:
    n, width = np.frombuffer(b[:16], "<i8").tolist()
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[16:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(kind)


def packed_keys(ascending: np.ndarray) -> bytes:
    """Keys as differences; they pack best in ascending order."""
    return packed(np.diff(ascending, prepend=np.uint64(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.uint64), dtype=np.uint64)


def batch(schema: pa.Schema, **cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def asked(chunk: int, key: np.ndarray, times: np.ndarray, pids: int) -> Iterator[pa.RecordBatch]:
    """The rows by which a chunk sends its distinct keys, in ascending order, to their partitions (ranges of the hash)."""
    if not len(key):
        return
    pid = (((key >> np.uint64(32)) * np.uint64(pids)) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1], [True]]))
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    yield batch(ASKED, pid=pid[cut[:-1]], chunk=[chunk] * len(spans), keys=[packed_keys(key[a:b]) for a, b in spans], times=[packed(times[a:b]) for a, b in spans])


def summed(step: int):
    """A partition's sums over all chunks, for each chunk's keys."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x.as_py()) for x in table.column("keys")]
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        places = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        sums = np.zeros(len(u), dtype=np.int64)
        for at, x in zip(places, table.column("times"), strict=True):
            sums[at] += unpacked(x.as_py())  # distinct within a chunk
        out = batch(SUMMED, chunk=table.column("chunk").to_pylist(), step=[step] * len(table), pid=table.column("pid").to_pylist(), sums=[packed(sums[at]) for at in places])
        del keys, u, inverse, places, sums
        trim()
        return pa.Table.from_batches([out])

    return run


def answered(table: pa.Table, step: int) -> np.ndarray:
    """The sums of a chunk's keys in ascending order of the keys."""
    back = sorted((p, b) for s, p, b in zip(*(table.column(c).to_pylist() for c in ("step", "pid", "sums")), strict=True) if s == step)
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(b) for _, b in back)])


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(u, 17) + w, 19)


def bigrams(w: np.ndarray, n: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each position's word before it (place len(hashes) is the start mark) and bigram; the bigrams' hashes and times."""
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[(np.cumsum(n) - n)[n > 0]] = len(hashes)
    pair, at, times = np.unique(u * (len(hashes) + 1) + w, return_inverse=True, return_counts=True)
    a, b = np.divmod(pair, len(hashes) + 1)
    return u, at, pair_keys(np.append(hashes, START)[a], hashes[b]), times


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as CHUNK rows."""
    from pyspark import TaskContext

    hasher, task, made, size = SpanHasher(), TaskContext.get().partitionId(), 0, 0
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    ids: list = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal made, size
        hashes, w, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        yield batch(CHUNK, chunk=[(task << 24) + made], docs=[list(ids)], n=[packed(np.concatenate(sizes))], w=[packed(np.argsort(order)[w])], words=[packed_keys(hashes[order])])
        words.clear(), sizes.clear(), ids.clear()
        made, size = made + 1, 0
        trim()

    for b in batches:
        doc = b.column("doc_id")
        for c in chunks(b.column("text")):
            starts, ends, first = word_spans(c)
            words.append(hasher.spans(LOWER[c.data], starts, ends))
            sizes.append(np.diff(first))
            ids.extend(doc.slice(c.first, c.n).to_pylist())
            size += len(starts)
            if size > FLUSH:
                yield from flush()
    if ids:
        yield from flush()


class Grams:
    """A chunk's words and bigrams."""

    def __init__(self, chunk: dict) -> None:
        self.n, self.w, self.words = unpacked(chunk["n"]), unpacked(chunk["w"]), unpacked_keys(chunk["words"])
        self.u, self.at, self.pairs, self.pair_times = bigrams(self.w, self.n, self.words)
        self.order = np.argsort(np.concatenate([self.words, self.pairs]))

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        times = np.concatenate([np.bincount(self.w, minlength=len(self.words)), self.pair_times])
        return np.concatenate([self.words, self.pairs])[self.order], times[self.order]


class Counted:
    """What the counts of a chunk's words and bigrams make certain, and the trigrams that may be seen."""

    def __init__(self, g: Grams, sums: np.ndarray, least_count: int, backoff: float) -> None:
        less, words = math.log(backoff), len(g.words)
        self.n = g.n
        count = np.empty(len(sums), dtype=np.int64)
        count[g.order] = sums
        row = np.repeat(np.arange(len(g.n)), g.n)
        cu, cw, both = np.append(count[:words], 1)[g.u], count[g.w], count[words:][g.at]  # the start mark's count comes last
        first, seen = g.u == words, both >= least_count
        two = np.where(seen, np.log(both) - np.log(cu), less + np.log(cw))  # score(w | u), but for log N and the start mark
        known = two + np.where(first, 0.0, less)
        ask = np.flatnonzero(seen & np.roll(seen, 1) & ~first)
        self.row, self.backed, self.context = row[ask], known[ask], both[ask - 1]
        known[ask] = 0.0
        self.known = np.bincount(row, weights=known, minlength=len(g.n))
        self.of_start, self.of_total = (np.bincount(row[x], minlength=len(g.n)) for x in (seen & first, ~seen))
        # distinct trigrams, as pairs of bigrams t u and u w, in ascending order of their hashes
        pair, place, self.times = np.unique(g.at[ask - 1] * max(len(g.pairs), 1) + g.at[ask], return_inverse=True, return_counts=True)
        left, right = np.divmod(pair, max(len(g.pairs), 1))
        three = pair_keys(g.pairs[left], mix(g.pairs[right], 23))
        order = np.argsort(three)
        self.keys, self.times, self.place = three[order], self.times[order], np.argsort(order)[place]


def lm_scores(docs: DataFrame, least_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_tokens, logprob and score (logprob a token) of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pids = max(8, -(-text_bytes(slim) // PID_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk = b.slice(i, 1).to_pylist()[0]
                yield from asked(chunk["chunk"], *Grams(chunk).asked(), pids)
                trim()

    def ask_more(chunk: pa.Table, sums: pa.Table) -> pa.Table:
        chunk = chunk.to_pylist()[0]
        c = Counted(Grams(chunk), answered(sums, 1), least_count, backoff)
        out = pa.Table.from_batches(list(asked(chunk["chunk"], c.keys, c.times, pids)), ASKED)
        del c
        trim()
        return out

    def gather(chunk: pa.Table, sums: pa.Table) -> pa.Table:
        chunk = chunk.to_pylist()[0]
        c, three = Counted(Grams(chunk), answered(sums, 1), least_count, backoff), answered(sums, 2)
        three = three[c.place]
        known = c.known + np.bincount(c.row, weights=np.where(three >= least_count, np.log(np.maximum(three, 1)) - np.log(c.context), c.backed), minlength=len(c.n))
        out = pa.table([pa.array(chunk["docs"], pa.int64()), *map(pa.array, (c.n, known, -c.of_start, -c.of_total))], names=[x.split()[0] for x in SUMS.split(", ")])
        del c, three
        trim()
        return out

    corpus = written(slim.mapInArrow(chunk_rows, from_arrow_schema(CHUNK)), "lm-chunks")
    first = written(corpus.mapInArrow(ask, from_arrow_schema(ASKED)).groupBy("pid").applyInArrow(summed(1), from_arrow_schema(SUMMED)), "lm-bigrams")
    more = corpus.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(ask_more, from_arrow_schema(ASKED))
    second = written(more.groupBy("pid").applyInArrow(summed(2), from_arrow_schema(SUMMED)), "lm-trigrams")
    parts = corpus.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(gather, SUMS)
    sums = written(parts, "lm")
    start, total = (math.log(max(x or 0, 1)) for x in sums.agg(F.sum((F.col("n_tokens") > 0).cast("long")), F.sum("n_tokens")).first())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, known, of_start, of_total = (x.to_numpy() for x in b.columns[1:])
            logprob = known + of_start * start + of_total * total
            mean = [round(t / k, 6) if k else None for t, k in zip(logprob.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(logprob, 4) + 0.0), pa.array(mean, pa.float64())], names=["doc_id", "n_tokens", "logprob", "score"])

    return sums.mapInArrow(finish, "doc_id long, n_tokens long, logprob double, score double")
