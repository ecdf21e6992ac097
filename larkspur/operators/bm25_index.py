"""A stored BM25 index: blocks of postings with their block maxima, searched by bounds.

Documents are sorted by id and cut into ranges of at most RANGE_DOCS; a range is
inverted where it lies.  A row of the postings table is a term's block of at most
BLOCK_DOCS documents of one range: their places in the range as differences, the
term's counts, and the largest count and least document length among them, which
bound any score that the block can give, whatever the corpus' mean length becomes.
The table is sorted by term, so that a search for some terms reads their pages
only; a term in all documents lies in many files.

A search goes over blocks of queries, one after the other, each written before
the next begins.  Of a query's terms the rare ones are scored first; the k-th best
of what they give is a threshold.  Terms whose bounds together stay below it
can't bring a document in by themselves, so documents come from the other terms
only (MaxScore), and the postings of the common ones are read only in blocks
that hold a document whose score plus block bounds reaches the threshold.  What
is left out can't be among the k best, so the result is that of sparse.search.

An index is a folder: segments, and a table of versions to which each commit
appends one row.  `add` writes a segment of new documents, `merge` rewrites all
segments as one without tokenising anything again.  One writer at a time; readers
keep the version that they opened.  A search without an index is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import hadoop_path, written
from .ranking import top_k
from .sparse import Okapi, tokenised

RANGE_DOCS, BLOCK_DOCS = 4096, 128
#: Tokens of a range, where documents are long.
RANGE_TOKENS = 4 << 20
#: Queries of one block: a task holds a number for each of them and each document of a range.
BLOCK_QUERIES = 1000
INTERVALS = 32
#: Postings that the rarest terms of a query must have together before its threshold is taken, times k.
FIRST_POSTINGS = 20
ROW = "range long, kind int, term string, part int, n int, first int, last int, top_tf int, least_dl int, body binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
DOCS, POSTINGS, BOUNDS, CANDIDATES, NEEDED = range(5)
VERSION = "version int, segments array<string>, n_docs long, total long, vocabulary long, mean_raw double, corpus_bytes long"
SLACK = 1e-6
PAGES = {"parquet.page.size": str(16 << 10), "parquet.page.row.count.limit": "500", "compression": "zstd"}


# ------------------------------------------------------------------ the blocks
def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising places below 2^16 and counts: a byte of flags, gaps of one byte or two, counts (left out if all are 1) of one byte or four."""
    gaps = np.diff(places, prepend=0)
    wide, several, large = bool(gaps.max() > 255), bool(counts.max() > 1), bool(counts.max() > 255)
    body = gaps.astype("<u2" if wide else "u1").tobytes() + (counts.astype("<u4" if large else "u1").tobytes() if several else b"")
    return bytes([wide | several << 1 | large << 2]) + body


def unpacked(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    flags, size = body[0], 2 if body[0] & 1 else 1
    places = np.cumsum(np.frombuffer(body, "<u2" if flags & 1 else "u1", n, 1).astype(np.int64))
    counts = np.frombuffer(body, "<u4" if flags & 4 else "u1", n, 1 + n * size) if flags & 2 else np.ones(n, np.uint8)
    return places, counts.astype(np.float64)


def packed_docs(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    return pa.compress(np.diff(ids, prepend=0).astype("<i8").tobytes() + lengths.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def unpacked_docs(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(body, 12 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<i4", n, 8 * n)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 6, pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)


def inverted(number: int, ids: np.ndarray, lengths: np.ndarray, tokens: pa.Array, size: int) -> pa.RecordBatch:
    """The rows of one range: its documents, then the blocks, of `size` documents at most, of every term."""
    rows = [(number, DOCS, None, 0, len(ids), 0, len(ids) - 1, 0, 0, packed_docs(ids, lengths))]
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, count = np.unique(code * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, place = np.divmod(pair, len(ids))
    ends = np.flatnonzero(np.diff(term, append=-1)) + 1
    words = coded.dictionary.to_pylist()
    a = 0
    for z in ends.tolist():
        for part, i in enumerate(range(a, z, size)):
            j = min(i + size, z)
            p, c = place[i:j], count[i:j]
            rows.append((number, POSTINGS, words[term[i]], part, j - i, int(p[0]), int(p[-1]), int(c.max()), int(lengths[p].min()), packed(p, c)))
        a = z
    return batch(rows)


def _inverted_ranges(corpus: DataFrame, segment: int) -> DataFrame:
    """Rows of ROW of a corpus, sorted by id and cut into ranges."""

    most_docs, most_tokens, block = RANGE_DOCS, RANGE_TOKENS, BLOCK_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (segment << 44) + (TaskContext.get().partitionId() << 20)
        held: list[pa.Table] = []
        rows = tokens = 0

        def flush() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            toks = t.column("toks").combine_chunks()
            return inverted(number, t.column("doc_id").to_numpy(), toks.value_lengths().to_numpy().astype(np.int64), toks.flatten(), block)

        for whole in batches:
            size = np.cumsum(whole.column("toks").value_lengths().to_numpy())
            a = 0
            while a < whole.num_rows:
                before = size[a - 1] if a else 0
                z = max(a + 1, min(a + most_docs - rows, int(np.searchsorted(size, before + most_tokens - tokens, side="right")), whole.num_rows))
                held.append(pa.Table.from_batches([whole.slice(a, z - a)]))
                rows, tokens, a = rows + z - a, tokens + int(size[z - 1] - before), z
                if rows >= most_docs or tokens >= most_tokens:
                    yield flush()
                    held.clear()
                    rows = tokens = 0
                    number += 1
        if rows:
            yield flush()

    docs = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "content").where("doc_id IS NOT NULL")
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")  # of texts: the bounds of the ranges come from a pass of their own, which needn't tokenise
    return tokenised(docs).select("doc_id", "toks").mapInArrow(run, ROW)


def _total_tokens(docs: DataFrame) -> int:
    """The documents' lengths together, from the rows of kind DOCS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(unpacked_docs(body, n)[1].sum(dtype=np.int64)) for n, body in zip(b.column("n").to_pylist(), b.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["total"])

    return docs.select("n", "body").mapInArrow(run, "total long").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]


# ------------------------------------------------------------------- versions
@dataclass(frozen=True)
class Bm25Index:
    """An index at one version."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[str, ...]
    n_docs: int
    total: int
    vocabulary: int
    mean_raw: float
    corpus_bytes: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Bm25Index:
        """The newest version; ValueError where there is none."""
        p, fs = hadoop_path(spark, f"{path}/versions")
        if not fs.exists(p):
            raise ValueError(f"no index at {path}: build one first")
        row = spark.read.schema(VERSION).parquet(f"{path}/versions").orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError(f"no index at {path}: build one first")
        return cls(spark, path, row.version, tuple(row.segments), *row[2:])

    @classmethod
    def build(cls, corpus: DataFrame, path: str) -> Bm25Index:
        """A new index of corpus (doc_id, content), in place of what is at path."""
        return cls(corpus.sparkSession, path, -1, (), 0, 0, 0, 0.0, 0)._with(corpus, keep=False)

    def add(self, corpus: DataFrame) -> Bm25Index:
        """A version with more documents; their ids must be new."""
        there = self._ids().join(corpus.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").first()
        if there is not None:
            raise ValueError(f"document {there.doc_id} is in the index already")
        return self._with(corpus, keep=True)

    def merge(self) -> Bm25Index:
        """A version with all segments in one."""
        name = self._write(self.docs(), self.postings())
        return self._commit((name,), self.n_docs, self.total, self.corpus_bytes)

    def docs(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(*[f"{self.path}/{s}/docs" for s in self.segments])

    def postings(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(*[f"{self.path}/{s}/postings" for s in self.segments])

    def _ids(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, body in zip(b.column("n").to_pylist(), b.column("body").to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(unpacked_docs(body, n)[0])], names=["doc_id"])

        return self.docs().select("n", "body").mapInArrow(run, "doc_id long")

    def _write(self, docs: DataFrame, postings: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        docs.write.option("compression", "zstd").parquet(f"{self.path}/{name}/docs")
        postings.repartitionByRange("term", "range").sortWithinPartitions("term", "range", "part").write.options(**PAGES).parquet(f"{self.path}/{name}/postings")
        return name

    def _with(self, corpus: DataFrame, keep: bool) -> Bm25Index:
        rows = written(_inverted_ranges(corpus, self.version + 1), "ranges")
        docs = rows.where(F.col("kind") == DOCS)
        name = self._write(docs, rows.where(F.col("kind") == POSTINGS))
        size = corpus.where("doc_id IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
        total = _total_tokens(docs)
        return self._commit((*self.segments, name) if keep else (name,), self.n_docs * keep + size[0], self.total * keep + total, self.corpus_bytes * keep + size[1])

    def _commit(self, segments: tuple[str, ...], n_docs: int, total: int, corpus_bytes: int) -> Bm25Index:
        """Appends a version; a reader sees it whole or not at all."""
        new = Bm25Index(self.spark, self.path, self.version + 1, segments, n_docs, total, 0, 0.0, corpus_bytes)
        found = new.frequencies().agg(F.count("*"), F.coalesce(F.avg("raw"), F.lit(0.0))).first()
        row = (new.version, list(segments), n_docs, total, found[0], found[1], corpus_bytes)
        self.spark.createDataFrame([row], VERSION).coalesce(1).write.mode("overwrite" if self.version < 0 else "append").parquet(f"{self.path}/versions")
        return Bm25Index.open(self.spark, self.path)

    def frequencies(self) -> DataFrame:
        """(term, df, raw): documents of each term, and its log odds."""
        df = self.postings().groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        return df.withColumn("raw", F.log(self.n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))

    def average(self) -> float:
        return self.total / self.n_docs if self.total else 1.0


# --------------------------------------------------------------------- search
def holds(terms: list[str]) -> Column:
    """term is one of these.  For the Parquet pages also as at most INTERVALS intervals, in a balanced tree: a longer list of values isn't pushed down, and a chain of them is too deep."""
    terms = sorted(terms)
    if not terms:
        return F.lit(False)
    size = -(-len(terms) // INTERVALS)
    parts = [F.col("term").between(terms[i], terms[min(i + size, len(terms)) - 1]) for i in range(0, len(terms), size)]
    while len(parts) > 1:
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] & F.col("term").isin(terms)


@dataclass
class Asked:
    """A block of queries: for each term, the numbers of the queries that have it and their weights."""

    ids: np.ndarray
    terms: dict[str, tuple[np.ndarray, np.ndarray]]
    okapi: Okapi
    average: float

    def weight(self, tf, dl):
        return tf * (self.okapi.k1 + 1) / (tf + self.okapi.k1 * (1 - self.okapi.b + self.okapi.b * dl / self.average))

    def add(self, score: np.ndarray, hit: np.ndarray | None, row: tuple, lengths: np.ndarray) -> None:
        """A block's part of the scores."""
        found = self.terms.get(row[0])
        if found is None:
            return
        queries, g = found
        places, counts = unpacked(row[2], row[1])
        at = np.ix_(queries, places)
        score[at] += g[:, None] * self.weight(counts, lengths[places])
        if hit is not None:
            hit[at] = True

    def only(self, chosen: dict[str, np.ndarray]) -> Asked:
        """The same with a term kept for the chosen of its queries."""
        return Asked(self.ids, {t: (self.terms[t][0][m], self.terms[t][1][m]) for t, m in chosen.items() if m.any()}, self.okapi, self.average)


def of_kind(t: pa.Table, kind: int, *columns: str) -> list[tuple]:
    m = t.column("kind").to_numpy() == kind
    part = t.filter(pa.array(m))
    return list(zip(*(part.column(c).to_pylist() for c in columns), strict=True))


def best_rows(asked: Asked, ids: np.ndarray, score: np.ndarray, hit: np.ndarray, k: int) -> pa.Table:
    q, d = np.nonzero(hit)
    order = np.lexsort((ids[d], -np.round(score[q, d], 9), q))
    q, d = q[order], d[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, d = q[best], d[best]
    return pa.table([pa.array(asked.ids[q]), pa.array(ids[d]), pa.array(score[q, d])], names=["query_id", "doc_id", "score"])


HITS = "query_id long, doc_id long, score double"


def _first_scores(asked: Asked, k: int):
    """Each range's best k by the terms of `asked` alone."""

    def run(t: pa.Table) -> pa.Table:
        (n, body), *_ = of_kind(t, DOCS, "n", "body")
        ids, lengths = unpacked_docs(body, n)
        score, hit = np.zeros((len(asked.ids), n)), np.zeros((len(asked.ids), n), bool)
        for row in of_kind(t, POSTINGS, "term", "n", "body"):
            asked.add(score, hit, row, lengths)
        return best_rows(asked, ids, score, hit, k)

    return run


def _candidates(essential: Asked, rest: Asked, threshold: np.ndarray):
    """A range's documents that may be among the best, with their scores so far, and the blocks of the other terms that hold any."""

    def run(t: pa.Table) -> pa.Table:
        (number, n, body), *_ = of_kind(t, DOCS, "range", "n", "body")
        lengths = unpacked_docs(body, n)[1]
        score, hit = np.zeros((len(essential.ids), n)), np.zeros((len(essential.ids), n), bool)
        for row in of_kind(t, POSTINGS, "term", "n", "body"):
            essential.add(score, hit, row, lengths)
        most = score.copy()
        bounds = [b for b in of_kind(t, BOUNDS, "term", "part", "first", "last", "top_tf", "least_dl") if b[0] in rest.terms]
        for term, _, first, last, tf, dl in bounds:
            queries, g = rest.terms[term]
            most[queries, first : last + 1] += np.maximum(g, 0)[:, None] * rest.weight(tf, dl)
        hit &= most >= threshold[:, None] - SLACK
        q, d = np.nonzero(hit)
        if not len(q):
            return pa.Table.from_batches([batch([])])
        rows = [(number, CANDIDATES, None, 0, len(q), 0, 0, 0, 0, q.astype("<i4").tobytes() + d.astype("<i4").tobytes() + score[q, d].astype("<f8").tobytes())]
        for term, part, first, last, _, _ in bounds:
            if hit[rest.terms[term][0], first : last + 1].any():
                rows.append((number, NEEDED, term, part, 0, 0, 0, 0, 0, None))
        return pa.Table.from_batches([batch(rows)])

    return run


def _final_scores(rest: Asked, k: int):
    """Each range's best k among its candidates, by all terms."""

    def run(t: pa.Table) -> pa.Table:
        found = of_kind(t, CANDIDATES, "n", "body")
        (n, body), *_ = of_kind(t, DOCS, "n", "body")
        ids, lengths = unpacked_docs(body, n)
        score, hit = np.zeros((len(rest.ids), n)), np.zeros((len(rest.ids), n), bool)
        for m, raw in found:
            q, d = np.frombuffer(raw, "<i4", m), np.frombuffer(raw, "<i4", m, 4 * m)
            score[q, d], hit[q, d] = np.frombuffer(raw, "<f8", m, 8 * m), True
        for row in of_kind(t, POSTINGS, "term", "n", "body"):
            rest.add(score, None, row, lengths)
        return best_rows(rest, ids, score, hit, k)

    return run


def _choose(asked: Asked, df: dict[str, int], most: dict[str, float], k: int, threshold: np.ndarray | None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """For each term, which of its queries get documents from it, and which don't.

    Without thresholds: the rarest terms up to FIRST_POSTINGS * k postings.
    With them: all but the terms whose bounds together stay below.
    """
    of_query: dict[int, list[tuple]] = {}
    for t, (queries, g) in asked.terms.items():
        for i, (q, w) in enumerate(zip(queries.tolist(), g.tolist(), strict=True)):
            of_query.setdefault(q, []).append((max(w, 0.0) * most[t], df[t], t, i))
    yes = {t: np.zeros(len(q), bool) for t, (q, _) in asked.terms.items()}
    for q, terms in of_query.items():
        if threshold is None:
            terms.sort(key=lambda x: (x[1], x[2]))
            seen = 0
            for _, n, t, i in terms:
                if seen >= FIRST_POSTINGS * k:
                    break
                yes[t][i] = True
                seen += n
        else:
            terms.sort()
            total = 0.0
            for bound, _, t, i in terms:
                total += bound
                yes[t][i] = total >= threshold[q] - SLACK
    return yes, {t: ~m for t, m in yes.items()}


def _search_block(index: Bm25Index, queries: pa.Table, k: int, okapi: Okapi, reads: list[DataFrame]) -> DataFrame | None:
    """(query_id, doc_id, score) of a block of queries, written; None without hits."""
    here = holds(list(set(queries.column("term").to_pylist())))
    average = index.average()
    plain = Asked(np.zeros(0), {}, okapi, average)
    bound = F.max(F.col("top_tf") * (okapi.k1 + 1) / (F.col("top_tf") + okapi.k1 * (1 - okapi.b + okapi.b * F.col("least_dl") / average)))
    known = {r.term: (r.df, r.most) for r in index.postings().where(here).groupBy("term").agg(F.sum("n").alias("df"), bound.alias("most")).collect()}
    ids, at = np.unique(queries.column("query_id").to_numpy(), return_inverse=True)
    terms: dict[str, tuple[list[int], list[float]]] = {}
    for q, t, qtf in zip(at.tolist(), queries.column("term").to_pylist(), queries.column("qtf").to_pylist(), strict=True):
        if t in known:
            raw = float(np.log(index.n_docs - known[t][0] + 0.5) - np.log(known[t][0] + 0.5))
            both = terms.setdefault(t, ([], []))
            both[0].append(q)
            both[1].append(qtf * (raw if raw >= 0 else okapi.epsilon * index.mean_raw))
    if not terms:
        return None
    asked = Asked(ids, {t: (np.array(q), np.array(g)) for t, (q, g) in terms.items()}, plain.okapi, average)
    df, most = ({t: known[t][i] for t in terms} for i in (0, 1))
    lists = lambda a: index.postings().where(holds(list(a.terms)))

    yes, no = _choose(asked, df, most, k, None)
    first, rest = asked.only(yes), asked.only(no)
    low = np.zeros(len(ids))  # what the other terms may take away
    for q, g in rest.terms.values():
        low[q] += np.minimum(g, 0) * (okapi.k1 + 1)
    tried = index.docs().unionByName(lists(first)).groupBy("range").applyInArrow(_first_scores(first, k), HITS)
    kth = top_k(tried, k).where(F.col("rank") == k).select("query_id", "score").collect()
    threshold = np.full(len(ids), -np.inf)
    for q, s in kth:
        i = int(np.searchsorted(ids, q))
        threshold[i] = s + low[i]

    yes, no = _choose(asked, df, most, k, threshold)
    essential, rest = asked.only(yes), asked.only(no)
    bounds = index.postings().where(holds(list(rest.terms))).select(*[F.lit(BOUNDS).alias(c) if c == "kind" else F.lit(None).cast("binary").alias(c) if c == "body" else c for c in NAMES])
    found = written(index.docs().unionByName(lists(essential)).unionByName(bounds).groupBy("range").applyInArrow(_candidates(essential, rest, threshold), ROW), "candidates")
    kept = found.where(F.col("kind") == CANDIDATES)
    needed = found.where(F.col("kind") == NEEDED).select("range", "term", "part")
    more = lists(rest).join(needed, ["range", "term", "part"], "left_semi").select(*NAMES)
    docs = index.docs().join(kept.select("range").distinct(), "range", "left_semi").select(*NAMES)
    scored = docs.unionByName(kept).unionByName(more).groupBy("range").applyInArrow(_final_scores(rest, k), HITS)
    reads.append(lists(first).unionByName(lists(essential)).unionByName(more).agg(F.sum(F.length("body")).alias("bytes"), F.count("*").alias("blocks")))
    return written(top_k(scored, k).select("query_id", "doc_id", "score"), "hits")


def search(index: Bm25Index, queries: DataFrame, k: int = 10, okapi: Okapi = Okapi(), reads: list[DataFrame] | None = None) -> DataFrame:
    """The k best documents for each query of (query_id, query); whole-number ids.  reads: gets what each block of queries read of the postings.

    The queries are a stated set; BLOCK_QUERIES of them at a time pass through the driver.
    """
    spark, reads = index.spark, [] if reads is None else reads
    terms = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(T.tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    blocks = -(-queries.select("query_id").distinct().count() // BLOCK_QUERIES)
    out = spark.createDataFrame([], HITS)
    for i in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if len(rows):
            found = _search_block(index, rows, k, okapi, reads)
            out = out if found is None else out.unionByName(found)
    return top_k(out, k).select("query_id", "rank", "doc_id", "score")


def reading(index: Bm25Index, reads: list[DataFrame]) -> DataFrame:
    """One row: the index's blocks, those that a search read (a block twice counts twice), their bytes, and these as a share of the corpus' bytes."""
    with_bytes = reads[0]
    for r in reads[1:]:
        with_bytes = with_bytes.unionByName(r)
    all_blocks = index.postings().agg(F.count("*").alias("index_blocks"))
    total = with_bytes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("read_bytes"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("read_blocks"))
    return all_blocks.crossJoin(total).withColumn("share", F.round(F.col("read_bytes") / max(index.corpus_bytes, 1), 4))
