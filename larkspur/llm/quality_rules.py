"""Quality rules by weak supervision.

Rules vote good (+1), bad (-1) or abstain (0) on each document.  Votes are
counted by pattern over all documents (at most 3^rules patterns, so the counts
and the model are small whatever the input), and expectation-maximisation on
those counts estimates each rule's accuracy and the share of good documents.
The posterior probability that a document is good replaces all-must-pass
filtering: a document that a weak rule votes against stays if others speak for it.

The rules hold for any script and language.  None has a word list: what words
are common is counted in the corpus itself (documents by hashed word, in a sketch
of `SLOTS` counters; a word of `COMMON_SHARE` of the documents, and of two, is
common).  Repeated windows and repeated lines rise and fall together and are one
rule, as the model takes rules to be independent within a class.  Letters are Unicode's letters and marks.  Where a third of a text or more is of a script without spaces between words,
the rules on words abstain.

Defined results: a null text has no words; every row gets its own verdict;
repeated rows get equal ones; a posterior of exactly the threshold is kept;
without documents there is nothing to fit and no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SpanHasher, chunks, counters, line_spans, mix, word_spans, written

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_letters long, n_unspaced long, n_common long, n_lines long, n_distinct long"
#: The symbols counted, and the blocks of scripts written without spaces between words (Thai to Burmese, Khmer, kana, Han).
SYMBOLS = b"#*$%&|<>"
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


SLOTS = 1 << 20
COMMON_SHARE = 0.02


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def common_words(docs: DataFrame) -> np.ndarray:
    """Which slots of hashed words (A-Z lower-cased) are common."""

    def of(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        hasher = SpanHasher()
        for c in chunks(b.column("text")):
            starts, ends, first = word_spans(c)
            low = hasher.spans(LOWER[c.data], starts, ends)
            yield slots(low[~_not_first(low, np.repeat(np.arange(c.n), np.diff(first)))])

    least = max(2, -(-docs.count() * COMMON_SHARE // 1))
    return np.packbits(counters(docs.select("text"), of, SLOTS) >= least)


@cache
def code_point_kinds() -> np.ndarray:
    """By code point: 1 a letter or mark, 3 one of a script without spaces, 0 other."""
    out = np.fromiter((category(chr(i))[0] in "LM" for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    for a, b in UNSPACED:
        out[a : b + 1] *= 3
    return out


def repeated_in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries have an equal h in the same row."""
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    same = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
    hit = np.zeros(len(h), dtype=bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return hit


def text_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """COUNTS of every row: the base counts and what the rules vote on."""
    bits = common_words(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        symbol = np.zeros(256, dtype=np.int64)
        symbol[list(SYMBOLS)] = 1
        lead = np.ones(256, dtype=np.int64)
        lead[0x80:0xC0] = 0
        kinds, common = code_point_kinds(), np.unpackbits(bits)

        def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[bounds[1:]] - total[bounds[:-1]]

        for b in batches:
            doc = b.column("doc_id")
            for c in chunks(b.column("text")):
                starts, ends, first = word_spans(c)
                n = np.diff(first)
                row = np.repeat(np.arange(c.n), n)
                chars = np.concatenate([[0], np.cumsum(lead[c.data])])
                word_chars = per_row(chars[ends] - chars[starts], first)
                exact = hasher.spans(c.data, starts, ends)
                low = hasher.spans(LOWER[c.data], starts, ends)
                kind = kinds[np.frombuffer(c.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
                places = chars[c.offsets]
                # words in windows found twice or more
                cover = np.zeros(len(exact) + 1, dtype=np.int64)
                whole = np.flatnonzero(np.arange(len(exact)) + window <= first[1:][row]) if len(row) else row
                if len(whole):
                    with np.errstate(over="ignore"):
                        g = np.zeros(len(whole), dtype=np.uint64)
                        for i in range(window):
                            g += exact[whole + i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
                    twice = whole[repeated_in_row(mix(g), row[whole])]
                    cover[twice] += 1
                    cover -= np.bincount(twice + window, minlength=len(cover))
                    cover = np.cumsum(cover)
                repeat = per_row((cover[:-1] > 0).astype(np.int64), first)
                distinct = n - per_row(_not_first(low, row).astype(np.int64), first)
                # lines with a word, equal to an earlier one of the same text
                ls, le, lf = line_spans(c)
                solid = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
                lrow = np.repeat(np.arange(c.n), np.diff(lf))
                lh = hasher.spans(c.data, ls[solid], le[solid])
                dup = np.bincount(lrow[solid][_not_first(lh, lrow[solid])], minlength=c.n)
                cols = [n, word_chars, per_row(symbol[c.data], c.offsets), dup, repeat, per_row((kind > 0).astype(np.int64), places), per_row((kind == 3).astype(np.int64), places), per_row(common[slots(low)].astype(np.int64), first), np.bincount(lrow[solid], minlength=c.n), distinct]
                yield pa.RecordBatch.from_arrays([doc.slice(c.first, c.n), *(pa.array(x.astype(np.int64)) for x in cols)], names=[x.split()[0] for x in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def _not_first(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries have an equal h earlier in the same row."""
    order = np.lexsort((np.arange(len(h)), h, row))
    out = np.zeros(len(h), dtype=bool)
    out[order[1:]] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return out


def rule_votes() -> dict[str, F.Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains: between its two bounds, and where a text is too short for its measure."""

    def vote(good, bad, ok):
        return F.when(ok, F.when(bad, -1).when(good, 1).otherwise(0)).otherwise(0)

    n, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars"))
    mean, symbols, letters = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_letters") / chars
    repeats, dups = F.col("n_repeat_words") / n, F.when(F.col("n_lines") >= 3, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0)
    spaced = F.col("n_unspaced") * 3 < F.col("word_chars")
    distinct, commons, size = F.col("n_distinct") / n, F.col("n_common") / n, F.col("n_words")
    return {
        "length": vote(size >= 50, size < 20, spaced),
        "mean_word": vote(mean.between(3, 7), (mean < 2.5) | (mean > 10), spaced & (size >= 10)),
        "letters": vote(letters >= 0.93, (letters < 0.9) & (size >= 100) | (letters < 0.75) & (size >= 30), F.lit(True)),
        "symbols": vote(symbols <= 0.02, symbols > 0.1, spaced),
        "repetition": vote((repeats <= 0.05) & (dups <= 0.1), (repeats > 0.1) | (dups > 0.3), size >= 30),
        "vocabulary": vote(commons >= 0.35, (commons < 0.25) & (commons > 0.02), spaced & (size >= 30)),
        "recurrence": vote(distinct.between(0.4, 0.9), (distinct > 0.97) | (distinct < 0.3), spaced & (size >= 100)),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Rules' log-odds weights [rule, vote + 1] and the log-odds of a good document, by EM.

    For either class a rule has a probability of voting good, given that it
    votes; that it abstains says nothing (its weight is 0).  Both are free, but
    that a rule is no worse than chance: it votes good no less often on good
    texts than on bad ones.  Three rules or more that are independent within a
    class identify them; what names the classes is that good documents are the
    ones with more good votes.  One imaginary vote a rule keeps the
    probabilities off 0 and 1, and is where they begin.
    """
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    start = np.stack([np.full(votes.shape[1], x) for x in (0.4, 0.9)])  # class, rule: of a good vote
    theta, share = start, 0.9

    def odds() -> tuple[np.ndarray, np.ndarray]:
        return np.log(theta[1] / theta[0]), np.log((1 - theta[1]) / (1 - theta[0]))

    for _ in range(steps):
        good, bad = odds()
        p = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + up @ good + down @ bad)))
        new = np.stack([((counts * w) @ up + start[c]) / ((counts * w) @ (up + down) + 1) for c, w in ((0, 1 - p), (1, p))])
        new = np.stack([np.minimum(new[0], new[1]), new[1]])
        moved = np.abs(new - theta).max()
        theta, share = new, float(((counts * p).sum() + 0.9) / (counts.sum() + 1))
        if moved < 1e-9:
            break
    good, bad = odds()
    return np.stack([bad, np.zeros_like(good), good], axis=1), float(np.log(share / (1 - share)))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """COUNTS with votes, posterior (of being good), base_failed and kept for every row."""
    rules = rule_votes()
    counted = written(text_counts(docs), "quality")
    voted = counted.withColumns({f"vote_{k}": v.cast("int") for k, v in rules.items()})
    names = [f"vote_{k}" for k in rules]
    patterns = voted.groupBy(*names).count().collect()  # at most 3^rules rows
    table = np.array([[r[x] for x in names] for r in patterns], dtype=int).reshape(-1, len(names))
    weights, bias = fit_votes(table, np.array([r["count"] for r in patterns], dtype=float))
    logit = F.lit(bias)
    for k, w in zip(names, weights, strict=True):
        logit = logit + F.when(F.col(k) < 0, float(w[0])).when(F.col(k) == 0, float(w[1])).otherwise(float(w[2]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumns({"posterior": 1 / (1 + F.exp(-logit)), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def quality_report(docs: DataFrame) -> DataFrame:
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
