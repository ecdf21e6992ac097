"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte 2- to 4-grams (A-Z lower-cased, digits and
ASCII signs dropped to one mark), hashed into buckets; the document vector is
the average of the buckets' embeddings and a softmax layer scores languages.
Embeddings and layer are trained together by stochastic gradient descent in
numpy on at most `sample` labelled rows a language, and MOST_ROWS in all or one a
language where there are more languages than that (documented bounds; the rows
are those with the least hash of their text, each text once a language, so the
choice is random and repeatable).  Rows are sparse; only a batch is dense.
As the layer is linear, prediction averages one small row a bucket, embedding
times layer, over the whole text; every document is read whole.

Calibration on rows held back from training: a temperature for the softmax,
then the rejection threshold, the score below which at most `reject_share` of
rightly labelled rows fall (never above `most_threshold`).

Defined results: a null text, or one without a letter, is `und` with score 0;
with no labelled row at all every document is `und`; of equally likely languages
the first by name is predicted; repeated rows get equal results; only text is
read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_name, trim, widened

BUCKET_BITS = 14
ORDERS = (2, 3, 4)
UNKNOWN = "und"
MOST_ROWS = 8000


def fold_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


def gram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte, up to len(data) - order."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint32)
    for i in range(order):
        key = (key << np.uint32(8)) | data[i : i + n]
    with np.errstate(over="ignore"):
        return ((key * np.uint32(2654435761) + np.uint32(order * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # bucket, language: embedding times layer
    bias: np.ndarray
    scale: float  # 1 / temperature
    threshold: float


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def row_scores(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The average of rows over every text's n-grams; a text ends with one mark, so short ones have n-grams too."""
    n = len(offsets) - 1
    size = np.diff(offsets) + 2
    at = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(at[-1], 32, dtype=np.uint8)
    own = np.ones(len(padded), dtype=bool)
    own[at[:-1]] = own[at[1:] - 1] = False
    padded[own] = fold_bytes()[data]
    total, count = np.zeros((n, rows.shape[1])), np.zeros(n)
    for order in ORDERS:
        g = gram_buckets(padded, order)
        v = rows[g]
        v = np.concatenate([v, np.zeros((len(padded) - len(g), rows.shape[1]), dtype=rows.dtype)])
        for r in range(1, order):  # n-grams that reach into the next text don't count
            edge = at[1:] - r
            v[edge[edge >= 0]] = 0
        total += np.add.reduceat(v, at[:-1], axis=0, dtype=np.float64)
        count += np.maximum(size - order + 1, 0)
    return total / np.maximum(count, 1)[:, None]


@dataclass
class Rows:
    """Sparse rows: row i has buckets idx[begin[i] : begin[i + 1]] with shares num there."""

    idx: np.ndarray
    num: np.ndarray
    begin: np.ndarray

    def block(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that some rows have, and those rows over them, dense."""
        size = self.begin[rows + 1] - self.begin[rows]
        at = np.repeat(self.begin[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        used, column = np.unique(self.idx[at], return_inverse=True)
        out = np.zeros((len(rows), len(used)), dtype=np.float32)
        out[np.repeat(np.arange(len(rows)), size), column] = self.num[at]
        return used, out


def sample_counts(labelled: DataFrame, label: str, sample: int) -> tuple[list[str], np.ndarray, Rows, np.ndarray]:
    """(languages, label of each row, share of each bucket in it, hold-out flag): n-grams are counted on executors; a text counts once a label."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(label).orderBy("h"))
    keyed = labelled.select(label, "text", F.xxhash64("text").alias("h"))
    rough = keyed.groupBy(label).agg(F.approx_count_distinct("h").alias("n")).select(label, "n")
    # hash below a bound that keeps about twice the sample, before the exact rank: the rank's groups stay small
    near = keyed.join(F.broadcast(rough), label).where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= 2.0 * sample / F.col("n") + 1e-4)
    picked = near.groupBy(label, "h").agg(F.first("text").alias("text")).withColumn("r", rank).where(F.col("r") <= sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = fold_bytes()
        for b in batches:
            idx, num = [], []
            for c in chunks(b.column("text")):
                for i in range(c.n):
                    d = np.concatenate([[32], fold[c.data[c.offsets[i] : c.offsets[i + 1]]], [32]]).astype(np.uint8)
                    u, k = np.unique(np.concatenate([gram_buckets(d, o) for o in ORDERS]), return_counts=True)
                    idx.append(u.astype(np.int16))
                    num.append((k / k.sum()).astype(np.float32))
            if idx:
                yield pa.RecordBatch.from_arrays([b.column(label), b.column("h"), pa.array(idx, pa.list_(pa.int16())), pa.array(num, pa.list_(pa.float32()))], names=["y", "h", "idx", "num"])

    rows = picked.select(label, "h", "text").mapInArrow(count, "y string, h long, idx array<smallint>, num array<float>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y = rows.column("y").to_pylist()
    langs = sorted(set(y))
    idx, num = (rows.column(n).combine_chunks() for n in ("idx", "num"))
    begin = np.concatenate([[0], np.cumsum([len(a) for a in idx])]).astype(np.int64)
    x = Rows(idx.flatten().to_numpy(zero_copy_only=False), num.flatten().to_numpy(zero_copy_only=False), begin)
    return langs, np.array([langs.index(v) for v in y], dtype=np.int64), x, np.arange(len(y)) % 5 == 0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(langs: list[str], y: np.ndarray, x: Rows, held: np.ndarray, dim: int = 16, epochs: int = 30, rate: float = 2.0, batch: int = 64, reject_share: float = 0.002, most_threshold: float = 0.5, seed: int = 42) -> Model:
    """Embeddings and layer by SGD, then temperature and threshold on the rows held back."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (dim, k)).astype(np.float32), np.zeros(k, dtype=np.float32)
    fit = np.flatnonzero(~held)
    weight = np.bincount(y[fit], minlength=k).astype(float)
    weight = (len(fit) / np.maximum(weight, 1) / k)[y]  # languages count alike
    for e in range(epochs):
        rng.shuffle(fit)
        step = rate * (1 - e / epochs)
        for a in range(0, len(fit), batch):
            rows = fit[a : a + batch]
            used, xb = x.block(rows)
            h = xb @ emb[used]
            g = softmax(h @ layer + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= weight[rows][:, None] / len(rows)
            back = g @ layer.T
            layer -= (step * (h.T @ g)).astype(np.float32)
            bias -= (0.1 * step * g.sum(axis=0)).astype(np.float32)
            emb[used] -= (step * 20 * (xb.T @ back)).astype(np.float32)
    table = (emb @ layer).astype(np.float32)
    val = np.flatnonzero(held) if held.any() else fit
    z = np.zeros((len(val), k))
    for a in range(0, len(val), batch):
        used, xb = x.block(val[a : a + batch])
        z[a : a + batch] = xb @ table[used] + bias
    scales = np.geomspace(0.1, 20, 60)
    loss = [-np.log(softmax(z * s)[np.arange(len(val)), y[val]] + 1e-12).mean() for s in scales] if len(val) else [0.0]
    scale = float(scales[int(np.argmin(loss))])
    p = softmax(z * scale)
    right = p.max(axis=1)[p.argmax(axis=1) == y[val]]
    threshold = min(most_threshold, float(np.quantile(right, reject_share))) if len(right) else most_threshold
    return Model(langs, table, bias, scale, threshold)


def training_rows(docs: DataFrame) -> Column:
    """Rows to learn from: labelled, with a letter, and not in the fold crc32(doc_id as text) mod 4 = 2."""
    return F.col("lang").isNotNull() & has_letter(F.col("text")) & ~F.coalesce(held_out(), F.lit(False))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, sample: int = 500) -> Model | None:
    labelled = docs.where(training_rows(docs)).select("lang", "text")
    kinds = labelled.select("lang").distinct().count()
    langs, y, x, held = sample_counts(labelled, "lang", max(1, min(sample, MOST_ROWS // max(1, kinds))))
    model = train(langs, y, x, held) if langs else None
    del y, x, held
    trim()  # the driver goes on to other work
    return model


def predict(docs: DataFrame, model: Model | None, lang_col: str, score_col: str) -> DataFrame:
    """docs with the predicted language and its score in two more columns."""
    fields = [f.name for f in docs.schema.fields]
    if model is None:
        return docs.withColumns({lang_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    names = np.array(model.languages, dtype=object)
    table, bias, scale = model.rows, model.bias, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for b in batches:
            text = b.column("text")
            lang, score = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows)
            for c in chunks(text):
                p = softmax((row_scores(c.data, c.offsets, table) + bias) * scale)
                at = slice(c.first, c.first + c.n)
                best = p.argmax(axis=1)
                lang[at], score[at] = names[best], p[np.arange(c.n), best]
            for i, t in enumerate(text):
                t = t.as_py()
                if t is None or not letter.search(t):
                    lang[i], score[i] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in fields), pa.array(lang, pa.string()), pa.array(np.round(score, 6))], names=[*fields, lang_col, score_col])
        trim()

    return docs.mapInArrow(run, widened(docs, **{lang_col: "string", score_col: "double"}))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and whether the calibrated threshold rejects the prediction."""
    model = fit(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < (model.threshold if model else 0.0))
    return predict(slim, model, "lang_pred", "score").select("doc_id", "held_out", "lang_pred", "score", rejected.alias("rejected"))


def known_languages(docs: DataFrame, sample: int = 500) -> DataFrame:
    """docs without the rows whose language is rejected; the columns of docs."""
    model = fit(docs, sample)
    lang, score = free_name(docs.columns, "li_lang"), free_name(docs.columns, "li_score")
    least = model.threshold if model else 0.0
    return predict(docs, model, lang, score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)


