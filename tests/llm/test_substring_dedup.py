import random
from hashlib import sha256

import pytest

from larkspur.llm import substring_dedup as sd


def plain(rows, width):
    """{(doc_id, text): (words, flags)} by comparing every window."""
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60, vocabulary=40):
    """Texts of few words, so that repeats of every length and overlap occur, with shared passages and copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [" ".join(word() for _ in range(r.choice([5, 8, 9, 10, 11, 30]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randrange(12))) for _ in range(r.randrange(6))]
        texts.append(r.choice([" ", "\n", " \t"]).join(parts) if r.random() < 0.9 or not texts else r.choice(texts))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "width"), [(1, 10), (2, 9), (3, 2), (4, 1), (5, 10)])
def test_against_every_window(spark, monkeypatch, seed, width):
    monkeypatch.setattr(sd, "CHUNK", 400)
    monkeypatch.setattr(sd, "RANGE", 900)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in sd.substring_report(df, width).collect()) == plain(rows, width)


def test_few_words_repeat_within_and_between(spark):
    rows = [(1, "a b " * 40), (2, "b a " * 30), (3, "a " * 60), (4, "a " * 59), (5, "c " + "a b " * 24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in sd.substring_report(df, 50).collect()) == plain(rows, 50)


def test_passage_in_a_third_of_all(spark):
    r = random.Random(3)
    hot = " ".join(f"h{k}" for k in range(60))
    rows = [(i, " ".join(f"x{r.randrange(10**6)}" for _ in range(30)) + (" " + hot if i % 3 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {x.doc_id: x.n_removed for x in sd.substring_report(df, 50).collect()} == {i: 60 if i % 3 == 0 and i else 0 for i in range(600)}


def test_maximal_repeats_and_texts(spark):
    hot = " ".join(f"h{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"a b {hot} c", "x", 1.0), (2, f"d {hot}  e\nf", None, 2.0), (3, " no  repeats ", "y", 3.0)], "doc_id long, text string, sd_text string, sd_chunk double")
    assert [tuple(r) for r in sd.repeats(df, 10).collect()] == [(2, 1, 13)]
    out = sd.without_repeats(df, 10)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, f"a b {hot} c", "x", 1.0), (2, "d e f", None, 2.0), (3, " no  repeats ", "y", 3.0)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(i if i is not None else sd.NO_ID, t) for i, t in odd_docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id if r.doc_id is not None else sd.NO_ID, *r[1:]) for r in sd.substring_report(odd_docs, 4).collect())
    assert got == plain(rows, 4)
    assert sd.substring_report(no_docs).count() == 0
    assert sd.without_repeats(odd_docs).count() == odd_docs.count()


def test_very_long_text(spark):
    """A megabyte, once whole in another document and once from its middle on."""
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, long), (2, "start " + long[500_000:]), (3, long)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = len(long[500_000:].split())
    assert got[1] == (150_000, 0) and got[3] == (150_000, 150_000)
    assert got[2] == (cut + 1, cut - (0 if long[499_999] == " " else 1))
