import zlib

from pyspark.sql import functions as F

from larkspur.llm import language_id as li

WORDS = {"en": "the of and to in with that this house water".split(), "de": "der die und zu von mit das haus wasser nicht".split(), "fr": "le la les et de un une maison eau pas".split()}


def labelled(spark, n=240):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = labelled(spark)
    got = li.language_report(docs).join(docs, "doc_id")
    assert {(r.doc_id, r.held_out) for r in got.collect()} == {(i, zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240)}
    share = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert share >= 0.95
    assert li.known_languages(docs).count() >= 0.98 * docs.count()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = li.language_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 8))
    assert all(0 <= r.score <= 1 and r.held_out is not None and (r.rejected or r.lang_pred != "und") for r in rows)
    assert li.language_report(no_docs).count() == 0
    assert li.known_languages(no_docs).columns == no_docs.columns
    assert {r.lang_pred for r in li.language_report(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_scores_do_not_depend_on_neighbours():
    import numpy as np

    rows = np.random.default_rng(0).normal(size=(1 << li.BUCKET_BITS, 2))
    texts = [b"abc", b"", b"the house of water", b"x"]
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    every = li.row_scores(joined, np.cumsum([0, *map(len, texts)]), rows)
    for t, want in zip(texts, every, strict=True):
        assert np.allclose(li.row_scores(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]), rows)[0], want)


def test_copies_of_one_text_fill_no_sample(spark):
    docs = labelled(spark).drop("doc_id").distinct()
    copy = docs.where("lang = 'en'").orderBy(F.xxhash64("text")).limit(1)
    more = docs.unionByName(copy.crossJoin(spark.range(3000)).drop("id"))
    want = [(r.lang, r.n) for r in docs.groupBy("lang").agg(F.least(F.count("*"), F.lit(50)).alias("n")).orderBy("lang").collect()]
    langs, y, x, _ = li.sample_counts(more, "lang", 50)
    assert [(n, int((y == i).sum())) for i, n in enumerate(langs)] == want
    rows = {x.idx[a:b].tobytes() + x.num[a:b].tobytes() for a, b in zip(x.begin[:-1], x.begin[1:], strict=True)}
    assert len(rows) > 0.9 * len(y)


def test_rejected_says_what_the_filter_drops(spark):
    docs = labelled(spark)
    rows = li.language_report(docs.select("doc_id", "text", "lang")).collect()
    kept = {r.doc_id for r in li.known_languages(docs.select("doc_id", "text", "lang")).collect()}
    assert {r.doc_id for r in rows if not r.rejected} == kept
