"""Golden values of text functions and metrics."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.rouge import lcs, rouge_l, stem


def one(spark, *values, f):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_normalised(spark):
    assert one(spark, "The Quick, Brown Fox!", f=T.normalised) == "quick brown fox"
    assert one(spark, "the cat and a dog", f=T.normalised) == "cat and dog"


def test_exact_match_and_f1(spark):
    assert one(spark, "the Eiffel Tower", "Eiffel Tower", f=T.exact_match) == 1
    assert one(spark, "", "", f=T.exact_match) == 1
    assert one(spark, "capital of France", "Paris is the capital of France", f=T.token_f1) == pytest.approx(0.75)
    assert one(spark, "Paris Paris", "Paris", f=T.token_f1) == pytest.approx(2 / 3)
    assert one(spark, "", "x", f=T.token_f1) == one(spark, None, None, f=T.token_f1) == 0


def test_tokens_and_estimate(spark):
    assert one(spark, "Python is Great!", f=T.tokens) == ["python", "is", "great!"]
    assert one(spark, "hello world foo", f=T.token_estimate) == 3
    assert one(spark, "", f=T.token_estimate) == 1


def test_rouge(spark):
    assert lcs("a b c d".split(), "b x d".split()) == 2
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "the", "adjustable", "probate")] == ["caress", "poni", "relat", "hop", "agre", "the", "adjust", "probat"]
    assert one(spark, "the cats sat", "the cat sits", f=lambda a, b: rouge_l(a, b)) == pytest.approx(2 / 3)
    assert one(spark, "the cats sat", "the cat sits", f=lambda a, b: rouge_l(a, b, stemmed=False)) == pytest.approx(1 / 3)
    assert one(spark, "", "x", f=lambda a, b: rouge_l(a, b)) == 0


def test_clean_answer(spark):
    assert one(spark, "  Answer: Paris is the capital.\n\nQuestion: more", f=T.clean_answer) == "Paris is the capital."
    assert one(spark, "Paris. Note: I think so", f=T.clean_answer) == "Paris."
    assert one(spark, "Go. Go. Paris", f=T.clean_answer) == "Go. Paris."
    assert one(spark, "one two three four no", f=T.clean_answer) == "one two three four"
    assert one(spark, None, f=T.clean_answer) == ""


def test_clean_rewrite(spark):
    assert one(spark, 'Improved query: "where is it? or else"\nbecause', "q", f=T.clean_rewrite) == "where is it?"
    assert one(spark, "", "the query", f=T.clean_rewrite) == "the query"
    assert one(spark, "who? Human: x", "q", f=T.clean_rewrite) == "who?"
    assert one(spark, "find " + "word " * 40, "q", f=T.clean_rewrite) == ("find " + "word " * 40)[:60].rsplit(" ", 1)[0]
    assert one(spark, "```sql abc", "q", f=T.clean_rewrite) == "abc"


def test_grades(spark):
    ask = lambda r: one(spark, r, f=lambda c: T.grades(c, F.lit(2)))
    assert ask('{"grades": [true, false]}') == [True, False]
    assert ask('Well {"grades": [false, false]} there') == [False, False]
    assert ask("True, then FALSE") == [True, False]
    assert ask('{"grades": [true]}') == [True, True]
    assert ask("?") == [True, True]
    assert one(spark, "no", f=T.yes_no) is False
    assert one(spark, "I know: yes", f=T.yes_no) is True
    assert one(spark, '{"relevant": true, "confidence": 0.5}', f=T.confident_relevance) is False


def test_prompt_parts(spark):
    docs = F.split(F.lit("a|b|c"), r"\|")
    row = spark.range(1).select(T.context_block(docs, 2).alias("c"), T.numbered(docs, 5).alias("n"), T.fill_template("{a}-{b}", a=F.lit("x"), b=F.lit("y")).alias("t"), T.highlighted(F.lit("Paris that city"), F.lit("paris that")).alias("h"), T.preview(F.lit("abcdef"), 3).alias("p")).first()
    assert (row.c, row.n, row.t, row.h, row.p) == ("[1] a\n\n[2] b", "1. a\n2. b\n3. c", "x-y", "<mark>Paris</mark> that city", "abc...")


@pytest.mark.parametrize(("k", "band"), [(-0.1, "none"), (0.1, "slight"), (0.3, "fair"), (0.5, "moderate"), (0.7, "substantial"), (0.9, "almost perfect")])
def test_kappa_bands(spark, k, band):
    assert spark.range(1).select(T.kappa_band(F.lit(k)).alias("b")).first().b == band
