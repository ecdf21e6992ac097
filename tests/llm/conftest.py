import pytest

TEXTS = [
    "the cat sat on the mat and looked at the dog",
    None,
    "",
    "   ",
    "one",
    "one two",
    "the cat sat on the mat and looked at the dog",
    "the cat sat on the mat and looked at the cow",
    "\n\n",
    "x " * 3000,
    "été à la plage 　 avec des amis\net du soleil",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 0, "k", 1.5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 0, "k", 1.5), (None, "a b c d", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
