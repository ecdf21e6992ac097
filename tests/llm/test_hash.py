"""One hash names spans of bytes everywhere; patterns that defeat polynomial hashes must not make spans meet."""

import numpy as np

from larkspur.llm.common import LONG_SPAN, SpanHasher
from larkspur.llm.line_dedup import line_report
from larkspur.llm.ngram_join import ngram_components
from larkspur.llm.quality_rules import quality_report

FLIP = str.maketrans("ab", "ba")


def thue_morse(n: int) -> str:
    s = "a"
    while len(s) < n:
        s += s.translate(FLIP)
    return s


def hashes(spans: list[bytes]) -> list[int]:
    cut = np.cumsum([0, *map(len, spans)])
    return SpanHasher().spans(np.frombuffer(b"".join(spans), np.uint8), cut[:-1], cut[1:]).tolist()


def test_equal_spans_only():
    rng = np.random.default_rng(0)
    spans = [bytes(rng.integers(0, 4, int(n), dtype=np.uint8)) for n in rng.choice([0, 1, 2, 7, 8, 9, 16, 17, LONG_SPAN, LONG_SPAN + 1, 900], 4000)]
    met = {}
    for s, h in zip(spans, hashes(spans), strict=True):
        assert met.setdefault(h, s) == s
    assert len(met) == len(set(spans))


def test_complements_differ():
    for n in (64, 128, 256, 512, 1024, 2048, 4096):
        s = thue_morse(n)
        assert len(set(hashes([s.encode(), s.translate(FLIP).encode()]))) == 2


def test_operators_tell_complements_apart(spark):
    a = thue_morse(1024)
    b = a.translate(FLIP)
    rows = [(i, a if i < 5 else b) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in line_report(df, 10).collect()} == {0}
    assert {(r.doc_id, r.component_id) for r in ngram_components(df, 3, (90, 100)).collect()} == {(i, 0 if i < 5 else 5) for i in range(10)}
    once = spark.createDataFrame([(0, f"{a}\n{b}"), (1, f"{a}\n{a}")], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality_report(once).collect()} == {0: 0, 1: 1}
