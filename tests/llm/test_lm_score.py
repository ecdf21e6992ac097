import math
import random
import re
from collections import Counter

from larkspur.llm import lm_score as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    docs = [WORD.findall((t or "").translate(AZ)) for _, t in rows]
    c1 = Counter(w for d in docs for w in d)
    total = sum(c1.values())
    marked = [[None, *d] for d in docs]
    c1[None] = sum(1 for d in docs if d)
    c2 = Counter((d[i - 1], d[i]) for d in marked for i in range(1, len(d)))
    c3 = Counter((d[i - 2], d[i - 1], d[i]) for d in marked for i in range(2, len(d)))

    def two(u, w):
        return c2[u, w] / c1[u] if c2[u, w] >= 2 else 0.4 * c1[w] / total

    out = []
    for (i, _), d in zip(rows, marked, strict=True):
        s = 0.0
        for j in range(1, len(d)):
            if j >= 2 and c3[d[j - 2], d[j - 1], d[j]] >= 2:
                s += math.log(c3[d[j - 2], d[j - 1], d[j]] / c2[d[j - 2], d[j - 1]])
            else:
                s += math.log((0.4 if j >= 2 else 1.0) * two(d[j - 1], d[j]))
        n = len(d) - 1
        out.append((i, n, round(s, 3), round(s / n, 4) if n else None))
    return sorted(out, key=str)


def check(got, want):
    got = sorted(((r.doc_id, r.n_tokens, round(r.logprob, 3), None if r.score is None else round(r.score, 4)) for r in got), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 0.01 and (g[3] is None) == (w[3] is None) for g, w in zip(got, want, strict=True))


def test_equals_brute_force(spark, monkeypatch, odd_docs):
    monkeypatch.setattr(lm, "FLUSH", 100)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the of And a b c d e".split()) if rng.random() < 0.9 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(40)))) for i in range(80)]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()] + [(500, "the of and " * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(lm.lm_scores(docs).collect(), brute(rows))


def test_no_documents(spark, no_docs):
    assert lm.lm_scores(no_docs).count() == 0


def test_words_seen_nowhere_else_score_lowest(spark):
    rng = random.Random(2)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    prose = [(i, " ".join(lexicon[int(3000 * rng.random() ** 3)] for _ in range(120))) for i in range(400)]
    junk = [(1000 + i, " ".join(f"{rng.random():.12f}" for _ in range(120))) for i in range(20)]
    rows = prose + junk
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, brute(rows))
    assert max(r.score for r in got if r.doc_id >= 1000) < min(r.score for r in got if r.doc_id < 1000)
