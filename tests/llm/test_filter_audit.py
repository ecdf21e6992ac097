import random
import re
from itertools import permutations

import pytest

from larkspur.llm import filter_audit as fa


def plain(docs, labels):
    """Every order applied to the rows, one filter after the other."""
    least = -(1 << 63)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = [(d if d is not None else least, t or "", s or "") for d, t, s in docs]
    first = {}
    for d, t, _ in rows:
        first[t] = min(first.get(t, d), d)
    fails = []
    for d, t, _ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails.append({x for x, f in zip("ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), first[t] < d], strict=True) if f})
    out = {}
    for part in {s for *_, s in rows}:
        mine = [i for i, r in enumerate(rows) if r[2] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            live = set(mine)
            for k, x in enumerate(order):
                gone = {i for i in live if x in fails[i]}
                redundant = sum(1 for i in mine if i not in live and x in fails[i])
                live -= gone
                total[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(live), len(gone), redundant, sum(1 for i in mine if fails[i] == {x}), sum(1 for i in gone if rows[i][0] in good), sum(1 for i in gone if rows[i][0] in toxic)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df, labels, **more):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in fa.filter_audit(df, labels, **more).collect()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = []
    for _ in range(120):
        n = r.choice([3, 60, 70])
        t = " ".join(r.choice(["alpha", "Beta", "g#", "DELTA"]) if r.random() < r.choice([0.05, 0.6]) else f"w{r.randrange(900)}" for _ in range(n))
        texts.append(r.choice(texts) if texts and r.random() < 0.4 else t)
    docs = [(i, t, r.choice(["a", "b", "", None])) for i, t in enumerate(texts)] + [(7, texts[7], "a"), (None, texts[9], "b"), (500, None, "a"), (501, "", "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("bits", [64, 1])
def test_against_every_order(spark, rows, bits):
    """One-bit hashes leave unlike texts of one length together, so the whole texts must tell them apart."""
    docs, labels = rows
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    assert audited(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=bits) == plain(docs, labels)


def test_refinement_compares_the_ends_of_long_texts(spark):
    base = "x" * 200_000
    docs = [(1, base + "a"), (2, base + "b"), (3, base + "a"), (4, "y" + base), (5, base + "b"), (6, "é" * 10), (7, "é" * 10), (8, "e" * 20)]
    got = fa.duplicates(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source"))
    assert sorted(r.doc for r in got.collect()) == [3, 5, 7]


def test_singletons_go_early(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)] + [(99, "x" * 7)], "doc_id long, text string").selectExpr("*", "'s' AS source")
    assert sorted(r.doc for r in fa.refined(fa.keyed(docs)).collect()) == [7, 99]


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert audited(odd_docs, none) == plain(docs, [])
    assert fa.filter_audit(no_docs, none).count() == 0
