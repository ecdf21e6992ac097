import math

import pytest

from larkspur.llm import source_mixing as sm


def corpus(spark):
    rows = [(i, "w " * (10 + i % 5), "big" if i % 3 else f"s{i % 9}") for i in range(600)] + [(9000, None, None), (9001, "", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_repetition_limit(spark):
    docs = corpus(spark)
    rows = sm.mixing_report(docs, most_repetition=1.5, blocks=16).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r.epoch)
    assert set(seen) == {r.doc_id for r in docs.collect()}  # nothing is dropped
    assert all(sorted(e) == list(range(len(e))) and len(e) <= 2 for e in seen.values())
    size = {r.doc_id: r.n_tokens for r in rows}
    source = {r.doc_id: r.source for r in docs.collect()}
    total, mixed = {}, {}
    for d, s in source.items():
        total[s] = total.get(s, 0) + size[d]
        mixed[s] = mixed.get(s, 0) + size[d] * len(seen[d])
    assert mixed["big"] == total["big"]
    alpha = 1 - math.log(1.5) / math.log(total["big"] / min(total.values()))
    for s in ("s0", "s3", "s6"):
        want = (total[s] / total["big"]) ** (alpha - 1)
        assert mixed[s] / total[s] == pytest.approx(want, abs=0.12)


def test_epochs_are_block_permutations(spark):
    docs = corpus(spark)
    rows = sm.mixing_report(docs, most_repetition=3.0, blocks=8).collect()
    size, by, orders = {}, {}, {}
    for r in rows:
        if r.epoch == 0:
            size[r.source, r.block] = size.get((r.source, r.block), 0) + r.n_tokens
        by.setdefault((r.source, r.epoch), {}).setdefault(r.block, set()).add(r.place)
    for (source, epoch), places in by.items():
        assert all(len(p) == 1 for p in places.values())
        order = [b for _, b in sorted((p.pop(), b) for b, p in places.items())]
        orders.setdefault(source, {})[epoch] = order
    for source, each in orders.items():
        blocks = [b for s, b in size if s == source]
        assert sorted(each) == list(range(len(each)))
        for epoch, order in each.items():
            if epoch < max(each):
                assert sorted(order) == sorted(blocks)  # whole epochs take every block
            else:
                assert set(order) <= set(blocks) and len(set(order)) == len(order)
    assert any(len({tuple(o) for o in each.values()}) > 1 for each in orders.values() if len(each) > 1)


def test_entropy_target(spark):
    t = spark.createDataFrame([(1000,), (100,), (10,)], "src_tokens long")
    m = sm.choose_exponent(t, 0.9, None)
    z = [(x / 1110) ** m.exponent for x in (1000, 100, 10)]
    h = -sum(w / sum(z) * math.log(w / sum(z)) for w in z)
    own = -sum(x / 1110 * math.log(x / 1110) for x in (1000, 100, 10))
    assert h == pytest.approx(own + 0.9 * (math.log(3) - own), abs=1e-4)
    assert sm.choose_exponent(t, 1.0, None).exponent == pytest.approx(0, abs=1e-6)
    assert sm.choose_exponent(t, 0.0, None).exponent == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_target_binds(spark, sf):
    """On the given tables: the exponent is inside (0, 1) and equals a plain bisection, and every source's weight is met within half a block."""
    from larkspur.llm.catalog import op7_source_mixing

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r.doc_id: max(1, len((r.text or "").encode().split())) for r in docs}
    total = {}
    for r in docs:
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
    every = sum(total.values())

    def entropy(x):
        z = [(t / every) ** x for t in total.values()]
        return -sum(w / sum(z) * math.log(w / sum(z)) for w in z)

    goal = entropy(1) + 0.5 * (math.log(len(total)) - entropy(1))
    a, b = 0.0, 1.0
    for _ in range(60):
        m = (a + b) / 2
        a, b = (m, b) if entropy(m) >= goal else (a, m)
    hi, lo = max(total.values()), min(total.values())
    x = max(a, 1 - math.log(2) / math.log(hi / lo) if hi > 2 * lo else 0)
    assert 0 < x < 1
    rows = op7_source_mixing(spark, f"/root/testdata/{sf}").collect()
    got, block = {}, {}
    for r in rows:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
        block[r.source, r.epoch, r.block] = block.get((r.source, r.epoch, r.block), 0) + r.n_tokens
    first = {}
    for (s, e, k), n in block.items():
        if e == 0:
            first[s] = max(first.get(s, 0), n)
    assert len(rows) > len(docs) and set(got) == set(total)
    for s, t in total.items():
        assert abs(got[s] - t * (t / hi) ** (x - 1)) <= first[s] / 2 + 1e-4 * t


def test_odd_rows(spark, odd_docs, no_docs):
    out = sm.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd_docs.collect()}
    assert sm.mixed_documents(no_docs).count() == 0
