import random
import re
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, num, den):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(AZ))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    pairs = defaultdict(int)
    for members in by.values():
        for x, a in enumerate(members):
            for b in members[x + 1 :]:
                pairs[a, b] += 1
    for (a, b), both in pairs.items():
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, groups=25, copies=6, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 9, 12, 20, words, 3 * words]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


def found(spark, rows, width, similarity):
    df = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), width, similarity)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("width", "similarity"), [(3, (90, 100)), (5, (80, 100)), (2, (60, 100))])
def test_equals_brute_force(spark, width, similarity):
    rows = near_copies(width)
    assert found(spark, rows, width, similarity) == brute(rows, width, *similarity)


def test_large_groups_take_blocks_pivots_and_a_second_round(spark, monkeypatch):
    for name, v in (("BLOCK", 8), ("PIVOTS", 2), ("FLUSH_ENTRIES", 300), ("CLUSTER_BYTES", 2000)):
        monkeypatch.setattr(nj, name, v)
    rows = near_copies(5, groups=3, copies=60, words=40)
    assert found(spark, rows, 3, (80, 100)) == brute(rows, 3, 80, 100)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(odd_docs, 3, (90, 100)).collect()), key=str)
    assert (0, 9, 0) in got and (6, 9, 0) in got and (7, 9, 7) in got
    assert (1, 0, 1) in got and got.count((3, 0, 3)) == 2
    assert (4, 1, 4) in got and (5, 1, 5) in got and (9, 1, 9) in got
    assert (None, 2, None) in got and (None, 0, None) in got
    assert len(got) == odd_docs.count()
    assert nj.ngram_components(no_docs).count() == 0
    kept = nj.one_of_each_group(odd_docs, 3, (90, 100))
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 1


def test_sim_bounds():
    sim = nj.Similarity(90, 100)
    assert sim.reached(9, 10, 9) and not sim.reached(9, 10, 10)
    levels = nj.Levels.of(sim, 1000)
    for a in range(1, 400):
        for b in range(a, int(a / 0.9) + 1):
            assert set(levels.for_size(a, sim)) & set(levels.for_size(b, sim))
            level = int(np.searchsorted(levels.lows, a, side="right")) - 1
            assert a + b - 2 * sim.least_overlap(a, b) <= levels.apart[level]


def test_every_link_without_spanning():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[i:], rng.integers(0, 2**63, i).astype(np.uint64)])) for i in range(30)]
    sim = nj.Similarity(80, 100)
    every = {(min(p), max(p)) for p in nj.tree_links(sim, sets, np.arange(30), None, False)}
    assert every == {(i, j) for i in range(30) for j in range(i + 1, 30) if sim.reached(nj.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j]))}
    assert len(nj.tree_links(sim, sets, np.arange(30), 15, False)) == len([1 for i, j in every if i < 15 <= j])


def test_a_common_passage_makes_no_group(spark, monkeypatch):
    """Texts that share a passage meet by their rare shingles only; the near copies among them are still found."""
    for name, v in (("BLOCK", 16), ("PIVOTS", 4)):
        monkeypatch.setattr(nj, name, v)
    rng = random.Random(8)
    head = " ".join(f"head{i}" for i in range(40))
    rows = [(i, f"{head} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 20])))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 600, 20)]
    assert found(spark, rows, 3, (90, 100)) == brute(rows, 3, 90, 100)
    join = nj.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100))
    assert join.sets.count() > 300  # of hot segments
    assert join.wanted.count() > 300 and join.members.where("large").select("bucket").distinct().count() <= 2


def test_any_order_of_rarity_is_exact():
    rng = np.random.default_rng(3)
    sim = nj.Similarity(80, 100)
    counts = rng.integers(0, 3, nj.SLOTS).astype(np.uint32)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[i % 13 :], rng.integers(0, 2**63, i % 11).astype(np.uint64)])) for i in range(80)]
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if sim.reached(nj.overlap(a, b), len(a), len(b)):
                assert len(np.intersect1d(nj.rarest(a, counts, sim), nj.rarest(b, counts, sim)))


def test_hub_nodes_are_joined_apart(spark, monkeypatch):
    from larkspur.llm import components as cp

    monkeypatch.setattr(cp, "HUB_EDGES", 5)
    monkeypatch.setattr(cp, "HUBS", 1000)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 160)] + [(159, 30)]
    got = {r.node: r.component for r in cp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {x for p in links for x in p} and set(got.values()) == {0}


def test_texts_of_one_template(spark, monkeypatch):
    """Texts of lines drawn from few lines share many shingles; their groups are narrowed in many tasks."""
    monkeypatch.setattr(nj, "NARROW_PAIRS", 200)
    monkeypatch.setattr(nj, "BLOCK", 40)
    rng = random.Random(11)
    lines = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(90)) for _ in range(6)) for _ in range(16)]
    rows = [(i, "\n".join(sorted(rng.sample(lines, 8), key=lines.index))) for i in range(150)]
    rows += [(150 + i, rows[i][1] + " end") for i in range(20)]
    got = found(spark, rows, 3, (90, 100))
    assert got == brute(rows, 3, 90, 100)
    assert any(i != c for i, (_, c) in got.items())
