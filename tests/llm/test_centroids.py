import hashlib
import math
import random

import pytest

from larkspur.llm import centroids as cc


def plain(rows, k=8, rounds=10, seed=3):
    """Every distance of every round in Python's integers; {row number: (cluster, distance, its inertia, inertia, digest)}."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(1024 * x) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"{seed}:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    c = [q[j] for j in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for v in q]

    for _ in range(rounds if c else 0):
        a = assign()
        for j in range(len(c)):
            mine = [q[i] for i, (_, x) in enumerate(a) if x == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    a = assign() if c else []
    per = {}
    for d, j in a:
        per[j] = per.get(j, 0) + d
    cap = (1 << 63) - 1
    return sorted(((kept[i][0], j, min(d, cap), min(per[j], cap), min(sum(per.values()), cap), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in enumerate(a)), key=str)


def got(df, **more):
    return sorted((tuple(r) for r in cc.cluster_report(df, **more).collect()), key=str)


def vectors(seed, n, spread=1.0, values=None):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [r.choice(values) if values else m + spread * r.gauss(0, 1) for m in r.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(1, 300, 0.3), vectors(2, 200), vectors(3, 60, values=[0.0, 0.001]), vectors(4, 5)], ids=["clusters", "noise", "ties", "few"])
def test_against_all_distances(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert got(df) == plain(rows)


def test_odd_rows(spark):
    good = [x for _, x in vectors(5, 30)]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (3, good[4]), (None, good[5]), (90, None), (91, []), (92, good[0][:63]), (93, good[0] + [1.0]), (94, [None, *good[0][1:]]), (95, [math.nan, *good[0][1:]]), (96, [math.inf, *good[0][1:]]), (97, [0.0] * 64), (98, [0.0] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, q string")
    assert got(df) == plain(rows)
    assert cc.cluster_report(df.where("vec_id > 1000")).count() == 0
    assert cc.cluster_report(df.where("vec_id > 1000")).columns == cc.cluster_report(df).columns


def test_components_beyond_a_long(spark):
    r = random.Random(6)
    rows = vectors(6, 40) + [(100 + i, [r.choice([1.0, 1e6, -3e9, 1e30]) * r.random() for _ in range(64)]) for i in range(12)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain(rows)


def test_screening_leaves_distances_out(spark):
    rows = [(i, [x * (1 + i % 7) for x in v]) for i, v in vectors(7, 400, 0.05)]
    found = cc.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.exact_shares and max(found.exact_shares) < 0.6
