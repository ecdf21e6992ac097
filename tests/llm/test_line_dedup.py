import hashlib
from collections import defaultdict

import pytest

from larkspur.llm import line_dedup as ld

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, keep_first):
    seen, first = defaultdict(set), {}
    key = lambda line: line.strip(" \t\n\v\f\r").translate(AZ)
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            seen[key(line)].add(doc)
            k = key(line)
            first[k] = min(first.get(k, (1 << 62, 0)), (-(1 << 62) if doc is None else doc, pos))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if not key(x) or len(seen[key(x)]) < least or keep_first and first[key(x)] == (-(1 << 62) if doc is None else doc, pos)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("least", [2, 3, 10])
def test_equals_brute_force(spark, least, keep_first):
    rows = [(i, "\n".join([f"own {i}", "Shared Line", " shared line\t", "" if i % 2 else "\tx", f"pair {i // 2}", f"five {i // 5}", "é"][: 3 + i % 5])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ld.line_report(docs, least, keep_first).collect()), key=str)
    assert got == brute(rows, least, keep_first)


def test_runs_that_cross_batches_and_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, f"hot\nl{i % 3}\nu{i}") for i in range(300)]
        got = sorted((tuple(r) for r in ld.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 10).collect()), key=str)
        assert got == brute(rows, 10, False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in ld.line_report(odd_docs, 2).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 2, False)
    assert ld.line_report(no_docs).count() == 0
    kept = ld.without_repeated_lines(odd_docs, 2)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1  # 6 is a copy of 0
    assert ld.without_repeated_lines(no_docs).count() == 0


def test_bitmaps_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    from larkspur.llm import line_dedup as ld

    rows = [(i, f"own {i}\nshared line\n{'again' if i % 2 else 'other'}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, ld.line_report(df, 10).collect()))
    monkeypatch.setattr(ld, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Broadcast" not in ld.with_bitmaps(df, 10)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, ld.line_report(df, 10).collect())) == want
    assert {r[2] for r in want} == {2}


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_repeated_inside_texts(spark, keep_first):
    """One row a text and key travels, however often the text repeats the line."""
    from larkspur.llm import line_dedup as ld

    rows = [(i, "head\n" + "often\n" * (1 + 300 * (i % 3)) + f"own {i}\n\nhead\nown {i}") for i in range(40)] + [(50, "rare\n" * 50_000 + "often")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ld.line_rows(df).count() == 40 * 3 + 2
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.line_report(df, 10, keep_first).collect()}
    for i, text in rows:
        lines, first = text.split("\n"), set()
        kept = []
        for j, x in enumerate(lines):
            common = x in ("head", "often")
            if common and not (keep_first and i == 0 and x not in first):
                continue
            first.add(x)
            kept.append(x)
        assert got[i] == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
