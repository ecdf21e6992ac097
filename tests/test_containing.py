from larkspur.sources import qa


def test_containing_is_one_pass_without_a_shuffle(spark):
    docs = [(1, "a b  c d e f"), (2, "x a b c d e\tf y"), (3, None), (4, " b c d b c d e"), (5, ""), (6, "ab c d e fg"), (2, "b c d e a b c d"), (None, "a b c d e"), (7, " a b c d e"), (8, "a b c")]
    asked = [(10, "a b c d e"), (11, "b c d e"), (12, "b c"), (13, "b c d b c"), (14, "c d e f"), (15, "zz a b c d"), (10, "x a b c d"), (16, "b c d e a b")]
    corpus = spark.createDataFrame(docs, "doc_id long, content string")
    passages = spark.createDataFrame(asked, "query_id long, query string")
    out = qa.containing(corpus, passages)
    want = sorted((q, d) for q, t in asked for d, c in docs if c is not None and t in c and (d is not None))
    got = sorted((r.query_id, r.doc_id) for r in out.collect() if r.doc_id is not None)
    assert got == want
    joined = qa.containing(corpus.distinct(), passages.where("query_id <> 10"), broadcast_rows=0)
    assert sorted(map(tuple, joined.where("doc_id is not null").distinct().collect())) == sorted({x for x in want if x[0] != 10})
    long = qa.containing(corpus, passages.where("query_id <> 12"))
    assert "Exchange hashpartitioning" not in long._jdf.queryExecution().toString()
