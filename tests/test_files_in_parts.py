from larkspur import catalog_sources
from larkspur.sources import files

ROWS = [(i, f"text {i} " + "x" * (i % 50), "en") for i in range(1, 3001)]


def test_parts_are_numbered_through(spark, tmp_path):
    """Several parts, each of several blocks."""
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.json(f"{tmp_path}/a.jsonl")
    (tmp_path / "b.csv").mkdir()
    (tmp_path / "b.csv" / "part-0.csv").write_text("n\n1\n2\n")
    (tmp_path / "b.csv" / "part-1.csv").write_text("n\n3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000b")
    try:
        docs = files.load(spark, f"{tmp_path}/a.jsonl")
        assert docs.rdd.getNumPartitions() > 6
        assert sorted((int(r.metadata["index"]), r.content) for r in docs.collect()) == [(i, t) for i, t, _ in ROWS]
        assert {r.metadata["source"].rsplit("/", 1)[1] for r in docs.collect()} == {"a.jsonl"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.content, r.metadata["row_number"]) for r in files.csv(spark, f"{tmp_path}/b.csv").collect()) == [("1", "1"), ("2", "2"), ("3", "3")]
    assert sorted(r.metadata["row_number"] for r in files.csv(spark, str(tmp_path)).collect()) == ["1", "1", "2"]  # a folder's files are files


def test_one_file_queries_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    monkeypatch.setattr(catalog_sources, "fresh_path", lambda s, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # such small parts would be joined
    try:
        got = {name: catalog_sources.QUERIES[f"source_{name}"](spark, str(tmp_path)).collect() for name in ("jsonl", "rejected", "dispatch")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(r["index"] for r in got["jsonl"]) == [i for i, _, _ in ROWS]
    assert sorted(r.line for r in got["rejected"]) == [i for i, _, _ in ROWS if i % 7 == 0]
    assert {tuple(r) for r in got["dispatch"]} == {(".jsonl", 3000), (".csv", 1), (".pdf", -1)}
    for name in ("jsonl", "rejected", "dispatch"):
        assert len(list((tmp_path / name).rglob("part-*.json"))) > 1
