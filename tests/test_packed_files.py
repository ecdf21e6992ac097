import json

import pytest
from pyspark.sql import functions as F

from larkspur import catalog_sources
from larkspur.sources import files


def test_packed_files_read_as_loose_ones(spark, tmp_path):
    held = {"a/x.json": '{"text": "one", "t": 1}', "b/y.json": ' [{"text": "two"}, {"other": 1}, {"text": "three"}]', "c.json": "broken", "d.json": '{"text": null}'}
    for name, value in held.items():
        (tmp_path / "loose" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "loose" / name).write_text(value)
    path = files.pack(spark.createDataFrame(list(held.items()), files.WHOLE), f"{tmp_path}/all.packed")
    listed = lambda p: sorted((r.doc_id, r.content, r.metadata["index"], r.metadata.get("t")) for r in files.json(spark, p, metadata=("t",)).collect())
    assert listed(path) == listed(str(tmp_path / "loose")) and len(listed(path)) == 3
    assert sorted(map(tuple, files.rejected(spark, path).collect())) == [("b/y.json", 1), ("c.json", 0), ("d.json", 0)]
    with pytest.raises(ValueError):
        files.pack(spark.createDataFrame([], files.WHOLE), f"{tmp_path}/all")


def test_source_json_makes_no_file_a_document(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} {chr(10)}\"", "en" if i % 2 else None) for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog_sources, "fresh_path", lambda s, name: f"{tmp_path}/{name}")
    got = catalog_sources.source_json(spark, str(tmp_path))
    assert sorted((r.content, r.lang, r["index"]) for r in got.collect()) == sorted(((t, g, 0) for i, t, g in rows if i % 3), key=lambda r: r[0])
    assert len(list((tmp_path / "json").rglob("*.parquet"))) < 50
    assert got.where(F.col("doc_id") != F.substring(F.md5("content"), 1, 16)).count() == 0
    assert json.loads(spark.read.parquet(f"{tmp_path}/json/all.packed").where("source = 'doc_id=3/0.json'").first().value) == {"lang": "en"}
