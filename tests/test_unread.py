import gzip

from larkspur.sources import files


def test_a_broken_file_is_named_and_the_others_are_read(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"text": "one"}\n{"text": "two"}\n')
    with gzip.open(folder / "deep" / "b.jsonl.gz", "wt") as f:
        f.write('{"text": "three"}\n' * 2000)
    (folder / "c.jsonl.gz").write_bytes(b"no gzip at all")
    (folder / "d.jsonl").write_text("")
    (folder / "e.jsonl").write_text('{"other": 1}\n')
    (folder / "f.txt").write_text("not asked for")
    docs = files.jsonl(spark, str(folder))
    assert docs.count() == 2002
    lost = {r.source.rsplit("/", 1)[1]: r.length for r in files.unread(spark, str(folder), "jsonl", docs).collect()}
    assert lost == {"c.jsonl.gz": 14, "e.jsonl": 13}
