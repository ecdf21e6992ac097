import pyarrow as pa

from larkspur.llm import line_dedup as ld


def test_workers_give_memory_back(monkeypatch):
    """At the end of a task, not a batch; before, a worker of line dedup kept what it had freed."""
    calls = []
    monkeypatch.setattr(ld, "trim", lambda: calls.append(1), raising=False)
    none = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())], names=["h", "doc", "rk", "pos", "more"])
    assert list(ld.scan_runs(2, False)(iter([none, none]))) == [] and calls == [1]
