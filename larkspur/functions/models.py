"""Models over a column of texts: made once a worker, called by token budget, paced and retried.

A model is given as a factory.  What it makes is kept by the worker process
under the model's name, so it is built once a process and never pickled.  Texts
are gathered over Arrow batches up to a number of tokens, so that calls are even
whatever the batches are.  A call that says Overloaded is repeated after the
time it asks for, another failure after growing pauses.  What still fails is
halved until the texts that fail stand alone; these get a null and the error's
text, and the others their results: no text takes its neighbours down, and
`failed` has the rows for another run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Model = Callable[[list[str]], list]
_MADE: dict[str, Model] = {}


class Overloaded(Exception):
    """The service asks for a pause of so many seconds before the call is made again."""

    def __init__(self, retry_after: float) -> None:
        super().__init__(f"retry after {retry_after} s")
        self.retry_after = retry_after


def made(name: str, factory: Callable[[], Model]) -> Model:
    """The worker's model of this name, made at its first use."""
    if name not in _MADE:
        _MADE[name] = factory()
    return _MADE[name]


@dataclass(frozen=True)
class Pace:
    """budget: tokens of a call; attempts: calls of the same texts; pause: seconds before the second one, doubled each time."""

    budget: int = 8192
    attempts: int = 3
    pause: float = 1.0
    longest: float = 60.0
    sleep: Callable[[float], None] = field(default=time.sleep)


def called(model: Model, texts: list[str], pace: Pace) -> list[tuple[object, str | None]]:
    """(result, error) of each text."""
    error = ""
    for attempt in range(pace.attempts):
        try:
            out = list(model(texts))
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} results for {len(texts)} texts")
            return [(x, None) for x in out]
        except Overloaded as e:
            error, wait = str(e), e.retry_after
        except Exception as e:  # noqa: BLE001  whatever a model raises is its rows' error
            error, wait = f"{type(e).__name__}: {e}", pace.pause * 2**attempt
        if attempt + 1 < pace.attempts:
            pace.sleep(min(wait, pace.longest))
    if len(texts) == 1:
        return [(None, error)]
    half = len(texts) // 2
    return [*called(model, texts[:half], pace), *called(model, texts[half:], pace)]


def modelled(df: DataFrame, text: str, name: str, factory: Callable[[], Model], kind: str, out: str = "result", error: str = "error", pace: Pace = Pace(), tokens: Callable[[str], int] = lambda t: len(t) // 4 + 1) -> DataFrame:
    """df with the model's result of a text column (of the DDL type `kind`) and the error of the rows that have none.  A null text is an empty one."""
    fields = df.columns
    shape = StructType([*df.schema.fields, *df.sparkSession.createDataFrame([], f"`{out}` {kind}").schema.fields, StructField(error, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        model, result_type = made(name, factory), to_arrow_type(shape[out].dataType)
        held: list[pa.RecordBatch] = []
        texts: list[str] = []

        def flush() -> Iterator[pa.RecordBatch]:
            both = called(model, texts, pace)
            at = 0
            for b in held:
                mine = both[at : at + b.num_rows]
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in mine], result_type), pa.array([e for _, e in mine], pa.string())], names=[*fields, out, error])
            held.clear()
            texts.clear()

        spent = 0
        for b in batches:
            a = 0
            for i, t in enumerate(b.column(text).to_pylist()):
                n = tokens(t or "")
                if texts and spent + n > pace.budget:
                    if i > a:
                        held.append(b.slice(a, i - a))
                    yield from flush()
                    a, spent = i, 0
                texts.append(t or "")
                spent += n
            if b.num_rows > a:
                held.append(b.slice(a))
        if texts:
            yield from flush()

    return df.mapInArrow(run, shape)


def failed(done: DataFrame, error: str = "error") -> DataFrame:
    """The rows without a result, with what they need to be run again and why they failed."""
    return done.where(F.col(error).isNotNull())
