"""Shared plumbing of the training-data operators: Arrow batch bounds, memos of a worker, columns under names of
their own and 64-bit mixing in numpy; written tables, hot keys and measured sides come from the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.shared import clear, drop, hot_keys, join_hot, join_salted, new_path, sent_if_small, table, work_dir  # noqa: F401

#: Rows of a batch handed to Python; whole texts, so that a batch of long ones stays small.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Whole documents travel to Python in batches of so many rows.  The setting is the session's and the same for every operator;
    a function that must not see more rows at once slices its batches (`sliced`)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, whatever the session's setting was when the plan ran."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: The memos of this Python worker by operator, with what empties each.
_memos: dict[str, Callable[[], None]] = {}


def own_memo(name: str, empty: Callable[[], None]) -> None:
    """Called by a task that is about to fill a memo: a worker serves one operator after another, and
    the others' memos would only take its memory."""
    for other, clear in _memos.items():
        if other != name:
            clear()
    _memos[name] = empty


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, Iterable] | None]], schema: str) -> DataFrame:
    """mapInArrow over a function from a batch to columns; make() runs once in each task."""
    spark = df.sparkSession
    bound_batches(spark)
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in sliced(batches):
            if (out := f(batch)) is not None:
                yield pa.RecordBatch.from_arrays([_column(out[x.name], x.type) for x in target], schema=target)

    return df.mapInArrow(run, fields)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.combine_chunks().cast(kind) if isinstance(values, pa.ChunkedArray) else values.cast(kind)
    return pa.array(values, type=kind)


def carried(columns: list[str]) -> list:
    """Columns under names of their own, so that none clashes with what an operator adds."""
    return [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)]


def restored(columns: list[str]) -> list:
    """The carried columns under their old names."""
    return [F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
