"""Python stages over documents, fed batch by batch through Arrow."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# This package's functions travel to the executors with the task, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Types of the result columns by their short names.
TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
         "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


#: Rows of whole texts in a batch: the JVM, Arrow and Python each hold a batch in every task at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session's Arrow batches hold at most ``rows`` rows (fewer where it is set so)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(arrow_type(name[6:-1]))
    return TYPES[name]


def per_batch(df: DataFrame, schema: str, start: Callable[[], Callable[[list[list]], list]]) -> DataFrame:
    """``df`` mapped by Python code, one Arrow batch at a time.

    ``start()`` runs once in each task and returns the function that gets a
    batch's columns as lists and returns the result's columns, in the order of
    ``schema`` ("name type, ...").  Batches are bounded in rows and bytes by
    Spark's Arrow settings, so memory does not follow the partition.
    """
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(", ")]
    names, kinds = [n for n, _ in fields], [k for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [arrow_type(k) for k in kinds]
        fn = start()
        for b in batches:
            cols = fn([c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names)

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and group starts of sorted rows of numbers, cut between groups of the first
    ``keys`` columns; a group that a batch leaves unfinished waits for the next one."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        new = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
        cut = np.concatenate([[0], np.nonzero(new)[0] + 1])
        held = [c[cut[-1]:] for c in cols]
        if len(cut) > 1:
            yield [c[:cut[-1]] for c in cols], cut[:-1]
    if held is not None and len(held[0]):
        yield held, np.array([0])
