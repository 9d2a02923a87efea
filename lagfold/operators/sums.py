"""Sums of long vectors over tasks: a packed row a task, added up in groups before the driver sees any."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups in which the tasks' rows meet; rows of a batch that are worked on together.
FAN, ROWS = 32, 1024


def packed(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, "<f8").tobytes()], pa.binary())], ["m"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column("m"):
            v = np.frombuffer(raw.as_buffer(), "<f8")
            total = v.copy() if total is None else total + v
    if total is not None:
        yield packed(total)


def vector_sum(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], tasks: int | None = None) -> np.ndarray | None:
    """The sum of what ``work`` makes of each task's batches (vectors of one length); None if no task has a vector.

    ``tasks``, where the caller knows it: up to ``FAN`` rows are added on the driver at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = work(batches)
        if got is not None:
            yield packed(got)

    parts = rows.mapInArrow(run, "m binary")
    if tasks is None or tasks > FAN:
        groups = min(FAN, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
        parts = parts.withColumn("_g", F.spark_partition_id() % groups).repartition(groups, "_g").select("m").mapInArrow(_added, "m binary")
    total = None
    for r in parts.collect():  # FAN rows at most
        v = np.frombuffer(bytes(r.m), "<f8")
        total = v.copy() if total is None else total + v
    return total


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``ROWS`` rows, so that what is made of a piece stays small whatever a batch holds."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def with_column(frames: DataFrame, out: str, kind: T.DataType, work: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``frames`` with a column made from each Arrow batch."""
    base = frames.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, work(b)], schema.names)

    return base.mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of numbers, equal in length and without null rows, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rows_of(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).ravel()))
