"""Normalising flows fitted by data-parallel gradients.

The frames are packed once into blocks.  A step sends the parameters to all tasks; each makes the gradient of its
share of the rows, and one row a task is added up in groups.  The driver holds parameters and one
gradient, never data.  Latents, inverses, densities and modes are made batch by batch on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lagfold.functions.nets import Adam, Couplings, Splines
from lagfold.operators.geometry import moments
from lagfold.operators.sums import matrix, rows_of, vector_sum, with_column
from lagfold.operators.tables import dropped, written

KINDS = {"coupling": Couplings, "spline": Splines}


def blocks(frames: DataFrame, columns: list[str], rows: int = 4096) -> DataFrame:
    """Packed blocks ``(n, <columns>)`` of array columns, each block a row of matrices; rows with a null array are left out."""
    schema = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *[pa.array([matrix(part.column(c)).astype("<f8").tobytes()], pa.binary()) for c in columns]], schema.names)

    return frames.select(*columns).where(" and ".join(f"`{c}` is not null" for c in columns)).mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, row: int, column: str) -> np.ndarray:
    n = batch.column("n")[row].as_py()
    return np.frombuffer(batch.column(column)[row].as_buffer(), "<f8").reshape(n, -1)


def descend(table: DataFrame, theta: np.ndarray, loss: Callable[[np.ndarray, pa.RecordBatch, int], tuple[float, np.ndarray, int]], steps: int, rate: float, tasks: int | None = None) -> tuple[np.ndarray, list[float]]:
    """(parameters, mean loss by step) after Adam steps.

    ``loss(theta, batch, step)`` gives (sum, gradient of the sum, terms) of a batch of packed blocks.
    """
    tasks = table.rdd.getNumPartitions() if tasks is None else tasks
    adam, history = Adam(rate), []
    for step in range(steps):

        def work(batches: Iterator[pa.RecordBatch], theta=theta, step=step) -> np.ndarray | None:
            total = None
            for b in batches:
                if b.num_rows:
                    value, g, n = loss(theta, b, step)
                    part = np.concatenate([[value, n], g])
                    total = part if total is None else total + part
            return total

        got = vector_sum(table, work, tasks)
        if got is None or not got[1]:
            break
        theta = adam.step(theta, got[2:] / got[1])
        history.append(float(got[0] / got[1]))
    return theta, history


class Flow:
    """An invertible map from standardised frames to a standard normal law, on request under a condition column."""

    def __init__(self, model, theta: np.ndarray, mean: np.ndarray, std: np.ndarray, kind: str = "coupling"):
        self.model, self.theta, self.mean, self.std, self.kind, self.history = model, theta, mean, std, kind, []

    @staticmethod
    def fit(frames: DataFrame, x: str = "cv", condition: str | None = None, kind: str = "coupling", steps: int = 200, rate: float = 3e-3, share: float = 1.0, seed: int = 0, **shape) -> "Flow":
        n, s, _, xx, _, _ = moments(frames, x)
        if not n:
            raise ValueError("no frames to fit")
        mean = s / n
        std = np.sqrt(np.maximum(np.diag(xx) / n - mean**2, 0)) + 1e-6
        columns = [x, *([condition] if condition else [])]
        packed = written(blocks(frames, columns))
        if condition:
            shape["condition"] = len(frames.select(condition).where(f"`{condition}` is not null").first()[0])
        model = KINDS[kind](len(mean), **shape)

        turns = max(1, round(1 / share))  # a step takes every ``1 / share``-th row of each block in turn

        def loss(theta, batch, step):
            rows, total = slice(step % turns, None, turns), [0.0, np.zeros(model.size), 0]
            for row in range(batch.num_rows):
                y = (unpacked(batch, row, x)[rows] - mean) / std
                value, g = model.loss(theta, y, unpacked(batch, row, condition)[rows] if condition else None)
                total = [total[0] + value + len(y) * np.log(std).sum(), total[1] + g, total[2] + len(y)]
            return tuple(total)

        theta, history = descend(packed, model.start(seed), loss, steps, rate)
        dropped(packed)
        out = Flow(model, theta, mean, std, kind)
        out.history = history
        return out

    # arrays

    def forward(self, x: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        return self.model.forward(self.theta, (x - self.mean) / self.std, c)[0]

    def inverse(self, z: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        return self.model.inverse(self.theta, z, c) * self.std + self.mean

    def log_prob(self, x: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        return self.model.log_prob(self.theta, (x - self.mean) / self.std, c) - np.log(self.std).sum()

    # tables

    def _with(self, frames: DataFrame, x: str, out: str, condition: str | None, f) -> DataFrame:
        kind = T.DoubleType() if f == self.log_prob else T.ArrayType(T.DoubleType())

        def work(b: pa.RecordBatch) -> pa.Array:
            got = f(matrix(b.column(x)), matrix(b.column(condition)) if condition else None)
            return pa.array(got) if got.ndim == 1 else rows_of(got)

        return with_column(frames.where(f"`{x}` is not null"), out, kind, work)

    def latents(self, frames: DataFrame, x: str = "cv", out: str = "z", condition: str | None = None) -> DataFrame:
        return self._with(frames, x, out, condition, self.forward)

    def restored(self, frames: DataFrame, z: str = "z", out: str = "cv", condition: str | None = None) -> DataFrame:
        return self._with(frames, z, out, condition, self.inverse)

    def densities(self, frames: DataFrame, x: str = "cv", out: str = "log_prob", condition: str | None = None) -> DataFrame:
        return self._with(frames, x, out, condition, self.log_prob)

    def modes(self, frames: DataFrame, condition: str, out: str = "mode") -> DataFrame:
        """What each row's condition most likely goes with: the image of latent 0."""
        return with_column(frames, out, T.ArrayType(T.DoubleType()), lambda b: rows_of(self.inverse(np.zeros((b.num_rows, len(self.mean))), matrix(b.column(condition)))))

    def samples(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """``(id, x)``: draws from the density; a draw depends on its id alone."""

        def work(b: pa.RecordBatch) -> pa.Array:
            z = np.stack([np.random.default_rng((seed, int(k))).normal(size=len(self.mean)) for k in b.column("id").to_numpy()])
            return rows_of(self.inverse(z))

        return with_column(spark.range(n), "x", T.ArrayType(T.DoubleType()), work)

    def config(self) -> dict:
        m = self.model
        shape = {"hidden": m.net.sizes[1], "layers": m.count} | ({"bins": m.bins, "reach": m.reach} if self.kind == "spline" else {"condition": m.condition})
        return {"kind": self.kind, "dim": m.dim, "shape": shape}

    def table(self, spark: SparkSession) -> DataFrame:
        """``(name, v)``: parameters and standardisation."""
        return spark.createDataFrame([("theta", self.theta.tolist()), ("mean", self.mean.tolist()), ("std", self.std.tolist())], "name string, v array<double>")

    @staticmethod
    def load(config: dict, table: DataFrame) -> "Flow":
        v = {r.name: np.array(r.v) for r in table.collect()}  # three rows
        return Flow(KINDS[config["kind"]](config["dim"], **config["shape"]), v["theta"], v["mean"], v["std"], config["kind"])
