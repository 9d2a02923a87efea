"""Causal predictors of the next frame, fitted by gradients through time on windows of runs.

Runs are cut into windows that the executors hold packed; a step's gradient is one row a task.  A fitted
predictor serves the closed-loop and the conditional coder (``coding``) and keyed streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lagfold.functions.nets import Dilated, Recurrent
from lagfold.operators.flow import descend
from lagfold.operators.geometry import moments
from lagfold.operators.sums import matrix, vector_sum
from lagfold.operators.tables import dropped, written

KINDS = {"recurrent": Recurrent, "dilated": Dilated}
#: Windows whose gradients are made together.
TOGETHER = 256


def windows(frames: DataFrame, x: str, length: int) -> DataFrame:
    """``(w)``: the vectors of each window of up to ``length`` frames of a run, in order; rows with a null array are left out."""
    keyed = frames.where(f"`{x}` is not null").select("run_id", F.expr(f"t div {length}").alias("k"), F.struct("t", F.col(x).cast("array<double>").alias("x")).alias("s"))
    rows = keyed.groupBy("run_id", "k").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return rows.select(F.size("s").alias("n"), F.flatten(F.transform("s", lambda s: s["x"])).alias("w"))


def stacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, which frames are real) of a batch, padded to a length."""
    for at in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(at, TOGETHER)
        n = part.column("n").to_numpy()
        w = part.column("w")
        flat = w.flatten().to_numpy(zero_copy_only=False)
        dim = len(flat) // int(n.sum())
        live = np.arange(n.max()) < n[:, None]
        z = np.zeros((*live.shape, dim))
        z[live] = flat.reshape(-1, dim)
        yield z, live


class Predictor:
    """Mean and log deviation of the next vector from the vectors so far; before the first, those of all frames."""

    def __init__(self, model, theta: np.ndarray, mean: np.ndarray, std: np.ndarray, kind: str):
        self.model, self.theta, self.mean, self.std, self.kind, self.history = model, theta, mean, std, kind, []
        self.dim = len(mean)

    @staticmethod
    def fit(frames: DataFrame, x: str = "z", kind: str = "recurrent", steps: int = 100, rate: float = 1e-2, length: int = 128, seed: int = 0, **shape) -> "Predictor":
        n, s, _, xx, _, _ = moments(frames, x)
        if not n:
            raise ValueError("no frames to fit")
        mean = s / n
        std = np.sqrt(np.maximum(np.diag(xx) / n - mean**2, 0)) + 1e-6
        table = written(windows(frames, x, length))
        model = KINDS[kind](len(mean), **shape)

        def loss(theta, batch, step):
            total = [0.0, np.zeros(model.size), 0]
            for z, live in stacked(batch):
                value, g, m = model.loss(theta, (z - mean) / std, live)
                total = [total[0] + value, total[1] + g, total[2] + m]
            return tuple(total)

        theta, history = descend(table, model.start(seed), loss, steps, rate)
        dropped(table)
        out = Predictor(model, theta, mean, std, kind)
        out.history = [h + float(np.log(std).mean()) for h in history]
        return out

    def start(self):
        return self.model.begin(), self.mean, np.log(self.std)

    def after(self, state, z: np.ndarray):
        state, mean, log_s = self.model.advance(self.theta, state, (z - self.mean) / self.std)
        return state, mean * self.std + self.mean, log_s + np.log(self.std)


def conditional_nll(frames: DataFrame, model: Predictor, x: str = "z", length: int = 128) -> tuple[float, float]:
    """(conditional, static) mean negative log likelihood a number: of the next vector under the predictor, and under the normal law of all frames."""

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(3)
        for b in batches:
            if b.num_rows:
                for z, live in stacked(b):
                    y = (z - model.mean) / model.std
                    value, _, n = model.model.loss(model.theta, y, live)
                    w = (live[:, 1:] & live[:, :-1])[..., None]
                    total += [value, (w * 0.5 * (y[:, 1:] ** 2 + np.log(2 * np.pi))).sum(), n]
        return total

    value, static, n = vector_sum(windows(frames, x, length), work)
    return float(value / n + np.log(model.std).mean()), float(static / n + np.log(model.std).mean())


_TOLD = "run_id long, t long, mean array<double>, log_s array<double>"


def _tell(pdf: pd.DataFrame, x: str, model, state, mean, log_s):
    rows = []
    for t, z in zip(pdf["t"], pdf[x]):
        rows.append((int(t), mean, log_s))
        state, mean, log_s = model.after(state, np.asarray(z, float))
    return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "t": [r[0] for r in rows], "mean": [r[1] for r in rows], "log_s": [r[2] for r in rows]}), state, mean, log_s


def predictions(frames: DataFrame, model, x: str = "z") -> DataFrame:
    """``(run_id, t, mean, log_s)``: what is expected of each frame from the run's frames before it."""
    return frames.select("run_id", "t", x).groupBy("run_id").applyInPandas(lambda pdf: _tell(pdf.sort_values("t"), x, model, *model.start())[0], _TOLD)


def stream_predictions(frames: DataFrame, model, x: str = "z") -> DataFrame:
    """The same of a stream: a run's prediction state is kept between micro-batches, its frames must arrive in order."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("t")
        state, mean, log_s = model.start()
        if kept.exists:
            flat, width, mean, log_s = kept.get
            state, mean, log_s = np.array(flat, float).reshape(-1, width), np.array(mean, float), np.array(log_s, float)
        out, state, mean, log_s = _tell(pdf, x, model, state, mean, log_s)
        kept.update((state.ravel().tolist(), int(state.shape[1]), np.asarray(mean).tolist(), np.asarray(log_s).tolist()))
        yield out

    return frames.select("run_id", "t", x).groupBy("run_id").applyInPandasWithState(update, _TOLD, "state array<double>, width int, mean array<double>, log_s array<double>", "append", GroupStateTimeout.NoTimeout)
