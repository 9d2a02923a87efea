"""Soft states fitted by the VAMP-2 score, and the allocation of bits by rate and kinetic distortion.

Both work on packed lagged pairs that the executors hold.  A step of the fit makes two passes: sums of
the soft covariances, from which the driver takes the score's gradient by each covariance (states x states), and
the gradient of the parameters.  A step of the allocation scores all perturbed widths in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.functions import kinetics
from lagfold.functions.nets import Adam, SoftStates
from lagfold.operators import counts, geometry
from lagfold.operators.flow import Flow, blocks, unpacked
from lagfold.operators.geometry import moments
from lagfold.operators.sums import matrix, rows_of, vector_sum, with_column
from lagfold.operators.tables import dropped, written
from lagfold.plans.codec import draws

EPS = 1e-6


def vamp2(c00: np.ndarray, c01: np.ndarray, c11: np.ndarray, eps: float = EPS) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(the squared norm of the whitened lagged covariance, its gradients by the three covariances)."""
    a, b = (np.linalg.inv(c + eps * np.eye(len(c))) for c in (c00, c11))
    left, right = a @ c01, b @ c01.T
    return float(np.trace(left @ right)), -left @ right @ a, 2 * left @ b, -right @ left @ b


def soft_transition(c00: np.ndarray, c01: np.ndarray, eps: float = EPS) -> np.ndarray:
    """The row-stochastic matrix of soft covariances."""
    t = np.maximum(np.linalg.solve(c00 + eps * np.eye(len(c00)), c01), eps)
    return t / t.sum(1, keepdims=True)


def transition_term(p: np.ndarray, q: np.ndarray, eps: float = 1e-8) -> float:
    """Nats a step that Q loses on P, weighted by P's long-run shares."""
    p, q = np.clip(p, eps, 1), np.clip(q, eps, 1)
    return float(kinetics.stationary_distribution(p / p.sum(1, keepdims=True)) @ (p * np.log(p / q)).sum(1))


def _pairs(frames: DataFrame, x: str, lag: int) -> DataFrame:
    """Packed ``(n, x, y, run, t)`` of lagged pairs, written."""
    pairs = counts.lag_pairs(frames.where(f"`{x}` is not null").select("run_id", "t", F.col(x).alias("x")), lag, columns=("x",))
    when = F.array(F.col("run_id").cast("double"), F.col("t").cast("double"))
    return written(blocks(pairs.select("x", F.col("next_x").alias("y"), when.alias("at")), ["x", "y", "at"]))


class SoftModel:
    """Soft assignments of standardised frames."""

    def __init__(self, model: SoftStates, theta: np.ndarray, mean: np.ndarray, std: np.ndarray):
        self.model, self.theta, self.mean, self.std, self.history = model, theta, mean, std, []

    def chi(self, x: np.ndarray) -> np.ndarray:
        return self.model.forward(self.theta, (x - self.mean) / self.std)[0]

    @staticmethod
    def fit(frames: DataFrame, lag: int, states: int, x: str = "cv", steps: int = 100, rate: float = 1e-2, hidden: int = 32, seed: int = 0) -> "SoftModel":
        n, s, _, xx, _, _ = moments(frames, x)
        if not n:
            raise ValueError("no frames to fit")
        mean = s / n
        std = np.sqrt(np.maximum(np.diag(xx) / n - mean**2, 0)) + 1e-6
        out = SoftModel(SoftStates(len(mean), states, hidden), None, mean, std)
        out.theta = out.model.start(seed)
        table, adam = _pairs(frames, x, lag), Adam(rate)
        tasks = table.rdd.getNumPartitions()
        for _ in range(steps):
            got = out.covariances(table, tasks)
            if got is None:
                raise ValueError("no run is longer than the lag")
            n, c = got
            score, g00, g01, g11 = vamp2(*c)
            out.history.append(score)
            out.theta = adam.step(out.theta, -vector_sum(table, out._gradient(n, g00, g01, g11), tasks))
        dropped(table)
        return out

    def _each(self, b: pa.RecordBatch):
        for row in range(b.num_rows):
            yield [self.model.forward(self.theta, (unpacked(b, row, c) - self.mean) / self.std) for c in ("x", "y")]

    def covariances(self, table: DataFrame, tasks: int | None = None):
        """(pairs, (C00, C01, C11)) of the soft states over packed pairs."""
        k = self.model.states

        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(1 + 3 * k * k)
            for b in batches:
                for (u, _), (v, _) in self._each(b):
                    total += np.concatenate([[len(u)], (u.T @ u).ravel(), (u.T @ v).ravel(), (v.T @ v).ravel()])
            return total

        got = vector_sum(table, work, tasks)
        return None if got is None or not got[0] else (got[0], tuple(got[1:].reshape(3, k, k) / got[0]))

    def _gradient(self, n: float, g00: np.ndarray, g01: np.ndarray, g11: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(self.model.size)
            for b in batches:
                for (u, left), (v, right) in self._each(b):
                    total += self.model.back(self.theta, left, (u @ (g00 + g00.T) + v @ g01.T) / n) + self.model.back(self.theta, right, (v @ (g11 + g11.T) + u @ g01) / n)
            return total

        return work

    def assign(self, frames: DataFrame, x: str = "cv", out: str = "chi") -> DataFrame:
        """``frames`` with the soft states of a column."""
        return with_column(frames.where(f"`{x}` is not null"), out, T.ArrayType(T.DoubleType()), lambda b: rows_of(self.chi(matrix(b.column(x)))))


class Allocation:
    """Widths of the bins of a flow's latents."""

    def __init__(self, flow: Flow, soft: SoftModel, lag: int):
        self.flow, self.soft, self.lag = flow, soft, lag
        self.log_width = np.zeros(len(flow.mean))

    def scored(self, table: DataFrame, widths: np.ndarray, seed: int, tasks: int | None = None) -> list[tuple[float, float, float]]:
        """(bits a frame, kinetic distortion, squared error) of each row of log widths, all in one pass."""
        k, flow, soft = self.soft.model.states, self.flow, self.soft

        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            ref, each = np.zeros(1 + 2 * k * k), np.zeros((len(widths), 2 + 2 * k * k))
            for b in batches:
                for row in range(b.num_rows):
                    x, y, at = (unpacked(b, row, c) for c in ("x", "y", "at"))
                    run, t = at.astype(np.int64).T
                    zx, zy = flow.forward(x), flow.forward(y)
                    ux, uy = draws(seed, run, t, x.shape[1]), draws(seed, run, t + self.lag, x.shape[1])
                    u, v = soft.chi(x), soft.chi(y)
                    ref += np.concatenate([[len(x)], (u.T @ u).ravel(), (u.T @ v).ravel()])
                    cost = 0.5 * (zx**2 + np.log(2 * np.pi)) / np.log(2)
                    for n, w in enumerate(widths):
                        xh, yh = flow.inverse(zx + ux * np.exp(w)), flow.inverse(zy + uy * np.exp(w))
                        u, v = soft.chi(xh), soft.chi(yh)
                        each[n] += np.concatenate([[np.maximum(cost - w / np.log(2), 0).sum(), ((x - xh) ** 2).mean(1).sum()], (u.T @ u).ravel(), (u.T @ v).ravel()])
            return np.concatenate([ref, each.ravel()])

        got = vector_sum(table, work, tasks)
        n, ref, each = got[0], got[1 : 1 + 2 * k * k].reshape(2, k, k), got[1 + 2 * k * k :].reshape(len(widths), -1)
        p = soft_transition(ref[0] / n, ref[1] / n)
        out = []
        for e in each / n:
            c = e[2:].reshape(2, k, k)
            out.append((float(e[0]), transition_term(p, soft_transition(c[0], c[1])), float(e[1])))
        return out

    def fit(self, frames: DataFrame, weight: float, kind: str = "kinetic", x: str = "cv", steps: int = 40, rate: float = 0.1, reach: float = 0.05, seed: int = 0) -> "Allocation":
        """Adam steps on bits + ``weight`` x distortion (``kinetic`` or ``mse``), by central differences over all widths at once."""
        which = {"kinetic": 1, "mse": 2}[kind]
        table, adam, d = _pairs(frames, x, self.lag), Adam(rate), len(self.log_width)
        tasks = table.rdd.getNumPartitions()
        for turn in range(steps):
            around = np.concatenate([self.log_width + reach * np.eye(d), self.log_width - reach * np.eye(d)])
            loss = np.array([s[0] + weight * s[which] for s in self.scored(table, around, seed + turn, tasks)])
            self.log_width = adam.step(self.log_width, (loss[:d] - loss[d:]) / (2 * reach))
        dropped(table)
        return self

    def rounded(self, frames: DataFrame, x: str = "cv") -> tuple[DataFrame, float]:
        """(``frames`` with ``q`` and ``back``: rounded latents and what they decode to; bits a frame: the entropies of the levels, summed)."""
        w = np.exp(self.log_width)
        kind = T.ArrayType(T.LongType())
        q = with_column(frames.where(f"`{x}` is not null"), "q", kind, lambda b: pa.array(np.rint(self.flow.forward(matrix(b.column(x))) / w).astype(np.int64).tolist(), pa.list_(pa.int64())))
        both = written(with_column(q, "back", T.ArrayType(T.DoubleType()), lambda b: rows_of(self.flow.inverse(matrix(b.column("q")) * w))))
        levels = both.select(F.posexplode("q").alias("d", "q")).groupBy("d", "q").agg(F.count("*").alias("c"))
        n = both.count()
        bits = levels.agg((-F.sum(F.col("c") / n * F.log2(F.col("c") / n))).alias("b")).first().b if n else 0.0
        return both, float(bits or 0.0)

    def timescale_error(self, frames: DataFrame, states: int = 50, x: str = "cv", seed: int = 0) -> dict:
        """What rounding does to the slowest timescale on common hard states."""
        both, bits = self.rounded(frames, x)
        cells, centres = geometry.discretise(both, states, seed, x)
        slowest = []
        for df in (cells, geometry.assign(both, centres, "back")):
            c = kinetics.dense_counts(counts.transition_counts(df, self.lag).collect(), len(centres))  # states^2 rows
            act = kinetics.largest_connected_set(c)
            slowest.append(float(kinetics.implied_timescales(kinetics.estimate(c[np.ix_(act, act)])[0], self.lag, 1)[0]))
        return {"bits": bits, "reference": slowest[0], "decoded": slowest[1], "error": abs(slowest[1] - slowest[0]) / slowest[0]}


class Standardised:
    """What stands in for a flow where bits are shared out among the features themselves: standardising alone."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std = mean, std

    def forward(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std

    def inverse(self, z: np.ndarray) -> np.ndarray:
        return z * self.std + self.mean


def shared_bits(frames: DataFrame, soft: SoftModel, lag: int, bits: float, kind: str = "kinetic", x: str = "cv", steps: int = 40, rate: float = 0.2, reach: float = 0.05, seed: int = 0) -> tuple[np.ndarray, float]:
    """(bits of each feature, loss) when ``bits`` in all are shared out by a softmax; a feature of b bits has steps of its deviation over 2^b."""
    which = {"kinetic": 1, "mse": 2}[kind]
    own = Allocation(Standardised(soft.mean, soft.std), soft, lag)
    d = len(soft.mean)
    table, adam, theta = _pairs(frames, x, lag), Adam(rate), np.zeros(d)
    tasks = table.rdd.getNumPartitions()

    def share(v: np.ndarray) -> np.ndarray:
        e = np.exp(v - v.max(-1, keepdims=True))
        return bits * e / e.sum(-1, keepdims=True)

    for turn in range(steps):
        around = np.concatenate([theta + reach * np.eye(d), theta - reach * np.eye(d)])
        loss = np.array([s[which] for s in own.scored(table, -share(around) * np.log(2), seed + turn, tasks)])
        theta = adam.step(theta, (loss[:d] - loss[d:]) / (2 * reach) / max(loss.mean(), 1e-12))
    out = share(theta)
    loss = own.scored(table, -out[None] * np.log(2), seed, tasks)[0][which]
    dropped(table)
    return out, loss


def rate_distortion(frames: DataFrame, flow: Flow, soft: SoftModel, lag: int, weights: list[float], kind: str = "kinetic", x: str = "cv", states: int = 50, **fit) -> list[dict]:
    """An operating point for each weight: bits, distortions and the timescale's error."""
    out, table = [], _pairs(frames, x, lag)
    for weight in weights:
        own = Allocation(flow, soft, lag).fit(frames, weight, kind, x, **fit)
        bits, kinetic, mse = own.scored(table, own.log_width[None], 0)[0]
        out.append({"weight": weight, "kind": kind, "ideal_bits": bits, "kinetic": kinetic, "mse": mse} | own.timescale_error(frames, states, x))
    dropped(table)
    return out
