"""Coding of runs in blocks of frames: one Arrow group a block, the model sent with the task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfold.functions import coders, kinetics
from lagfold.operators.counts import transition_counts


def markov_model(frames: DataFrame, states: int) -> tuple[np.ndarray, np.ndarray]:
    """(T, pi) of the lag-1 counts, in counts' order of states."""
    c = kinetics.dense_counts(transition_counts(frames, 1).collect(), states)  # states^2 rows
    t = kinetics.row_normalised(c)
    t[t.sum(1) == 0] = 1 / states
    first = frames.groupBy("state").agg(F.count("*").alias("c")).collect()
    pi = np.zeros(states)
    for r in first:
        pi[r.state] = r.c
    return t, pi / max(pi.sum(), 1)


#: Frames that are coded together; each block starts anew, so that a run is coded and decoded by many tasks.
BLOCK = 4096
#: Decoded frames of several blocks that leave a task together.
TOGETHER = 4096
_STREAM = "run_id long, block long, n long, t0 long, step long, ts array<long>, stream binary"


def _blocks(frames: DataFrame, column: str, block: int):
    return frames.select("run_id", "t", column, F.floor(F.col("t") / block).cast("long").alias("block")).groupBy("run_id", "block")


def _row(pdf: pd.DataFrame, stream: bytes) -> pd.DataFrame:
    """A coded block; its times are a first one and a step, or a list where they aren't evenly spaced."""
    t = pdf["t"].to_numpy()
    step = int(t[1] - t[0]) if len(t) > 1 else 1
    even = (np.diff(t) == step).all()
    return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(t)], "t0": [int(t[0])], "step": [step], "ts": [None if even else t.tolist()], "stream": [stream]})


def _times(r) -> np.ndarray:
    return r.t0 + r.step * np.arange(r.n) if r.ts is None else np.asarray(r.ts, np.int64)


def encode_runs(frames: DataFrame, t: np.ndarray, pi: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``(run_id, block, n, t0, step, ts, stream)``: states, range coded under the Markov model; ``t`` may have gaps."""

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return _row(pdf, coders.encode_markov(pdf["state"].tolist(), t, pi))

    return _blocks(frames, "state", block).applyInPandas(code, _STREAM)


def decode_runs(streams: DataFrame, t: np.ndarray, pi: np.ndarray) -> DataFrame:
    """``(run_id, t, state)`` of coded blocks."""

    def decode(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                s = coders.decode_markov(bytes(r.stream), int(r.n), t, pi)
                yield pd.DataFrame({"run_id": r.run_id, "t": _times(r), "state": np.array(s, np.int32)})

    return streams.select("run_id", "n", "t0", "step", "ts", "stream").mapInPandas(decode, "run_id long, t long, state int")


def encode_levels(rows: DataFrame, levels: int, zmax: float, block: int = 4096) -> DataFrame:
    """``(run_id, block, n, stream)`` of ``(run_id, t, level)`` under a static normal table, in blocks of a run."""
    cum = coders.gaussian_table(levels, zmax)

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.sort_values("t")["level"].tolist()
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(q)], "stream": [coders.encode_iid(q, cum)]})

    tagged = rows.select("run_id", "t", "level", F.floor(F.col("t") / block).cast("long").alias("block"))
    return tagged.groupBy("run_id", "block").applyInPandas(code, "run_id long, block long, n long, stream binary")


def decode_levels(streams: DataFrame, levels: int, zmax: float, block: int = 4096) -> DataFrame:
    cum = coders.gaussian_table(levels, zmax)

    def decode(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                q = coders.decode_iid(bytes(r.stream), int(r.n), cum)
                yield pd.DataFrame({"run_id": r.run_id, "t": r.block * block + np.arange(len(q)), "level": np.array(q, np.int32)})

    return streams.mapInPandas(decode, "run_id long, t long, level int")


def predictive_levels(frames: DataFrame, coefficient: float, scale: float, bits: int, reach: float = 8.0, seed: int = 0) -> DataFrame:
    """Closed-loop prediction of ``z`` within each run: ``(run_id, t, level, back)``.

    The predictor sees only decoded values, so the decoder can follow; the innovation is
    standardised, dithered and quantised to ``bits`` over [-reach, reach].
    """
    n = 1 << bits
    step = 2 * reach / n

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        run, last, level, back = int(pdf["run_id"].iloc[0]), 0.0, [], []
        for t, z in zip(pdf["t"], pdf["z"]):
            u = ((int(t) * 1103515245 + 12345 + 7919 * seed + 104729 * run) % 2147483648) / 2147483648.0 - 0.5
            guess = coefficient * last
            q = int(np.clip(np.floor((z - guess) / scale / step + u + n / 2), 0, n - 1))
            last = guess + scale * (q - n / 2 - u + 0.5) * step
            level.append(q)
            back.append(last)
        return pd.DataFrame({"run_id": run, "t": pdf["t"], "level": np.array(level, np.int32), "back": back})

    return frames.select("run_id", "t", "z").groupBy("run_id").applyInPandas(loop, "run_id long, t long, level int, back double")


def predictive_back(levels: DataFrame, coefficient: float, scale: float, bits: int, reach: float = 8.0, seed: int = 0) -> DataFrame:
    """``(run_id, t, back)`` from the levels of ``predictive_levels`` alone: the decoder predicts from what it has decoded."""
    n = 1 << bits
    step = 2 * reach / n

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        run, last, back = int(pdf["run_id"].iloc[0]), 0.0, []
        for t, q in zip(pdf["t"], pdf["level"]):
            u = ((int(t) * 1103515245 + 12345 + 7919 * seed + 104729 * run) % 2147483648) / 2147483648.0 - 0.5
            last = coefficient * last + scale * (q - n / 2 - u + 0.5) * step
            back.append(last)
        return pd.DataFrame({"run_id": run, "t": pdf["t"], "back": back})

    return levels.select("run_id", "t", "level").groupBy("run_id").applyInPandas(loop, "run_id long, t long, back double")


class LinearPredictor:
    """The next vector's mean and log deviation from the last decoded one; before the first, a standard normal law."""

    def __init__(self, a: np.ndarray, b: np.ndarray, log_s: np.ndarray):
        self.a, self.b, self.log_s = np.asarray(a, float), np.asarray(b, float), np.asarray(log_s, float)
        self.dim = len(self.b)

    @staticmethod
    def fit(frames: DataFrame, z: str = "z") -> "LinearPredictor":
        """Least squares on the pairs of successive frames; what is left gives the deviations."""
        from lagfold.operators.counts import lag_pairs
        from lagfold.operators.geometry import moments

        n, sx, sy, xx, xy, yy = moments(lag_pairs(frames, 1, columns=(z,)), z, f"next_{z}")
        mx, my = sx / n, sy / n
        cxx, cxy = xx / n - np.outer(mx, mx), xy / n - np.outer(mx, my)
        a = np.linalg.solve(cxx + 1e-9 * np.eye(len(mx)), cxy)
        left = np.diag(yy / n - np.outer(my, my)) - np.einsum("ij,ij->j", a, cxy)
        return LinearPredictor(a, my - mx @ a, 0.5 * np.log(np.maximum(left, 1e-12)))

    def start(self):
        return None, np.zeros(self.dim), np.zeros(self.dim)

    def after(self, state, z: np.ndarray):
        return None, z @ self.a + self.b, self.log_s


def _noise(seed: int, run: int, t: np.ndarray, dim: int) -> np.ndarray:
    from lagfold.plans.codec import draws

    return draws(seed, np.full(len(t), run), t, dim)


def encode_predictive(frames: DataFrame, model, bits: int, reach: float = 8.0, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``(run_id, block, n, t0, step, ts, stream)`` of ``(run_id, t, z)``: standardised innovations, dithered, quantised and range coded under a normal law.

    The loop is closed: predictions come from decoded vectors, so the decoder makes the same ones.  ``model`` has
    ``start()``, a state, and ``after(state, z)``, the next state, mean and log deviation (see ``LinearPredictor``).
    """
    levels = 1 << bits
    step, cum, dim = 2 * reach / levels, coders.gaussian_table(levels, reach).tolist(), model.dim

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        run, z = int(pdf["run_id"].iloc[0]), np.stack(pdf["z"].to_list()).astype(float)
        noise, out = _noise(seed, run, pdf["t"].to_numpy(), dim) * step, coders.Encoder()
        state, mean, log_s = model.start()
        for row, u in zip(z, noise):
            s = np.exp(log_s)
            x = np.minimum(np.maximum((row - mean) / s + u, -reach), reach)
            q = np.minimum(np.maximum(np.floor((x + reach) / step), 0), levels - 1)
            for k in q.astype(int).tolist():
                out.push(cum[k], cum[k + 1])
            last = mean + s * ((q + 0.5) * step - reach - u)
            state, mean, log_s = model.after(state, last)
        return _row(pdf, out.finish())

    return _blocks(frames, "z", block).applyInPandas(code, _STREAM)


def decode_predictive(streams: DataFrame, model, bits: int, reach: float = 8.0, seed: int = 0) -> DataFrame:
    """``(run_id, t, z)`` of the streams, frame by frame."""
    levels = 1 << bits
    step, cum, dim = 2 * reach / levels, coders.gaussian_table(levels, reach).tolist(), model.dim

    def decode(batches):
        for pdf in batches:
            runs, at, out = [], [], []
            for r in pdf.itertuples():
                source, times = coders.Decoder(bytes(r.stream)), _times(r)
                state, mean, log_s = model.start()
                for u in _noise(seed, int(r.run_id), times, dim) * step:
                    s, q = np.exp(log_s), np.array([source.pull(cum) for _ in range(dim)])
                    last = mean + s * ((q + 0.5) * step - reach - u)
                    state, mean, log_s = model.after(state, last)
                    out.append(last)
                runs.append(np.full(len(times), r.run_id))
                at.append(times)
                if len(out) >= TOGETHER:
                    yield pd.DataFrame({"run_id": np.concatenate(runs), "t": np.concatenate(at), "z": out})
                    runs, at, out = [], [], []
            if out:
                yield pd.DataFrame({"run_id": np.concatenate(runs), "t": np.concatenate(at), "z": out})

    return streams.select("run_id", "n", "t0", "step", "ts", "stream").mapInPandas(decode, "run_id long, t long, z array<double>")


def encode_sequence(frames: DataFrame, model, bits: int, zmax: float, block: int = BLOCK) -> DataFrame:
    """``(run_id, block, n, t0, step, ts, stream)`` of ``(run_id, t, z)``: levels on [-zmax, zmax], each coded under the normal law that ``model`` expects after the levels before."""
    levels = 1 << bits

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        z, out = np.stack(pdf["z"].to_list()).astype(float), coders.Encoder()
        q = np.clip(np.floor((z + zmax) / (2 * zmax) * levels), 0, levels - 1).astype(int)
        state, mean, log_s = model.start()
        for row in q:
            for k, m, s in zip(row.tolist(), mean.tolist(), np.exp(log_s).tolist()):
                below = coders.normal_below(levels, zmax, m, s)
                out.push(below(k), below(k + 1), coders.FINE)
            state, mean, log_s = model.after(state, (row + 0.5) * (2 * zmax / levels) - zmax)
        return _row(pdf, out.finish())

    return _blocks(frames, "z", block).applyInPandas(code, _STREAM)


def decode_sequence(streams: DataFrame, model, bits: int, zmax: float) -> DataFrame:
    """``(run_id, t, q, z)``: the levels, and their bins' middles."""
    levels, dim = 1 << bits, model.dim

    def decode(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                source, rows = coders.Decoder(bytes(r.stream)), []
                state, mean, log_s = model.start()
                for _ in range(int(r.n)):
                    rows.append([source.pull_by(coders.normal_below(levels, zmax, m, s), levels, coders.FINE) for m, s in zip(mean.tolist(), np.exp(log_s).tolist())])
                    state, mean, log_s = model.after(state, (np.array(rows[-1]) + 0.5) * (2 * zmax / levels) - zmax)
                q = np.array(rows, np.int32).reshape(-1, dim)
                yield pd.DataFrame({"run_id": r.run_id, "t": _times(r), "q": list(q), "z": list((q + 0.5) * (2 * zmax / levels) - zmax)})

    return streams.select("run_id", "n", "t0", "step", "ts", "stream").mapInPandas(decode, "run_id long, t long, q array<int>, z array<double>")
