"""The classical codec: align, slow modes, cells, Markov model, range-coded states, dithered residuals; and its inverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfold.functions import kinetics
from lagfold.operators import coding, counts, geometry
from lagfold.sources.artifact import Artifact


def draws(seed: int, run: np.ndarray, t: np.ndarray, dims: int) -> np.ndarray:
    """Dither in [-1/2, 1/2) of (seed, run, t, dim): a counter-based hash, the same on both sides and in any partition."""
    x = (run.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + t.astype(np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03)) + np.arange(dims, dtype=np.uint64)[None] * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) - 0.5


def _mean_table(frames: DataFrame, states: int, width: int) -> np.ndarray:
    """Mean aligned coordinates by state (zeros where a state has none): states x width numbers."""
    got = frames.select("state", F.posexplode("aligned").alias("k", "v")).groupBy("state", "k").agg(F.avg("v").alias("m")).collect()
    out = np.zeros((states, width))
    for r in got:
        out[r.state, r.k] = r.m
    return out


def fit_encode(frames: DataFrame, lag: int = 1, dim: int = 2, states: int = 100, n_bits: int = 4, seed: int = 0) -> Artifact:
    """Encode ``(run_id, t, xyz)``; the artifact holds all that decoding and analysis need."""
    ref = geometry.reference_frame(frames)
    width = ref.size
    aligned = geometry.kabsch(frames.select("run_id", "t", "xyz"), ref).select("run_id", "t", "aligned")
    modes = geometry.Tica(lag, dim).fit(aligned, "aligned")
    cells, centres = geometry.discretise(modes.transform(aligned, "aligned", "cv"), states, seed)
    cells = cells.persist()
    states = len(centres)
    t, pi = coding.markov_model(cells, states)
    means = _mean_table(cells, states, width)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r = np.stack(pdf["aligned"].to_list()) - means[pdf["state"].to_numpy()]
                yield pd.DataFrame({"n": [r.size], "s": [r.sum()], "q": [(r * r).sum()]})

    m = cells.select("state", "aligned").mapInPandas(spread, "n long, s double, q double").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    std = max(m.q / m.n - (m.s / m.n) ** 2, 0.0) ** 0.5
    step = (std + 1e-12) * 2.0 ** (1 - n_bits) * 3

    def residual(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r = np.stack(pdf["aligned"].to_list()) - means[pdf["state"].to_numpy()]
                q = np.rint(r / step + draws(seed, pdf["run_id"].to_numpy(), pdf["t"].to_numpy(), width)).astype(np.int32)
                yield pd.DataFrame({"run_id": pdf["run_id"], "t": pdf["t"], "q": list(q)})

    spark = frames.sparkSession
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = counts.transition_counts(cells, lag)
    config = {"lag": lag, "n_states": states, "n_bits": n_bits, "seed": seed, "step": step, "width": width, "pi": pi.tolist(), "t": t.tolist(), "reference": ref.ravel().tolist()}
    return Artifact(config, {
        "dtraj": cells.select("run_id", "t", "state"), "counts": c, "streams": coding.encode_runs(cells, t, pi),
        "centres": table([(k, v.tolist()) for k, v in enumerate(centres)], "state int, c array<double>"),
        "state_mean": table([(k, v.tolist()) for k, v in enumerate(means)], "state int, r array<double>"),
        "residual": cells.select("run_id", "t", "state", "aligned").mapInPandas(residual, "run_id long, t long, q array<int>"),
    })


def decode(artifact: Artifact) -> DataFrame:
    """``(run_id, t, state, xyz)`` from the coded states and residuals; a residual for every frame is required."""
    cfg = artifact.config
    states = coding.decode_runs(artifact.tables["streams"], np.array(cfg["t"]), np.array(cfg["pi"]))
    joined = states.join(artifact.tables["residual"], ["run_id", "t"], "left")
    means = np.zeros((cfg["n_states"], cfg["width"]))
    for r in artifact.tables["state_mean"].collect():  # states rows
        means[r.state] = r.r
    step, seed, width = cfg["step"], cfg["seed"], cfg["width"]

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                if pdf["q"].isna().any():
                    raise ValueError("a frame has no residual")
                q = np.stack(pdf["q"].to_list()).astype(float)
                x = (q - draws(seed, pdf["run_id"].to_numpy(), pdf["t"].to_numpy(), width)) * step + means[pdf["state"].to_numpy()]
                yield pd.DataFrame({"run_id": pdf["run_id"], "t": pdf["t"], "state": pdf["state"], "xyz": list(x)})

    return joined.mapInPandas(rebuild, "run_id long, t long, state int, xyz array<double>")


def report(artifact: Artifact) -> dict:
    """Bits charged and used, and the timescales of the connected set."""
    cfg, tables = artifact.config, artifact.tables
    stream = tables["streams"].agg(F.sum("n").alias("frames"), F.sum(F.length("stream") * 8).alias("bits")).first()
    c = artifact.counts()
    act = kinetics.largest_connected_set(c)
    t, _ = kinetics.transition_matrix(c[np.ix_(act, act)])
    side = 64 * (cfg["n_states"] * (cfg["width"] + 1) + cfg["n_states"] ** 2)
    original = 64 * cfg["width"] * stream.frames
    charged = stream.bits + cfg["n_bits"] * cfg["width"] * stream.frames
    return {"frames": stream.frames, "stream_bits": stream.bits, "charged_bits": charged, "side_bits": side, "original_bits": original, "ratio": original / (charged + side), "timescales": kinetics.implied_timescales(t, cfg["lag"], 3).tolist()}


def contrast(reference: DataFrame, candidates: dict[str, DataFrame], states: int, lag: int = 1) -> DataFrame:
    """A row per candidate ``(run_id, t, state)``: the bound against the reference, on the reference's connected set."""
    spark: SparkSession = reference.sparkSession
    ref = kinetics.dense_counts(counts.transition_counts(reference, lag).collect(), states)
    act = kinetics.largest_connected_set(ref)
    p = kinetics.transition_matrix(ref[np.ix_(act, act)])[0]
    rows = []
    for name, df in candidates.items():
        own = kinetics.dense_counts(counts.transition_counts(df, lag).collect(), states)[np.ix_(act, act)]
        f = kinetics.fidelity(p, kinetics.transition_matrix(own)[0], lag)
        rows.append((name, f.ensemble, f.transition, f.two_slice, f.support_ok))
    return spark.createDataFrame(rows, "method string, ensemble double, transition double, two_slice double, support_ok boolean")
