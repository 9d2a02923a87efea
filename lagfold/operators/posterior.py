"""Samples of reversible Markov models given counts: chains run in tasks, samples are rows.

The state is a symmetric matrix of flows x with the scale-free prior prod dx / x; a model is x over its row sums.
Metropolis steps change the logarithm of one flow at a time, so detailed balance holds for every
sample.  With two states the chance of leaving state i has the law Beta(c_ij, c_ii).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lagfold.functions import kinetics
from lagfold.shipping import ship


def chain(c: np.ndarray, samples: int, seed: int, burn: int = 50, thin: int = 5, spread: float = 1.5) -> Iterator[np.ndarray]:
    """Transition matrices of one chain, ``thin`` sweeps apart, after ``burn`` sweeps; states must be connected."""
    rng = np.random.default_rng(seed)
    both, rows = c + c.T, c.sum(1)
    x = np.where(both > 0, both, 0.0) / 2
    i, j = np.nonzero(np.triu(both))
    weight = np.where(i == j, c[i, j], both[i, j])
    width = spread / np.sqrt(np.maximum(weight, 1))
    total = x.sum(1)
    for sweep in range(burn + samples * thin):
        noise, chance = rng.normal(size=len(i)) * width, np.log(rng.random(len(i)))
        for n, (a, b) in enumerate(zip(i, j)):
            old = x[a, b]
            new = old * np.exp(noise[n])
            ta = total[a] + new - old
            gain = weight[n] * noise[n] - rows[a] * np.log(ta / total[a])
            if a != b:
                tb = total[b] + new - old
                gain -= rows[b] * np.log(tb / total[b])
            if chance[n] < gain:
                x[a, b] = x[b, a] = new
                total[a] = ta
                if a != b:
                    total[b] = tb
        total = x.sum(1)
        if sweep >= burn and (sweep - burn) % thin == 0:
            yield x / total[:, None]


def sampled(spark: SparkSession, c: np.ndarray, lag: float, k: int, samples: int = 100, chains: int = 8, seed: int = 0, effective: bool = True) -> DataFrame:
    """``(chain, n, t, timescales)``: a row a sample of the largest connected set; with ``effective`` sliding counts are divided by the lag."""
    ship(spark)
    act = kinetics.largest_connected_set(c)
    own = c[np.ix_(act, act)] / (lag if effective else 1)
    each = -(-samples // chains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in pdf["id"]:
                for m, t in enumerate(chain(own, min(each, samples - int(n) * each), seed * 1000 + int(n))):
                    its = kinetics.implied_timescales(t, lag, k)
                    yield pd.DataFrame({"chain": [int(n)], "n": [m], "t": [t.ravel()], "timescales": [[*its, *[np.nan] * (k - len(its))]]})

    return spark.range(-(-samples // each), numPartitions=-(-samples // each)).mapInPandas(run, "chain int, n int, t array<double>, timescales array<double>")


def timescales(spark: SparkSession, c: np.ndarray, lag: float, k: int, samples: int = 100, **more) -> np.ndarray:
    """(samples, k) timescales."""
    return np.array([r.timescales for r in sampled(spark, c, lag, k, samples, **more).select("timescales").collect()], float).reshape(-1, k)
