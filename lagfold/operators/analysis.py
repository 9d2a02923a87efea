"""Analysis of state trajectories to the end: lag scans, bootstrap intervals, Chapman-Kolmogorov tests.

Counts are grouped aggregates; states x states numbers reach the driver, or a task for each replicate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfold.functions import kinetics
from lagfold.operators import counts
from lagfold.operators.frames import offsets, stride
from lagfold.operators.tables import written
from lagfold.shipping import ship


def shortest_run(frames: DataFrame) -> int:
    return frames.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0


def usual_lags(base: int) -> list[int]:
    """A quarter to four times the lag."""
    return sorted({max(1, int(base * f)) for f in (0.25, 0.5, 1, 2, 4)})


def lag_scan(frames: DataFrame, lags: list[int], k: int, states: int) -> list[tuple[int, np.ndarray]]:
    """(lag, k timescales) of the lags below half the shortest run, in one pass; NaN where no estimate is possible."""
    half = shortest_run(frames) // 2
    lags = [n for n in lags if n < half]
    got = counts.counts_by_lag(frames, lags).collect() if lags else []
    out = []
    for lag in lags:
        c = kinetics.dense_counts([(r.i, r.j, r.c) for r in got if r.lag == lag], states)
        its = np.full(k, np.nan)
        try:
            own = kinetics.implied_timescales(kinetics.reversible_mle(c)[0], lag, k)
            its[: len(own)] = own
        except ValueError:
            pass
        out.append((lag, its))
    return out


def mlmsm(frames: DataFrame, lag: int, states: int, count_mode: str = "sliding", reversible: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, active states, long-run shares) of the largest connected set.

    ``count_mode``: ``sliding`` pairs, every ``lag``-th frame only (``sample``), or sliding counts over the lag (``effective``).
    """
    if count_mode not in ("sliding", "sample", "effective"):
        raise ValueError("count_mode is sliding, sample or effective")
    rows = stride(frames, lag) if count_mode == "sample" else frames
    c = kinetics.dense_counts(counts.transition_counts(rows, 1 if count_mode == "sample" else lag).collect(), states)  # states^2 rows
    c = c / lag if count_mode == "effective" else c
    act = kinetics.largest_connected_set(c)
    own = c[np.ix_(act, act)]
    t = kinetics.estimate(own)[0] if reversible else kinetics.row_normalised(own)
    return t, act, kinetics.stationary_distribution(t)


def bootstrap_timescales(frames: DataFrame, lag: int, k: int, states: int, replicates: int = 100, blocks: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean, low, high) of the timescales: means and 95% percentile intervals over resampled runs; None without a replicate.

    Each replicate draws as many runs as there are, with replacement; a single run is cut into ``blocks`` first.  The draws are a
    table of replicates x runs hashed ranks; each run is counted once, a draw is a weight on its counts.
    """
    ship(frames.sparkSession)
    spark = frames.sparkSession
    if frames.select("run_id").distinct().limit(2).count() == 1:
        size = -(-frames.count() // blocks)
        frames = frames.withColumn("run_id", F.floor(F.col("t") / size).cast("long"))
    runs = written(frames.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > lag).select("run_id", F.lit(1).cast("long").alias("one")))
    n = runs.count()
    if not n:
        return None
    numbered = offsets(runs, "run_id", "one", "nth").select("run_id", "nth")
    drawn = spark.range(replicates * n).select(F.expr(f"cast(id div {n} as int)").alias("replicate"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("nth"))
    weights = drawn.groupBy("replicate", "nth").agg(F.count("*").alias("w"))
    own = counts.lag_pairs(frames.select("run_id", "t", "state"), lag).groupBy("run_id", F.col("state").alias("i"), F.col("next_state").alias("j")).agg(F.count("*").alias("c"))
    drawn = own.join(numbered, "run_id").join(weights, "nth").groupBy("replicate", "i", "j").agg(F.sum(F.col("c") * F.col("w")).alias("c"))

    def scales(pdf: pd.DataFrame) -> pd.DataFrame:
        c = kinetics.dense_counts(pdf[["i", "j", "c"]].itertuples(index=False), states)
        try:
            its = kinetics.implied_timescales(kinetics.reversible_mle(c)[0], lag, k)
        except ValueError:
            return pd.DataFrame({"its": []})
        return pd.DataFrame({"its": [its.tolist() + [float("nan")] * (k - len(its))]})

    got = [r.its for r in drawn.groupBy("replicate").applyInPandas(scales, "its array<double>").collect()]
    if not got:
        return None
    s = np.array(got, float)  # null: fewer states than timescales
    return s.mean(0), np.percentile(s, 2.5, 0), np.percentile(s, 97.5, 0)


def ck_test(frames: DataFrame, lag: int, states: int, sets: int = 2, factors: tuple[int, ...] = (1, 2, 3, 4, 6)) -> dict[int, float]:
    """For each factor, the largest difference of staying probabilities between T(factor lag) and T(lag)^factor."""
    got = counts.counts_by_lag(frames, [lag * f for f in factors]).collect()
    dense = {f: kinetics.dense_counts([(r.i, r.j, r.c) for r in got if r.lag == lag * f], states) for f in factors}
    act = kinetics.largest_connected_set(dense[1])
    t = {f: kinetics.transition_matrix(c[np.ix_(act, act)]) for f, c in dense.items()}
    return kinetics.ck_deviation({f: x[0] for f, x in t.items()}, kinetics.metastable_sets(*t[1], sets), t[1][1], factors)
