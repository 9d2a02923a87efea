"""Streaming transition counts: the last ``lag`` states of each run are kept between micro-batches.

A run's rows must arrive in order from batch to batch; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run_id long, i int, j int, c long"


def stream_counts(frames: DataFrame, lag: int = 1, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """A streaming table of count increments from a stream of ``(run_id, <order>, state)``; sum them by (i, j)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(list(order))
        tail = list(state.get[0]) if state.exists else []
        s = np.array(tail + pdf["state"].tolist(), np.int64)
        state.update((s[-lag:].tolist(),))
        if len(s) > lag:
            pairs, c = np.unique(np.stack([s[:-lag], s[lag:]], 1), axis=0, return_counts=True)
            yield pd.DataFrame({"run_id": key[0], "i": pairs[:, 0].astype(np.int32), "j": pairs[:, 1].astype(np.int32), "c": c})

    return frames.groupBy("run_id").applyInPandasWithState(update, SCHEMA, "tail array<int>", "append", GroupStateTimeout.NoTimeout)


MOMENTS = "run_id long, n long, nt long, sx array<double>, c0 array<double>, ct array<double>, a array<double>, b array<double>"


def stream_moments(frames: DataFrame, lag: int = 1) -> DataFrame:
    """A streaming table of moment increments from ``(run_id, t, x)``; their sum is that of the batch fit."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("t")
        new = np.stack(pdf["x"].to_list()).astype(float)
        d = new.shape[1]
        tail = np.array(state.get[0], float).reshape(-1, d) if state.exists and state.get[0] else np.zeros((0, d))
        x = np.concatenate([tail, new])
        state.update((x[-lag:].ravel().tolist(),))
        first, second = x[:-lag], x[lag:]
        flat = lambda m: [m.ravel().tolist()]
        yield pd.DataFrame({"run_id": key[0], "n": [len(new)], "nt": [len(second)], "sx": flat(new.sum(0)), "c0": flat(new.T @ new), "ct": flat(first.T @ second), "a": flat(first.sum(0)), "b": flat(second.sum(0))})

    return frames.groupBy("run_id").applyInPandasWithState(update, MOMENTS, "tail array<double>", "append", GroupStateTimeout.NoTimeout)
