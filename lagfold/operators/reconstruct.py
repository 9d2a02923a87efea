"""Full-length frames from kept ones: each frame is its state's representative, kept frames are themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfold.operators import stats


def representatives(kept: DataFrame, centres: DataFrame, dims: list[str]) -> DataFrame:
    """``(state, run_id, t, used)``: the kept frame nearest to each state's centre.

    A state without kept frames uses the representative of the nearest state that has one.
    """
    own = stats.medoids(kept, centres, dims).select("state", "run_id", "t")
    occupied = centres.join(own.select("state"), "state", "left_semi")
    used = stats.nearest(centres.withColumnRenamed("state", "own"), occupied, dims).select(F.col("own").alias("state"), F.col("state").alias("used"))
    return used.join(F.broadcast(own.withColumnRenamed("state", "used")), "used").select("state", "run_id", "t", "used")  # a row per state


def check_kept(dtraj: DataFrame, kept: DataFrame) -> None:
    """Raise if a kept frame's state isn't the one of the trajectory."""
    wrong = kept.select("run_id", "t", "state").join(dtraj.select("run_id", "t", "state"), ["run_id", "t", "state"], "left_anti")
    if wrong.limit(1).count():
        raise ValueError("kept frames don't match the state trajectory")


def full_length(dtraj: DataFrame, kept: DataFrame, centres: DataFrame, dims: list[str], payload: str = "xyz") -> DataFrame:
    """``(run_id, t, state, <payload>)`` for every frame of ``dtraj``.

    ``kept`` has ``(run_id, t, state, dims, payload)``; ``centres`` has ``(state, dims)``.
    """
    check_kept(dtraj, kept)
    of_state = representatives(kept, centres, dims).select("state", F.col("run_id").alias("_r"), F.col("t").alias("_t"))
    frames = of_state.join(kept.select(F.col("run_id").alias("_r"), F.col("t").alias("_t"), F.col(payload).alias("_rep")), ["_r", "_t"]).select("state", "_rep")
    own = kept.select("run_id", "t", F.col(payload).alias("_own"))
    rows = dtraj.select("run_id", "t", "state").join(F.broadcast(frames), "state", "left")  # a frame per state
    return rows.join(own, ["run_id", "t"], "left").select("run_id", "t", "state", F.coalesce("_own", "_rep").alias(payload))
