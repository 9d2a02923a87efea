"""The flow codec over streams of frame files: three passes, each resumable.

Pass 1 sums moments with a keyed tail of each run; pass 2 writes the slow modes of each micro-batch; flow, cells and
selection work on these few numbers a frame; pass 3 gathers the kept frames.  A pass is a query with
its own checkpoint that ends with what is there; a micro-batch that is run again overwrites what it had written, so a
killed pass goes on where it stopped.  Frames of a run must arrive in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfold.operators import geometry
from lagfold.shipping import ship
from lagfold.sources.artifact import Artifact
from lagfold.streaming.counts import stream_moments


def _batches(frames: DataFrame, folder: str, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of each micro-batch, below ``folder``; every batch has a place of its own."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    q = frames.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return frames.sparkSession.read.parquet(f"{folder}/{name}").drop("batch")


def streamed_modes(source: Callable[[], DataFrame], ref: np.ndarray, folder: str, lag: int, dim: int) -> geometry.Tica:
    """Slow modes of the aligned frames from additive moments."""
    frames = source()
    aligned = geometry.kabsch(frames.select("run_id", "t", "xyz"), ref).select("run_id", "t", F.col("aligned").alias("x"))
    q = stream_moments(aligned, lag).writeStream.format("parquet").option("path", f"{folder}/moments").option("checkpointLocation", f"{folder}/moments-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = frames.sparkSession.read.parquet(f"{folder}/moments")
    added = lambda c: np.array([r.v for r in rows.select(F.posexplode(c).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()])  # noqa: E731  3N or 9N^2 numbers
    n, nt = rows.agg(F.sum("n"), F.sum("nt")).first()
    if not n:
        raise ValueError("no frames to fit")
    d = len(ref) * 3
    square = lambda c: added(c).reshape(d, d)
    z = np.zeros((d, d))
    model = geometry.Tica(lag, dim)
    model.parts = [((n, added("sx"), added("sx"), square("c0"), z, z), (nt, added("a"), added("b"), z, square("ct"), z))]
    return model.finalise()


def compress(spark: SparkSession, source: Callable[[], DataFrame], ref: np.ndarray, folder: str, lag: int = 10, dim: int = 6, **more) -> tuple[Artifact, dict]:
    """(artifact, report) of a stream ``(run_id, t, xyz)``; ``source`` opens it anew for each pass, ``folder`` is shared and holds what passes have reached.

    ``ref``: the frame to align to, (atoms, 3).  ``more``: what ``flowcodec.fit_encode`` takes.
    """
    from lagfold.plans import flowcodec

    ship(spark)
    model = streamed_modes(source, ref, folder, lag, dim)
    moved = lambda b: model.transform(geometry.kabsch(b.select("run_id", "t", "xyz"), ref), "aligned", "cv").select("run_id", "t", "cv")
    cvs = _batches(source(), folder, "cvs", moved)

    def gather(kept: DataFrame) -> DataFrame:
        wanted = kept.select("run_id", "t", "k", "state")
        return _batches(source(), folder, "kept", lambda b: b.join(wanted, ["run_id", "t"]).select("run_id", "t", "xyz", "k", "state"))

    return flowcodec.fit_encode(None, lag, dim, cvs=cvs, ref=ref, fetch=gather, model=model, **more)
