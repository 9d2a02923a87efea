"""Frames kept for coverage: farthest-point sampling on vectors, and the weights that undo its bias.

The serial rule takes the frame farthest from all frames taken so far, ties to the earlier one.
Here each pass keeps, beside every vector, its least squared distance to the frames taken; the
globally farthest ``pool`` vectors come to the driver, which applies the rule to them until a frame outside
the pool could be next.  So a pass gives many picks, and the picks are those of the serial rule.
A block of vectors that lies farther from a new pick than its largest least distance is skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.operators.sums import matrix, rows_of, vector_sum
from lagfold.operators.tables import dropped, written

_TOP = T.StructType([T.StructField(n, k) for n, k in (("d", T.DoubleType()), ("run_id", T.LongType()), ("t", T.LongType()), ("x", T.ArrayType(T.DoubleType())))])
_STATE = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("run", "t", "x", "d")], T.StructField("top", T.ArrayType(_TOP))])


def _state(run: np.ndarray, t: np.ndarray, x: np.ndarray, d: np.ndarray, pool: int) -> pa.RecordBatch:
    far = np.lexsort((t, run, -d))[:pool]
    far = far[d[far] >= 0]
    top = pa.StructArray.from_arrays([pa.array(d[far]), pa.array(run[far]), pa.array(t[far]), rows_of(x[far])], ["d", "run_id", "t", "x"])
    raw = [pa.array([v.tobytes()], pa.binary()) for v in (run.astype("<i8"), t.astype("<i8"), x.astype("<f8"), d.astype("<f8"))]
    return pa.RecordBatch.from_arrays([pa.array([len(d)], pa.int32()), *raw, pa.ListArray.from_arrays(pa.array([0, len(far)], pa.int32()), top)], _STATE.names)


def nearer(x: np.ndarray, d: np.ndarray, run: np.ndarray, t: np.ndarray, picks: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Least squared distances after more picks; a picked frame has -1."""
    middle = x.mean(0)
    radius = np.sqrt(((x - middle) ** 2).sum(1).max())
    most = np.sqrt(max(d.max(), 0.0))
    d = d.copy()
    for r, s, c in picks:
        own = (run == r) & (t == s)
        if not own.any() and np.sqrt(((c - middle) ** 2).sum()) * (1 - 1e-9) - radius > most:
            continue
        live = d >= 0
        d[live] = np.minimum(d[live], ((x[live] - c) ** 2).sum(1))
        d[own] = -1.0
    return d


def farthest(frames: DataFrame, count: int, x: str = "z", start: tuple[int, int] | None = None, seed: int = 0, pool: int = 512, block: int = 4096) -> list[tuple[int, int, list[float]]]:
    """``(run_id, t, vector)`` of up to ``count`` frames, in the order in which they are taken.

    The first is ``start``, or else the one with the smallest hash of the seed, run and time.  Frames without a vector
    take no part; with fewer frames than asked for all are taken.
    """
    rows = frames.select(F.col("run_id").cast("long"), F.col("t").cast("long"), F.col(x).alias("x")).where("x is not null")
    first = rows.where((F.col("run_id") == start[0]) & (F.col("t") == start[1])) if start else rows.orderBy(F.xxhash64(F.lit(seed), "run_id", "t"), "run_id", "t")
    one = first.limit(1).first()
    if one is None or count < 1:
        return []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                p = b.slice(at, block)
                yield _state(p.column("run_id").to_numpy(), p.column("t").to_numpy(), matrix(p.column("x")), np.full(p.num_rows, np.inf), 0)

    out = [(one.run_id, one.t, list(one.x))]
    state, new = written(rows.mapInArrow(pack, _STATE)), out[:]
    while len(out) < count:
        picks = [(r, s, np.array(c, float)) for r, s, c in new]

        def update(batches: Iterator[pa.RecordBatch], picks=picks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    run, t, v, d = (np.frombuffer(b.column(c)[k].as_buffer(), kind) for c, kind in (("run", "<i8"), ("t", "<i8"), ("x", "<f8"), ("d", "<f8")))
                    v = v.reshape(len(d), -1)
                    yield _state(run, t, v, nearer(v, d, run, t, picks), pool)

        last, state = state, written(state.select("n", "run", "t", "x", "d", F.lit(None).cast(_STATE["top"].dataType).alias("top")).mapInArrow(update, _STATE))
        dropped(last)
        far = state.select(F.explode("top").alias("p")).select("p.*").orderBy(F.col("d").desc(), "run_id", "t").limit(pool).collect()
        if not far:
            break
        v, d = np.array([r.x for r in far]), np.array([r.d for r in far])
        ids = [(r.run_id, r.t) for r in far]
        bound, whole = (d[-1], ids[-1]), len(far) < pool
        new = []
        while len(out) < count:
            best = max((k for k in range(len(far)) if d[k] >= 0), key=lambda k: (d[k], -k), default=None)
            if best is not None:
                best = min((k for k in range(len(far)) if d[k] == d[best]), key=lambda k: ids[k])
            if best is None or not (whole or d[best] > bound[0] or (d[best] == bound[0] and ids[best] <= bound[1])):
                break
            new.append((*ids[best], v[best].tolist()))
            out.append(new[-1])
            d = np.where(d >= 0, np.minimum(d, ((v - v[best]) ** 2).sum(1)), d)
            d[best] = -1.0
        if not new:
            break
    dropped(state)
    return out


def nearest_kept(y: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The nearest kept vector of each row, ties to the lower index; distances in slices of a few MB."""
    out = np.zeros(len(y), np.int64)
    step = max(1, (1 << 22) // max(1, kept.size))
    for a in range(0, len(y), step):
        out[a : a + step] = ((y[a : a + step, None] - kept) ** 2).sum(2).argmin(1)
    return out


def cell_shares(frames: DataFrame, kept: np.ndarray, x: str = "z") -> np.ndarray:
    """The share of all frames that lie nearest to each kept vector: weights that undo the bias of the selection.

    ``kept`` goes to every task: kept frames times dimensions numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(len(kept))
        for b in batches:
            if b.num_rows:
                total += np.bincount(nearest_kept(matrix(b.column(0)), kept), minlength=len(kept))
        return total

    n = vector_sum(frames.select(x).where(f"`{x}` is not null"), work)
    return n / n.sum()
