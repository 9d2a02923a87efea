"""Alignment, moments, slow modes and clustering over frame tables.

What is proportional to the frames is an Arrow batch operation or a partial aggregate;
what reaches the driver is d x d.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.functions import kinetics
from lagfold.operators.counts import lag_pairs
from lagfold.operators.sums import matrix, pieces, rows_of, vector_sum, with_column


def reference_frame(frames: DataFrame) -> np.ndarray:
    """The first frame, (atoms, 3)."""
    row = frames.orderBy("run_id", "t").limit(1).select("xyz").first()
    return np.array(row.xyz, float).reshape(-1, 3)


def superpose(x: np.ndarray, ref: np.ndarray, at_reference: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(aligned, rmsd) of frames (n, atoms, 3) on a reference, all rotations at once.

    Output is centred at the origin, or at the reference's centroid.
    """
    mean = ref.mean(0)
    p, q = x - x.mean(1, keepdims=True), ref - mean
    u, s, vt = np.linalg.svd(np.einsum("nai,aj->nij", p, q))
    flip = np.sign(np.linalg.det(u @ vt))
    u = u.copy()
    u[:, :, 2] *= flip[:, None]
    aligned = p @ (u @ vt)
    trace = s[:, 0] + s[:, 1] + flip * s[:, 2]
    d2 = ((p**2).sum((1, 2)) + (q**2).sum() - 2 * trace) / x.shape[1]
    return aligned + (mean if at_reference else 0), np.sqrt(np.maximum(d2, 0))


def rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """The distance of two frames (atoms, 3) after the best rotation."""
    return float(superpose(np.asarray(a, float)[None], np.asarray(b, float))[1][0])


def _batched(frames: DataFrame, work: Callable[[np.ndarray], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Add columns made from the coordinates of each batch; frames without coordinates are left out."""
    base = frames.drop(*[f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, *work(matrix(b.column("xyz")).reshape(b.num_rows, -1, 3))], schema.names)

    return base.where("xyz is not null").mapInArrow(run, schema)


def kabsch(frames: DataFrame, ref: np.ndarray | None = None, at_reference: bool = False) -> DataFrame:
    """``frames`` with ``aligned`` (array) and ``rmsd`` to the reference (the first frame)."""
    ref = reference_frame(frames) if ref is None else ref

    def work(x):
        aligned, rmsd = superpose(x, ref, at_reference)
        return [rows_of(aligned.reshape(len(x), -1)), pa.array(rmsd)]

    return _batched(frames, work, [T.StructField("aligned", T.ArrayType(T.DoubleType())), T.StructField("rmsd", T.DoubleType())])


def distances(xyz: np.ndarray, most_atoms: int = 64, separation: int = 2, by_position: bool = False) -> np.ndarray:
    """Distances of pairs of evenly spaced atoms of frames (n, atoms, 3); see ``contacts``."""
    from lagfold.operators.frames import evenly_spaced

    pick = evenly_spaced(xyz.shape[1], most_atoms)
    where = list(range(len(pick))) if by_position else pick
    pairs = [(a, b) for k, a in enumerate(pick) for m, b in enumerate(pick) if m > k and where[m] - where[k] >= separation]
    i, j = np.array(pairs, int).reshape(-1, 2).T
    return np.linalg.norm(xyz[:, i] - xyz[:, j], axis=2)


def contacts(frames: DataFrame, most_atoms: int = 64, separation: int = 2, by_position: bool = False) -> DataFrame:
    """``frames`` with ``x``: distances of pairs of evenly spaced atoms (none if no pair is far enough apart in the chain).

    ``separation`` counts atom indices, or with ``by_position`` places among the chosen atoms.
    """
    return _batched(frames, lambda xyz: [rows_of(distances(xyz, most_atoms, separation, by_position))], [T.StructField("x", T.ArrayType(T.DoubleType()))])


def moments(pairs: DataFrame, x: str = "x", y: str | None = None, only: tuple[str, ...] = ("xx", "xy", "yy")) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sum x, sum y, x'x, x'y, y'y) of an array column (and a second one): one packed row a task, added up in groups.

    Products that aren't asked for are zero; without a second column all are x'x.  Of symmetric
    products a half is moved.  Rows with a null array are left out.
    """
    only = ("xx",) if y is None else only
    named = [c for c in (x, y) if c]

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                a = matrix(batch.column(0))
                b = matrix(batch.column(1)) if y else a
                part = [np.array([len(a), a.shape[1], b.shape[1], 0.0]), a.sum(0), b.sum(0)]
                for u, v, name in ((a, a, "xx"), (a, b, "xy"), (b, b, "yy")):
                    if name in only:
                        p = u.T @ v
                        part.append(p.ravel() if name == "xy" else p[np.triu_indices(len(p))])
                part = np.concatenate(part)
                if total is None:
                    total = part
                else:
                    total += part
                total[1:3] = a.shape[1], b.shape[1]
        if total is not None:
            total[3] = 1.0
        return total

    flat = vector_sum(pairs.select(*named).where(" and ".join(f"`{c}` is not null" for c in named)), work)
    if flat is None:
        z = np.zeros((0, 0))
        return 0, np.zeros(0), np.zeros(0), z, z, z
    (d, e), at = np.rint(flat[1:3] / flat[3]).astype(int).tolist(), 4  # the sizes of all tasks' rows were added up

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return flat[at - n : at]

    sums, out = [take(d), take(e)], {}
    for name, size in (("xx", (d, d)), ("xy", (d, e)), ("yy", (e, e))):
        out[name] = np.zeros(size)
        if name in only and name == "xy":
            out[name] = take(d * e).reshape(size)
        elif name in only:
            half = np.zeros(size)
            half[np.triu_indices(size[0])] = take(size[0] * (size[0] + 1) // 2)
            out[name] = half + np.triu(half, 1).T
    if y is None:
        out["xy"] = out["yy"] = out["xx"]
    return int(flat[0]), *sums, out["xx"], out["xy"], out["yy"]


class Whitening:
    """Principal axes at unit variance; ``forward`` and ``inverse`` act on rows of arrays."""

    def __init__(self, mean: np.ndarray, w: np.ndarray, inverse: np.ndarray):
        self.mean, self.w, self.back = mean, w, inverse

    @staticmethod
    def fit(frames: DataFrame, x: str = "x", rank: int | None = None) -> "Whitening":
        n, s, _, c, _, _ = moments(frames, x)
        mean = s / n
        return Whitening(mean, *kinetics.whitening((c - n * np.outer(mean, mean)) / (n - 1), rank))

    def forward(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean) @ self.w

    def inverse(self, z: np.ndarray) -> np.ndarray:
        return z @ self.back + self.mean


class Standard:
    """Features less their means, over their deviations (1 where a feature doesn't move)."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std = mean, np.where(std > 1e-12, std, 1.0)

    @staticmethod
    def fit(frames: DataFrame, x: str = "x") -> "Standard":
        n, s, _, c, _, _ = moments(frames, x)
        mean = s / n
        return Standard(mean, np.sqrt(np.maximum(np.diag(c) / n - mean**2, 0)))

    def transform(self, frames: DataFrame, x: str = "x", out: str = "z") -> DataFrame:
        return project(frames, lambda y: (y - self.mean) / self.std, x, out)


class Tica:
    """Slow modes from instantaneous and lagged moments; partial moments add up, so batches may come one by one."""

    def __init__(self, lag: int = 1, dim: int = 2):
        self.lag, self.dim, self.parts = lag, dim, []

    def partial_fit(self, frames: DataFrame, x: str = "x") -> "Tica":
        """Add whole runs."""
        pairs = lag_pairs(frames.select("run_id", "t", x), self.lag, columns=(x,))
        self.parts.append((moments(frames, x), moments(pairs, x, f"next_{x}", only=("xy",))))
        return self

    def finalise(self) -> "Tica":
        whole, lagged = ([sum(p[k][m] for p in self.parts if p[k][0]) for m in range(6)] for k in (0, 1))
        n, s, _, c, _, _ = whole
        nt, a, b, _, ct, _ = lagged
        if not n:
            raise ValueError("no frames to fit")
        self.mean = m = s / n
        if not nt:  # no run is longer than the lag: nothing is slow
            d = min(self.dim, len(m))
            self.projection, self.timescales, self.values = np.eye(len(m))[:, :d], np.full(d, np.nan), np.full(d, np.nan)
            return self
        c0 = c / n - np.outer(m, m)
        ct = (ct - np.outer(a, m) - np.outer(m, b)) / nt + np.outer(m, m)
        self.projection, self.timescales = kinetics.tica(m, c0, ct, self.lag, self.dim)
        p = self.projection
        self.values = np.einsum("ij,ik,kj->j", p, ct, p) / np.einsum("ij,ik,kj->j", p, c0 + 1e-9 * np.eye(len(m)), p)
        return self

    def fit(self, frames: DataFrame, x: str = "x") -> "Tica":
        self.parts = []
        return self.partial_fit(frames, x).finalise()

    def transform(self, frames: DataFrame, x: str = "x", out: str = "cv") -> DataFrame:
        return project(frames, lambda y: (y - self.mean) @ self.projection, x, out)


def project(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray], x: str = "x", out: str = "cv") -> DataFrame:
    """``frames`` with ``out``, a matrix function of the array column ``x``, batch by batch."""
    return with_column(frames, out, T.ArrayType(T.DoubleType()), lambda b: rows_of(f(matrix(b.column(x)))))


def vamp_score(frames: DataFrame, lag: int, x: str = "x", r: int = 2) -> float:
    n, a, b, caa, cab, cbb = moments(lag_pairs(frames.select("run_id", "t", x), lag, columns=(x,)), x, f"next_{x}")
    a, b = a / n, b / n
    return kinetics.vamp_score(caa / n - np.outer(a, a), cab / n - np.outer(a, b), cbb / n - np.outer(b, b), r)


def discretise(frames: DataFrame, states: int, seed: int = 0, x: str = "cv") -> tuple[DataFrame, np.ndarray]:
    """(``frames`` with ``state``, centres) by distributed k-means; ties go to the smaller state."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = frames.select(array_to_vector(x).alias("features"))
    centres = np.array(KMeans(k=states, seed=seed).fit(vectors).clusterCenters())
    return assign(frames, centres, x), centres


def nearest_of(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of the centres to each row; ties go to the smaller."""
    step = max(1, (1 << 20) // max(1, centres.size))
    return np.concatenate([((y[a : a + step, None] - centres[None]) ** 2).sum(2).argmin(1) for a in range(0, len(y), step)]).astype(np.int32)


def assign(frames: DataFrame, centres: np.ndarray, x: str = "cv") -> DataFrame:
    """``frames`` with ``state``: the nearest of the centres."""
    return with_column(frames, "state", T.IntegerType(), lambda b: pa.array(nearest_of(matrix(b.column(x)), centres)))


def states_of(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray], centres: np.ndarray) -> DataFrame:
    """``frames`` with ``state``: the centre nearest to what ``f`` makes of the coordinates (n, atoms, 3), by one Python worker a task."""
    return _batched(frames, lambda xyz: [pa.array(nearest_of(f(xyz), centres))], [T.StructField("state", T.IntegerType())])
