"""Candidates against a reference: reconstructions by name, a fixed discretisation, the bound and rates.

A method takes and gives frames ``(run_id, t, xyz)``; a name that nothing answers to gives a row that says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfold.functions import kinetics
from lagfold.operators.tables import written
from lagfold.operators import counts, geometry, stats
from lagfold.shipping import ship

Method = Callable[[DataFrame, int], DataFrame]
#: Candidates by name; add your own.
METHODS: dict[str, Method] = {}


def method(name: str):
    def add(f: Method) -> Method:
        METHODS[name] = f
        return f

    return add


def centred(frames: DataFrame) -> DataFrame:
    """``frames`` with ``centred`` (coordinates less their frame's centroid) and ``centroid``."""
    atoms = F.size("xyz") / 3
    axis = lambda k: F.aggregate(F.filter("xyz", lambda x, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x) / atoms
    middle = frames.withColumn("centroid", F.array(*[axis(k) for k in range(3)]))
    return middle.withColumn("centred", F.transform("xyz", lambda x, i: x - F.element_at("centroid", (i % 3 + 1).cast("int"))))


@method("stored")
def stored(frames: DataFrame, seed: int = 0) -> DataFrame:
    return frames


@method("shuffle")
def shuffle(frames: DataFrame, seed: int = 0) -> DataFrame:
    """Frames drawn with replacement within each run: the same ensemble, no kinetics."""
    n = frames.groupBy("run_id").agg(F.count("*").alias("n"))
    pick = frames.select("run_id", "t").join(n, "run_id").select("run_id", "t", F.pmod(F.xxhash64("run_id", "t", F.lit(seed)), F.col("n")).alias("from"))
    return pick.join(frames.withColumnRenamed("t", "from"), ["run_id", "from"]).select("run_id", "t", "xyz")


@method("quantize")
def quantize(frames: DataFrame, seed: int = 0, decimals: int = 1) -> DataFrame:
    return frames.withColumn("xyz", F.transform("xyz", lambda x: F.bround(x, decimals)))


def xtc(frames: DataFrame, precision: float) -> tuple[DataFrame, float]:
    """(frames on a grid of 1/precision about their centroids, bits): the rate is the entropy of all grid numbers."""
    q = centred(frames).withColumn("q", F.transform("centred", lambda x: F.bround(x * precision, 0)))
    back = q.select("run_id", "t", F.transform("q", lambda x, i: x / precision + F.element_at("centroid", (i % 3 + 1).cast("int"))).alias("xyz"))
    e = stats.entropy(q.select(F.explode("q").alias("q")), "q").first()
    return back, float(e.bits * e.n) if e.n else 0.0


def pca(frames: DataFrame, modes: int, bits: int = 12) -> tuple[DataFrame, float]:
    """(frames from their first modes of variance, bits): entropies of the quantised projections, and the model's own size."""
    ship(frames.sparkSession)
    aligned = written(geometry.kabsch(frames.select("run_id", "t", "xyz")).select("run_id", "t", "aligned"))
    n, s, _, c, _, _ = geometry.moments(aligned, "aligned")
    mean = s / n
    value, vector = np.linalg.eigh((c - n * np.outer(mean, mean)) / max(n - 1, 1))
    v = vector[:, np.argsort(-value)[:modes]]
    modes = v.shape[1]
    projected = geometry.project(aligned, lambda y: (y - mean) @ v, "aligned", "p").select("run_id", "t", "p")
    ends = projected.select(F.posexplode("p").alias("k", "x")).groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("k").collect()  # a row for each mode
    low, step = np.array([r.lo for r in ends]), np.array([(r.hi - r.lo) / (2**bits - 1) + 1e-12 for r in ends])
    level = lambda y: np.rint(((y - mean) @ v - low) / step)
    levels = geometry.project(aligned, level, "aligned", "q").select("run_id", "t", "q")
    each = levels.select(F.posexplode("q").alias("k", "q")).groupBy("k", "q").agg(F.count("*").alias("c"))
    total = each.agg((-F.sum(F.col("c") * F.log2(F.col("c") / n))).alias("b")).first().b or 0.0
    back = geometry.project(aligned, lambda y: (level(y) * step + low) @ v.T + mean, "aligned", "xyz").select("run_id", "t", "xyz")  # one Python worker a task, not one for each step
    return back, float(total + 32 * (v.size + mean.size + 2 * modes))


class Ruler:
    """A discretisation fitted once on the reference: pair distances, slow modes, centres; blind to rotations and shifts."""

    def __init__(self, frames: DataFrame, lag: int, states: int, dt: float = 1.0, atoms: int = 64, separation: int = 3, dim: int = 2, seed: int = 0):
        self.lag, self.dt, self.atoms, self.separation = lag, dt, atoms, separation
        x = written(self._features(frames))
        self.modes = geometry.Tica(lag, dim).fit(x)
        cells, self.centres = geometry.discretise(self.modes.transform(x).select("run_id", "t", "cv"), states, seed)
        self.slowest = self._slowest(cells)

    def _features(self, frames: DataFrame) -> DataFrame:
        return geometry.contacts(frames.select("run_id", "t", "xyz"), self.atoms, self.separation, by_position=True).select("run_id", "t", "x")

    def states(self, frames: DataFrame) -> DataFrame:
        atoms, separation, mean, projection = self.atoms, self.separation, self.modes.mean, self.modes.projection
        f = lambda xyz: (geometry.distances(xyz, atoms, separation, by_position=True) - mean) @ projection
        return geometry.states_of(frames.select("run_id", "t", "xyz"), f, self.centres)

    def _slowest(self, cells: DataFrame) -> float:
        c = kinetics.dense_counts(counts.transition_counts(cells, self.lag).collect(), len(self.centres))
        try:
            its = kinetics.implied_timescales(kinetics.reversible_mle(c)[0], self.lag, 1)
        except ValueError:
            its = []
        return float(its[0]) * self.dt if len(its) else math.nan  # frames that all fall into one cell have no timescale

    def score(self, frames: DataFrame) -> tuple[float, float]:
        """(slowest timescale, its error against the reference in per cent)."""
        own = self._slowest(self.states(frames))
        return own, abs(own - self.slowest) / self.slowest * 100


def run_benchmark(frames: DataFrame, methods: list[str], lag: int = 10, states: int = 50, dim: int = 2, dt: float = 0.1, seed: int = 0) -> list[dict]:
    """A row for each method: its divergence from the reference's model, on cells of the reference's slow modes."""
    ship(frames.sparkSession)
    ref = geometry.reference_frame(frames)
    aligned = geometry.kabsch(frames.select("run_id", "t", "xyz"), ref).select("run_id", "t", "aligned")
    modes = geometry.Tica(lag, dim).fit(aligned, "aligned")
    cells, centres = geometry.discretise(modes.transform(aligned, "aligned", "cv").select("run_id", "t", "cv"), states, seed)
    dense = lambda df: kinetics.dense_counts(counts.transition_counts(df, lag).collect(), len(centres))
    c = dense(cells)
    act = kinetics.largest_connected_set(c)
    p, total = kinetics.estimate(c[np.ix_(act, act)])[0], frames.count()
    out = []
    for name in methods:
        make = METHODS.get(name.lower())
        if make is None:
            out.append({"method": name, "available": False, "note": "no such method"})
            continue
        q, note = p, "model kept with the data"
        if name.lower() != "stored":
            moved = geometry.kabsch(make(frames, seed).select("run_id", "t", "xyz"), ref).select("run_id", "t", "aligned")
            own = geometry.assign(modes.transform(moved, "aligned", "cv").select("run_id", "t", "cv"), centres)
            q, note = kinetics.estimate(dense(own)[np.ix_(act, act)])[0], "estimated again from the candidate"
        f = kinetics.fidelity(p, q, lag, total)
        out.append({"method": name, "available": True, "note": note, "ensemble": f.ensemble, "transition": f.transition, "pair_bound": f.pair_bound, "ensemble_bound": f.ensemble_bound, "slowest_reference": float(f.timescales_p[0] * dt) if len(f.timescales_p) else math.nan, "slowest": float(f.timescales_q[0] * dt) if len(f.timescales_q) else math.nan})
    return out


#: Settings of the built-in rungs, finest first.
LADDERS = {"xtc": (1000, 200, 50, 20, 10, 5, 2), "pca": (16, 8, 4, 2, 1)}


def ladders(frames: DataFrame, ruler: Ruler, rungs: dict[str, tuple] = LADDERS) -> list[dict]:
    """A row for each setting of each rate model: bits a frame, the ratio to 32-bit coordinates, and what the ruler reads."""
    n, width = frames.count(), frames.select(F.size("xyz").alias("w")).first().w
    out = []
    for name, settings in rungs.items():
        make = {"xtc": xtc, "pca": pca}.get(name)
        if make is None:
            out.append({"method": name, "available": False})
            continue
        for s in settings:
            back, bits = make(frames, s)
            slowest, error = ruler.score(back)
            out.append({"method": name, "available": True, "setting": float(s), "bits_per_frame": bits / n, "ratio": 32 * width * n / bits if bits else math.inf, "slowest": slowest, "error": error})
    return out


def codec_rows(frames: DataFrame, ruler: Ruler, art, lag: int) -> list[dict]:
    """Two rows of the flow codec: the model that the artifact keeps, and a trajectory rebuilt from it and measured again."""
    from lagfold.operators.reconstruct import full_length
    from lagfold.plans import flowcodec

    c = art.counts()
    act = kinetics.largest_connected_set(c)
    stored = float(kinetics.implied_timescales(kinetics.estimate(c[np.ix_(act, act)])[0], lag, 1)[0]) * ruler.dt
    kept = flowcodec.decode(art, full_atom=True)
    dims = [f"d{k}" for k in range(art.config["dim"])]
    spread = lambda df, c: df.select("*", *[F.col(c)[k].alias(d) for k, d in enumerate(dims)])
    whole = full_length(art.tables["dtraj"], spread(kept, "cv").select("run_id", "t", "state", "xyz", *dims), spread(art.tables["centres"], "c").select("state", *dims), dims)
    rebuilt, error = ruler.score(whole)
    return [{"method": "codec, stored model", "slowest": stored, "error": abs(stored - ruler.slowest) / ruler.slowest * 100}, {"method": "codec, round trip", "slowest": rebuilt, "error": error}]


def text(rows: list[dict]) -> str:
    """Rows as an aligned table; what is missing is a dash."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    show = lambda v: "-" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v)
    cells = [names, *[[show(r.get(n)) for n in names] for r in rows]]
    wide = [max(len(r[k]) for r in cells) for k in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in cells)


SCHEMA = "method string, available boolean, note string, ensemble double, transition double, pair_bound double, ensemble_bound double, slowest_reference double, slowest double"


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], SCHEMA)


def write_csv(spark: SparkSession, rows: list[dict], folder: str) -> None:
    table(spark, rows).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
