"""What a topology and its frames hold: residue classes, selections, units, footprint."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfold.operators import frames as fr

BACKBONE = ("N", "CA", "C", "O")  # fixed values: backbone atom names


def second_nearest(points: np.ndarray, rows: int = 512) -> np.ndarray:
    """The distance of each point to its nearest other point, in blocks of rows."""
    out = np.full(len(points), np.inf)
    for a in range(0, len(points), rows):
        d2 = ((points[a : a + rows, None, :] - points[None]) ** 2).sum(2)
        d2[np.arange(len(d2)), np.arange(a, a + len(d2))] = np.inf
        out[a : a + rows] = np.sqrt(d2.min(1))
    return out


def selections(topology: DataFrame) -> DataFrame:
    """``(selection, n)``: atoms of the usual selections and of every residue name that is no standard one."""
    kind, name = fr.classify(F.col("resname")), F.upper(F.trim("name"))
    probes = {"protein": kind == "protein", "protein and CA": (kind == "protein") & (name == "CA"), "backbone": (kind == "protein") & name.isin(*BACKBONE), "water": kind == "water", "not water": kind != "water"}
    one = topology.agg(*[F.count_if(p).alias(n) for n, p in probes.items()])
    usual = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("selection"), F.col(f"`{n}`").alias("n")) for n in probes])).alias("s")).select("s.selection", "s.n")
    others = topology.where(kind == "other").groupBy(F.concat(F.lit("resname "), F.upper("resname")).alias("selection")).agg(F.count("*").alias("n"))
    return usual.union(others)


def inspect(topology: DataFrame, frames: DataFrame, dt_ps: float | None = None) -> dict:
    """The figures of a topology and frames ``(run_id, t, xyz)``; coordinates of one frame and a row per residue name reach the driver."""
    residues = topology.select("chain", "res_id", F.upper("resname").alias("resname")).distinct()
    by_name = residues.groupBy("resname", fr.classify(F.col("resname")).alias("class")).agg(F.count("*").alias("n")).collect()
    kinds = {k: sum(r.n for r in by_name if r["class"] == k) for k in ("protein", "water", "ion", "other")}
    others = {r.resname: r.n for r in by_name if r["class"] == "other"}
    kept = fr.heavy(topology).where(fr.classify(F.col("resname")).isin("protein", "other")).count()
    atoms, n = topology.count(), frames.count()
    first = frames.orderBy("run_id", "t").limit(1).first()
    near, units = float("nan"), "unclear"
    if first is not None:
        pick = np.array([r.atom_index for r in fr.heavy(topology).select("atom_index").collect()], np.int64)  # atoms of one frame
        x = np.array(first.xyz, float).reshape(-1, 3)
        pick = pick[pick < len(x)]
        if len(pick) > 1:
            near = float(np.median(second_nearest(x[pick])))
            units = frames.sparkSession.range(1).select(fr.units_guess(F.lit(near)).alias("u")).first().u
    out = {"atoms": atoms, "residues": sum(kinds.values()), "chains": topology.select("chain").distinct().count(), "residue classes": kinds, "other residues": others}
    out |= {"selections": {r.selection: r.n for r in selections(topology).collect()}, "frames": n, "nearest neighbour": near, "units": units}
    out |= {"stored atoms": kept, "raw bytes": 12 * kept * n, "whitening entries": (3 * kept) ** 2, "low rank advised": 3 * kept > 6000}
    if dt_ps:
        out |= {"nanoseconds": n * dt_ps / 1000, "bytes for 125 us": int(12 * kept * 125_000_000 / dt_ps)}
    return out
