"""Histograms, quantisation, code lengths, averages, distances and joins of the analysis, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from lagfold.operators.frames import ranged


def percentiles(df: DataFrame, x: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation: only the rows of the ranges that hold the wanted ranks are sorted."""
    rows = df.select(F.col(x).cast("double").alias("x")).where("x is not null")
    placed = rows.withColumn("r", ranged(rows, "x"))
    sizes = {r.r: int(r.n) for r in placed.groupBy("r").agg(F.count("*").alias("n")).collect()}  # a row for each range
    total = sum(sizes.values())
    if not total:
        return [None] * len(shares)
    ranks = [p * (total - 1) for p in shares]
    where, before = {}, 0
    for r in sorted(sizes):
        for k in {int(q) for q in ranks} | {min(int(q) + 1, total - 1) for q in ranks}:
            if before <= k < before + sizes[r]:
                where[k] = (r, k - before)
        before += sizes[r]
    inner = F.row_number().over(W.partitionBy("r").orderBy("x")) - 1
    some = placed.where(F.col("r").isin(sorted({r for r, _ in where.values()}))).withColumn("k", inner)
    wanted = F.struct("r", "k").isin([F.struct(F.lit(r), F.lit(k)) for r, k in where.values()])
    value = {(v.r, v.k): v.x for v in some.where(wanted).collect()}  # two rows for each share at most
    out = []
    for q in ranks:
        low, high = value[where[int(q)]], value[where[min(int(q) + 1, total - 1)]]
        share = q - int(q)
        out.append(low if share == 0 or low == high else low + (high - low) * share)
    return out


def everything():
    """One window over all rows; only over tables with a fixed number of rows (bins, states, symbols)."""
    return W.partitionBy(F.lit(0))


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of x, the last one closed on both sides; null outside [lo, hi]."""
    raw = F.floor((x - lo) / ((hi - lo) / bins)).cast("int")
    return F.when((x >= lo) & (x <= hi), F.when(x == hi, bins - 1).otherwise(F.least(raw, F.lit(bins - 1))))


def histogram(df: DataFrame, x: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """``(bin, n)`` of all bins, empty ones too."""
    counts = df.select(bin_of(x, lo, hi, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def free_energy(hist: DataFrame, width: float, floor: float = 1e-8) -> DataFrame:
    """``(bin, free_energy)``: -ln of the density, clipped below."""
    density = F.col("n") / (F.sum("n").over(everything()) * width)
    return hist.select("bin", (-F.ln(F.greatest(density, F.lit(floor)))).alias("free_energy"))


def histogram_kl(p: DataFrame, q: DataFrame, floor: float = 1e-8) -> DataFrame:
    """``kl`` of two histograms over the same bins: normalised, clipped, renormalised."""
    a, b = (h.select("bin", F.greatest(F.col("n") / F.sum("n").over(everything()), F.lit(floor)).alias(c)) for h, c in ((p, "a"), (q, "b")))
    both = a.join(b, "bin").select((F.col("a") / F.sum("a").over(everything())).alias("a"), (F.col("b") / F.sum("b").over(everything())).alias("b"))
    return both.agg(F.sum(F.col("a") * F.ln(F.col("a") / F.col("b"))).alias("kl"))


def quantise(z: Column, levels: int, zmax: float) -> Column:
    scaled = (F.greatest(F.least(z, F.lit(zmax)), F.lit(-zmax)) + zmax) / (2 * zmax) * levels
    return F.least(F.floor(scaled), F.lit(levels - 1)).cast("int")


def dequantise(q: Column, levels: int, zmax: float) -> Column:
    return (q + 0.5) * (2 * zmax / levels) - zmax


def entropy(df: DataFrame, symbol: str) -> DataFrame:
    """``(n, bits)``: Shannon entropy of a column's values."""
    counts = df.groupBy(symbol).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(everything())
    return counts.select("c", p.alias("p")).agg(F.sum("c").alias("n"), (-F.sum(F.col("p") * F.log2("p"))).alias("bits"))


def residual_step(std: Column, n_bits: int) -> Column:
    return (std + 1e-12) * 2.0 ** (1 - n_bits) * 3.0


def dither(seed: int, row: Column, dim: int = 0) -> Column:
    """A draw in [-1/2, 1/2) from (seed, row, dim) by a linear congruence: the same on both sides, in any partition."""
    x = (row * 1103515245 + (12345 + 7919 * seed + 104729 * dim)) % 2147483648
    return ((x * 69069 + 1) % 2147483648) / 2147483648.0 - 0.5


def nearest(points: DataFrame, centres: DataFrame, dims: list[str]) -> DataFrame:
    """``points`` with ``state``, the id of the nearest of the broadcast ``centres(state, dims)``; ties to the smaller id.

    Centres are a fixed number of states, so every row meets them all in one local loop.
    """
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("state", *dims))).alias("_c"))
    d2 = lambda c: sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in dims), F.lit(0.0))
    scored = F.array_min(F.transform("_c", lambda c: F.struct(d2(c).alias("d2"), c["state"].alias("state"))))
    return points.drop("state").join(F.broadcast(listed)).withColumn("_m", scored).withColumns({"state": F.col("_m.state"), "d2": F.col("_m.d2")}).drop("_c", "_m")


def cell_weights(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """``(state, weight)``: the share of rows nearest to each cell; empty cells get 0."""
    counts = assigned.groupBy("state").agg(F.count("*").alias("c"))
    joined = cells.select("state").join(counts, "state", "left").select("state", F.coalesce("c", F.lit(0)).alias("c"))
    return joined.select("state", (F.col("c") / F.sum("c").over(everything())).alias("weight"))


def weighted_average(values: Column, weights: Column) -> Column:
    return F.sum(values * weights) / F.sum(weights)


def rmsf(atom_rows: DataFrame) -> DataFrame:
    """``(atom, rmsf)``: root mean square fluctuation about the mean place."""
    return atom_rows.groupBy("atom").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def pair_distances(frames: DataFrame, separation: int) -> DataFrame:
    """``(run_id, t, i, j, d)`` of the atoms of a frame ``xyz`` at least ``separation`` apart in index; made within each row, no shuffle."""
    n = (F.size("xyz") / 3).cast("int")
    first = frames.select("run_id", "t", "xyz", n.alias("n")).where(F.col("n") > separation).select("run_id", "t", "xyz", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1 - separation)).alias("i"))
    both = first.select("run_id", "t", "xyz", "i", F.explode(F.sequence(F.col("i") + separation, F.col("n") - 1)).alias("j"))
    at = lambda a, k: F.element_at("xyz", F.col(a) * 3 + k)
    d = F.sqrt(sum(((at("i", k) - at("j", k)) * (at("i", k) - at("j", k)) for k in (1, 2, 3)), F.lit(0.0)))
    return both.select("run_id", "t", "i", "j", d.alias("d"))


def min_distances(frames: DataFrame) -> DataFrame:
    """``(run_id, t, d)``: the smallest distance between different atoms of each frame; ``(run_id, t)`` tells frames apart."""
    return pair_distances(frames, 1).groupBy("run_id", "t").agg(F.min("d").alias("d"))


def medoids(frames: DataFrame, centres: DataFrame, dims: list[str]) -> DataFrame:
    """``(state, run_id, t, d2)``: the frame of each state nearest to its centre; ties to the earlier frame."""
    c = F.broadcast(centres.select("state", *[F.col(x).alias(f"_{x}") for x in dims]))
    d2 = sum(((F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in dims), F.lit(0.0))
    best = F.min(F.struct(d2.alias("d2"), "run_id", "t")).alias("b")
    return frames.join(c, "state").groupBy("state").agg(best).select("state", "b.run_id", "b.t", "b.d2")
