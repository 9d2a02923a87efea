"""Lagged pairs, transition counts and what follows from them, as grouped aggregates.

A run is cut into ranges of ``t``, each with the first ``lag`` rows of the next range besides its own, so that a
run of any length is ordered by many tasks and no pair is lost or crosses a run.  The one shuffle is
by run and range, and counts are partially aggregated before the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames of a run that one task orders.
SPAN = 1 << 16


def in_ranges(frames: DataFrame, lag: int, span: int = SPAN) -> DataFrame:
    """``frames`` with ``_range`` and ``_ahead``: rows that open a range also end the one before, as its halo.

    ``t`` must count a run's frames without gaps (``frames.renumbered`` makes it so).
    """
    span = max(span, lag)
    own = F.floor(F.col("t") / span)
    here = F.struct(own.alias("range"), F.lit(False).alias("ahead"))
    both = F.when((own > 0) & (F.col("t") % span < lag), F.array(here, F.struct((own - 1).alias("range"), F.lit(True).alias("ahead")))).otherwise(F.array(here))
    return frames.withColumn("_in", F.explode(both)).withColumns({"_range": F.col("_in.range"), "_ahead": F.col("_in.ahead")}).drop("_in")


def lag_pairs(frames: DataFrame, lag: int, keys: tuple[str, ...] = (), columns: tuple[str, ...] = ("state",), span: int = SPAN) -> DataFrame:
    """``frames`` with ``next_<column>`` of the frame ``lag`` rows later in the run; rows without one are dropped."""
    w = W.partitionBy(*keys, "run_id", "_range").orderBy("t")
    out = in_ranges(frames, lag, span).withColumns({f"next_{c}": F.lead(c, lag).over(w) for c in columns} | {"_has": F.lead("t", lag).over(w)})
    return out.where("_has is not null and not _ahead").drop("_has", "_range", "_ahead")


def transition_counts(frames: DataFrame, lag: int = 1, keys: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """``(keys, i, j, c)``: sliding transition counts."""
    pairs = lag_pairs(frames.select(*keys, "run_id", "t", "state"), lag, keys, span=span)
    return pairs.groupBy(*keys, F.col("state").alias("i"), F.col("next_state").alias("j")).agg(F.count("*").alias("c"))


def counts_by_lag(frames: DataFrame, lags: list[int], span: int = SPAN) -> DataFrame:
    """``(lag, i, j, c)`` of several lags in one pass over the runs."""
    w = W.partitionBy("run_id", "_range").orderBy("t")
    halo = in_ranges(frames.select("run_id", "t", "state"), max(lags), span)
    ahead = halo.select("state", "_ahead", *[F.struct(F.lit(n).alias("lag"), F.lead("state", n).over(w).alias("j"), F.lead("t", n).over(w).alias("has")).alias(f"_{n}") for n in lags]).where("not _ahead")
    pairs = F.explode(F.array(*[F.col(f"_{n}") for n in lags]))
    return ahead.select(F.col("state").alias("i"), pairs.alias("p")).where("p.has is not null").groupBy("p.lag", "i", "p.j").agg(F.count("*").alias("c"))


def symmetrised(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(C + C') / 2."""
    both = counts.select(*keys, "i", "j", "c").union(counts.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    return both.groupBy(*keys, "i", "j").agg((F.sum("c") / 2).alias("c"))


def dense(counts: DataFrame, states: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every (i, j) below ``states`` for every key; missing counts are 0."""
    spark = counts.sparkSession
    grid = spark.range(states * states).select((F.col("id") / states).cast("int").alias("i"), (F.col("id") % states).cast("int").alias("j"))
    if keys:
        grid = counts.select(*keys).distinct().join(F.broadcast(grid))  # states^2 rows
    return grid.join(counts, [*keys, "i", "j"], "left").withColumn("c", F.coalesce(F.col("c").cast("double"), F.lit(0.0)))


def transition_matrix(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, i, j, p)``: rows normalised; rows of zeros stay."""
    total = F.sum("c").over(W.partitionBy(*keys, "i"))
    return counts.select(*keys, "i", "j", F.when(total > 0, F.col("c") / total).otherwise(0.0).alias("p"))


def stationary(symmetric: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, i, pi)`` of symmetrised counts: row sum over total, which is stationary."""
    rows = symmetric.groupBy(*keys, "i").agg(F.sum("c").alias("r"))
    return rows.select(*keys, "i", (F.col("r") / F.sum("r").over(W.partitionBy(*keys, F.lit(0)))).alias("pi"))


def entropy_rate(tmat: DataFrame, pi: DataFrame) -> DataFrame:
    """``bits`` a step: -sum pi_i sum_j p log2 p."""
    return tmat.where("p > 0").join(F.broadcast(pi), "i").agg((-F.sum(F.col("pi") * F.col("p") * F.log2("p"))).alias("bits"))


def restricted(counts: DataFrame, active: DataFrame) -> DataFrame:
    """Counts whose both states are in ``active(state)``."""
    a = F.broadcast(active.select("state"))  # a set of states
    return counts.join(a, counts["i"] == a["state"], "left_semi").join(a, counts["j"] == a["state"], "left_semi")
