"""Path-space divergence of two Markov models: KL(path) = ensemble + (L - 1) transition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12


def ensemble_kl(p: DataFrame, q: DataFrame, eps: float = EPS) -> DataFrame:
    """``ensemble`` of ``(i, pi)`` tables: both clipped at ``eps`` and renormalised."""
    both = p.select("i", F.col("pi").alias("a")).join(q.select("i", F.col("pi").alias("b")), "i", "full")
    clip = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(eps))
    clipped = both.select(clip("a").alias("a"), clip("b").alias("b"))
    everything = W.partitionBy(F.lit(0))  # as many rows as states
    norm = clipped.select((F.col("a") / F.sum("a").over(everything)).alias("a"), (F.col("b") / F.sum("b").over(everything)).alias("b"))
    return norm.agg(F.sum(F.col("a") * F.ln(F.col("a") / F.col("b"))).alias("ensemble"))


def transition_kl(p: DataFrame, q: DataFrame, pi: DataFrame, eps: float = EPS) -> DataFrame:
    """``transition`` of dense ``(i, j, p)`` tables: clipped at ``eps``, not renormalised, weighted by ``pi`` of P."""
    both = p.select("i", "j", F.col("p").alias("a")).join(q.select("i", "j", F.col("p").alias("b")), ["i", "j"], "full")
    clip = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(eps))
    terms = both.join(F.broadcast(pi), "i").select("pi", clip("a").alias("a"), clip("b").alias("b"))
    return terms.agg(F.sum(F.col("pi") * F.col("a") * F.ln(F.col("a") / F.col("b"))).alias("transition"))


def support_violations(p: DataFrame, q: DataFrame, eps: float = EPS) -> DataFrame:
    """``(i, j)`` where P has a transition that Q lacks."""
    return p.where(F.col("p") > eps).select("i", "j").join(q.where(F.col("p") > eps), ["i", "j"], "left_anti")


def pinsker(kl: Column) -> Column:
    return F.sqrt(F.greatest(kl, F.lit(0.0)) / 2)


def path_kl(ensemble: Column, transition: Column, length: Column) -> Column:
    return ensemble + F.greatest(length - 1, F.lit(0)) * transition


def fidelity_terms(counts: DataFrame, model: str, p, q, states: int, eps: float = EPS) -> DataFrame:
    """One row ``(ensemble, transition, support_ok)`` of two models in one table ``(model, i, j, c)`` of sliding counts.

    The counts are symmetrised and laid side by side by pair; all terms follow from that table of at most states^2 rows.
    """
    own = lambda v: F.sum(F.when(F.col(model) == v, F.col("c")).otherwise(0))
    turned = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")
    pairs = counts.select(model, "c", turned).groupBy("p.i", "p.j").agg(own(p).alias("a"), own(q).alias("b"))
    row = W.partitionBy("i")
    share = lambda c: F.when(F.sum(c).over(row) > 0, F.col(c) / F.sum(c).over(row)).otherwise(0.0)
    clip = lambda c: F.greatest(c, F.lit(eps))
    each = pairs.select("i", "a", "b", share("a").alias("pa"), share("b").alias("pb"))
    term = F.sum(clip(F.col("pa")) * F.ln(clip(F.col("pa")) / clip(F.col("pb"))))
    by_state = each.groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), term.alias("term"), F.bool_or((F.col("pa") > eps) & ~(F.col("pb") > eps)).alias("lacks"))
    everything = W.partitionBy(F.lit(0))  # a row a state
    pi = by_state.select("term", "lacks", *[(F.col(c) / F.sum(c).over(everything)).alias(c) for c in "ab"])
    unseen = (F.lit(states) - F.count("*").over(everything)) * eps  # states without counts are clipped too
    norm = lambda c: clip(F.col(c)) / (F.sum(clip(F.col(c))).over(everything) + unseen)
    return pi.select(F.col("a").alias("pi"), "term", "lacks", norm("a").alias("wa"), norm("b").alias("wb")).agg(
        F.sum(F.col("wa") * F.ln(F.col("wa") / F.col("wb"))).alias("ensemble"), F.sum(F.col("pi") * F.col("term")).alias("transition"), (~F.bool_or("lacks")).alias("support_ok")
    )


def fidelity_report(terms: DataFrame, length: DataFrame) -> DataFrame:
    """One row: the terms, the two-slice and path divergence, their Pinsker bounds, and whether the path's is a lower one only.

    Without full support the bounds of pairs and paths are infinite; the path divergence stays as computed.
    """
    one = terms.join(F.broadcast(length.select("length")))  # one row each
    total, path = F.col("ensemble") + F.col("transition"), path_kl(F.col("ensemble"), F.col("transition"), F.col("length"))
    full = lambda kl: F.when(F.col("support_ok"), pinsker(kl)).otherwise(float("inf"))
    return one.select(
        "ensemble", "transition", total.alias("two_slice"), path.alias("path_kl"), full(total).alias("pair_bound"), pinsker(F.col("ensemble")).alias("ensemble_bound"),
        F.least(full(path), F.lit(1.0)).alias("path_bound"), "support_ok", (~F.col("support_ok")).alias("lower_bound"),
    )
