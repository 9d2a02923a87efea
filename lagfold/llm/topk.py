"""Exact top-k inner-product search over norm buckets.

Vectors are grouped by length (each bucket spans a factor of 10/9 at most) and cut into
blocks; queries are cut into blocks too.  A first pass over the longest vectors gives each
query a lower bound of its k-th score.  A query block meets a vector block only if the
longest vector of the one can reach the least demand of the other, which the blocks'
metadata tells before any vector moves.  In a block of lengths up to L the bound is a local
cosine threshold t = bound / (|q| L): above 1 the query skips the block; a high t prunes by
coordinates (a vector whose cosine with the query is at least t has, at the query's largest
coordinates, values in a narrow interval); a low one prunes by length.  The products of
what is left are computed exactly in integers.

Defined cases: vectors that are null, empty, or hold null or non-finite components (before
or after scaling) take no part; vectors of different dimensions don't meet; a query with
fewer candidates than k gets all; equal scores go to the smaller id; repeated rows are
candidates each, and queries each; rows with the query's id aren't its candidates; rows
with a null id take no part; scores beyond 64 bits stand at the ends of their range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lagfold.llm.spark import cut, sized

_PARTS = ("ids", "rows", "flat")
_LOW = np.iinfo(np.int64).min
#: Tasks, at most, over which the query blocks of a dimension are dealt where blocks meet by their metadata.
SLOTS = 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``(id, row, v)``: floor(scale * x) of each component as an integral double, rows that take no part left out; ``row`` tells repeated rows apart."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine).select("id", "row", F.transform("v", whole).alias("v"))


def _packed(rows: DataFrame, by_length: bool, block_values: int) -> DataFrame:
    """Blocks of about ``block_values`` components: ``(dim, bucket, block, length, ids, rows, flat)``."""
    dim = F.size("v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bucket = F.when(square > 0, F.floor(F.log(F.sqrt(F.least(square, F.lit(1e300)))) / F.log(F.lit(10.0 / 9)))).otherwise(F.lit(-1)).cast("int") if by_length else F.lit(0)
    tagged = rows.select("id", "row", "v", dim.alias("dim"), bucket.alias("bucket"), F.sqrt(square).alias("length"))
    counts = tagged.groupBy("dim", "bucket").agg(F.ceil(F.count("*") * F.col("dim") / block_values).alias("blocks"))
    dealt = tagged.join(F.broadcast(counts), ["dim", "bucket"])  # buckets of lengths, which are doubles: a few thousand for each dimension at most
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    packed = dealt.groupBy("dim", "bucket", "block").agg(F.collect_list(F.struct("id", "row", "v")).alias("r"), F.max("length").alias("length"))
    return packed.select("dim", "bucket", "block", "length", F.col("r.id").alias("ids"), F.col("r.row").alias("rows"), F.flatten("r.v").alias("flat"))


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(1))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integral doubles: in floats below 2^53, in integers below 2^63, else in Python's."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(exact, _LOW, np.iinfo(np.int64).max).astype(np.int64)


def survivors(q: np.ndarray, bound: np.ndarray, c: np.ndarray, length: np.ndarray, focus: int = 3, high: float = 0.5) -> np.ndarray:
    """Which rows of the block ``c`` may reach each query's bound, as a (queries, rows) mask."""
    norm, most = _lengths(q), float(length.max(initial=0.0))
    keep = np.ones((len(q), len(c)), bool)
    asks = bound > 0  # else nothing can be left out
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(asks, bound / (norm * most) * (1 - 1e-9), 0.0)
        least = np.where(asks, bound / norm * (1 - 1e-9), 0.0)
    t, least = np.where(np.isnan(t), np.inf, t), np.where(np.isnan(least), np.inf, least)
    keep[t > 1] = False
    by_length = asks & (t < high)
    keep[by_length] = length[None, :] >= least[by_length, None]
    own = np.flatnonzero(asks & (t >= high) & (t <= 1))
    if len(own):
        unit = q[own] / norm[own, None]
        top = np.argsort(-np.abs(unit), axis=1)[:, :focus]
        for f in top.T:
            u = np.take_along_axis(unit, f[:, None], 1)
            reach = np.sqrt(np.maximum(0.0, (1 - u**2) * (1 - t[own, None] ** 2))) + 1e-9
            x = c[:, f].T * np.sign(u)  # towards the query
            keep[own] &= x >= (np.abs(u) * t[own, None] - reach) * length[None, :] - 1e-6 * (1 + length[None, :])
    return keep


def _best(qi: np.ndarray, q: np.ndarray, bound: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best k at or above the bound of each query in one block."""
    keep = survivors(q, bound, c, _lengths(c)) & (ci[None, :] != qi[:, None])
    if keep.mean() > 0.02:
        some = np.flatnonzero(keep.any(0))
        s = products(q, c[some])
        n, j = np.nonzero(keep[:, some] & (s >= bound[:, None]))
        s, j = s[n, j], some[j]
    else:
        n, j = np.nonzero(keep)
        asked, back = np.unique(n, return_inverse=True)
        s = np.zeros(len(n), np.int64)
        for i, own in zip(asked, np.split(np.arange(len(n)), np.searchsorted(back, np.arange(1, len(asked))))):
            s[own] = products(q[i : i + 1], c[j[own]])[0]
        ok = s >= bound[n]
        n, j, s = n[ok], j[ok], s[ok]
    order = np.lexsort((ci[j], -s.astype(np.float64), n)) if np.abs(s).max(initial=0) < 2**53 else np.array(sorted(range(len(n)), key=lambda x: (n[x], -int(s[x]), ci[j[x]])), np.int64)
    n, j, s = n[order], j[order], s[order]
    place = np.arange(len(n)) - np.searchsorted(n, n)
    return n[place < k], j[place < k], s[place < k]


def top_k(vectors: DataFrame, k: int = 5, query_divisor: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_values: int = 1 << 18) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best vectors of each row whose id is divisible by ``query_divisor``."""
    rows = cut(quantised(vectors, id_col, vector_col, scale))
    blocks = cut(_packed(rows, True, block_values))
    queries = cut(_packed(rows.where(F.col("id") % query_divisor == 0), False, block_values // 8).select("dim", F.col("block").alias("qb"), *[F.col(c).alias(f"q{c}") for c in _PARTS]))

    def mats(r):
        return np.asarray(r.qids), np.asarray(r.qflat, float).reshape(-1, r.dim), np.asarray(r.ids), np.asarray(r.flat, float).reshape(-1, r.dim)

    def first(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                qi, q, ci, c = mats(r)
                kth = np.full(len(q), _LOW)
                if len(c) > k:
                    s = np.where(ci[None, :] == qi[:, None], _LOW, products(q, c))
                    kth = np.partition(s, -k, axis=1)[:, -k]
                need = np.where(kth > 0, kth / np.maximum(_lengths(q), 1e-300), 0.0).min(initial=np.inf)
                out.append((r.dim, r.qb, kth.tolist(), float(need) * (1 - 1e-9)))
            yield pd.DataFrame(out, columns=["dim", "qb", "bound", "need"])

    place = F.struct("length", "bucket", "block")
    head = cut(blocks.groupBy("dim").agg(F.max_by(F.struct("bucket", "block"), place).alias("b")).select("dim", "b.bucket", "b.block"))
    longest = blocks.join(F.broadcast(head), ["dim", "bucket", "block"])  # one block for each dimension
    bounds = cut(queries.join(longest, "dim").mapInPandas(first, "dim int, qb long, bound array<bigint>, need double"))
    # a dimension is one key, so query blocks are dealt over slots and the vector blocks' few numbers go to every slot
    known = blocks.select("dim", "bucket", "block", "length", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    asking = bounds.select("dim", "qb", "need", F.pmod("qb", F.lit(SLOTS)).cast("int").alias("slot"))
    met = cut(known.join(asking, ["dim", "slot"]).where("length >= need").select("dim", "bucket", "block", "qb"))
    asked = cut(queries.join(bounds.select("dim", "qb", "bound"), ["dim", "qb"]))

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qi, q, ci, c = mats(r)
                n, j, s = _best(qi, q, np.asarray(r.bound, np.int64), ci, c, k)
                if len(n):
                    yield pd.DataFrame({"query_id": qi[n], "query_row": np.asarray(r.qrows)[n], "vec_id": ci[j], "score": s})

    pairs = blocks.join(sized(met), ["dim", "bucket", "block"]).join(sized(asked), ["dim", "qb"])
    found = pairs.select("dim", "ids", "flat", "qids", "qrows", "qflat", "bound").mapInPandas(search, "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
