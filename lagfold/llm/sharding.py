"""Sharding by balanced label propagation.

Documents with equal texts are linked.  All documents start at a shard that a hash of
the id gives.  In each round every linked document wants to go where most of its
neighbours are; the wishes are counted by (from, to) pair of shards, a small flow
problem gives how many of each pair may move so that no shard exceeds its quota, and
that share of the wishes is granted.  At the end shards above their exact quota give
documents up, those without neighbours first, to shards below it: counts are then at
most one apart (law ``rows``).

State is kept as one row per (group of equal texts, shard) where the work allows, so a
group that holds a third of all rows is a few rows, never one task.  Only DataFrame
functions are used; what reaches the driver is a matrix of shards x shards counts.

Defined cases: a null text has size 1 and the crc32 of the empty text, and is linked to
other texts of no bytes; repeated rows each get a place; an empty table gives no rows; a
row with a null id is placed like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lagfold.llm.spark import cut, release, sized


def _grants(sizes: list[int], wishes: dict[tuple[int, int], int], quota: int, shards: int) -> dict[tuple[int, int], float]:
    """The share of each (from, to) wish that may be granted; no shard ends above ``quota`` (or its size, if that is more).

    Opposite wishes are exchanged one for one; then free places are filled, largest wish first.
    """
    moved = {p: 0 for p in wishes}
    for (i, j), n in wishes.items():
        moved[i, j] = min(n, wishes.get((j, i), 0))
    now = list(sizes)
    for _ in range(2 * shards):
        rest = sorted(((n - moved[p], p) for p, n in wishes.items() if n > moved[p]), reverse=True)
        changed = False
        for left, (i, j) in rest:
            take = min(left, max(0, quota - now[j]))
            if take:
                moved[i, j] += take
                now[i] -= take
                now[j] += take
                changed = True
        if not changed:
            break
    return {p: moved[p] / n for p, n in wishes.items() if n}


def propagate(moving: DataFrame, total: int, shards: int, rounds: int) -> DataFrame:
    """``(g, row, label)``: linked rows moved towards their group's shards; ``total`` counts all rows, linked or not."""
    state = cut(moving)
    quota = -(-total // shards)
    spark = moving.sparkSession
    for turn in range(rounds):
        tally = cut(state.groupBy("g", "label").agg(F.count("*").alias("n")))
        sizes_of = {r.label: int(r.n) for r in tally.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        # rows without neighbours can still be exchanged at the end, so places they hold count as free
        sizes = [sizes_of.get(k, 0) for k in range(shards)]
        # every other turn only shards with room count, so that a group too large for one shard gathers in few
        room = [k for k in range(shards) if turn % 2 == 0 or sizes[k] < quota]
        best = tally.where(F.col("label").isin(room)).groupBy("g").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m")).select("g", F.col("m.n").alias("most"), (-F.col("m.l")).alias("to"))
        ahead = F.struct("n", -F.col("label")) < F.struct("most", -F.col("to"))
        wish = cut(tally.join(best, "g").where((F.col("label") != F.col("to")) & ahead).select("g", "label", "to", "n"))
        wishes = {(r.label, r.to): int(r.n) for r in wish.groupBy("label", "to").agg(F.sum("n").alias("n")).collect()}
        grants = {p: s for p, s in _grants(sizes, wishes, quota, shards).items() if s > 0}
        if not grants:
            if turn % 2:
                break
            continue
        table = spark.createDataFrame([(i, j, float(s)) for (i, j), s in sorted(grants.items())], "label int, to int, share double")
        granted = cut(wish.join(F.broadcast(table), ["label", "to"]).select("g", "label", "to", "share"))  # the broadcast has shards^2 rows at most
        draw = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moved = cut(state.join(sized(granted), ["g", "label"], "left").select("g", "row", F.when(draw < F.col("share"), F.col("to")).otherwise(F.col("label")).alias("label")))
        release(state, tally, wish, granted)
        state = moved
    return state


def shard(docs: DataFrame, shards: int = 8, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text", spread: int = 512) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot)``; law ``rows``: counts at most one apart, slots gapless in each shard."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc"), raw.alias("t")).select(
        "doc", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32("t").alias("crc"), F.xxhash64("t").alias("g"), F.monotonically_increasing_id().alias("nth")
    )
    base = cut(base)  # a stable number tells repeated rows apart
    how_many = base.groupBy("g", "size", "crc").agg(F.count("*").alias("c"))
    linked = cut(how_many.where("c > 1").select("g", "size", "crc", F.lit(True).alias("linked")))
    marked = base.join(sized(linked), ["g", "size", "crc"], "left")
    start = marked.select("doc", "size", "crc", "nth", F.xxhash64("g", "size", "crc").alias("g"), F.xxhash64("doc", "nth").alias("row"), F.col("linked").isNull().alias("single"))
    start = cut(start.withColumn("label", F.pmod("row", F.lit(shards)).cast("int")))

    total = base.count()
    moved = propagate(start.where("not single").select("g", "row", "label"), total, shards, rounds)  # only linked rows take part
    placed = cut(start.where("single").select("row", "doc", "size", "crc", "single", "label").union(start.where("not single").drop("label").join(moved.select("row", "label"), "row").select("row", "doc", "size", "crc", "single", "label")))

    # exact quotas: the first (total mod shards) shards, by size, hold one more
    sizes = {r.label: int(r.n) for r in placed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(shards), key=lambda k: (-sizes.get(k, 0), k))
    quota = {k: total // shards + (n < total % shards) for n, k in enumerate(order)}
    # rows leave in the order (no neighbours first, hash); ranks are two-level, so no task holds a shard
    spread = max(spread, total // 50_000)  # rows that one task ranks stay bounded
    cell = F.pmod(F.col("row"), F.lit(spread)).cast("int")
    ranked = _rank(placed.withColumn("cell", F.when(F.col("single"), cell).otherwise(cell + spread)), "label", "cell", "row", "at")
    over = [(k, max(0, sizes.get(k, 0) - quota[k])) for k in range(shards)]
    starts, seen = {}, 0
    for k, n in over:
        starts[k] = seen
        seen += n
    leave = F.lit(False)
    rank = F.lit(0).cast("long")
    for k, n in over:
        if n:
            leave = leave | ((F.col("label") == k) & (F.col("at") < n))
            rank = F.when(F.col("label") == k, F.col("at") + starts[k]).otherwise(rank)
    to, upto = F.lit(None).cast("int"), 0
    gaps = [(k, max(0, quota[k] - sizes.get(k, 0))) for k in range(shards)]
    for k, n in gaps:
        if n:
            to = F.when((rank >= upto) & (rank < upto + n), F.lit(k)).otherwise(to)
            upto += n
    final = ranked.select("row", "doc", "size", "crc", F.when(leave, to).otherwise(F.col("label")).alias("shard"))
    slotted = _rank(cut(final).withColumn("cell", cell), "shard", "cell", "row", "slot")
    return slotted.select(F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _rank(df: DataFrame, key: str, cell: str, order: str, out: str) -> DataFrame:
    """Gapless rank from 0 within ``key`` by (cell, order): offsets of the cells, and a rank within each."""
    counts = df.groupBy(key, cell).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(key, cell, before.alias("_before"))  # keys x cells rows: fixed
    inner = df.withColumn("_r", F.row_number().over(W.partitionBy(key, cell).orderBy(order)) - 1)
    return inner.join(F.broadcast(offsets), [key, cell]).withColumn(out, F.col("_before") + F.col("_r")).drop("_r", "_before")
