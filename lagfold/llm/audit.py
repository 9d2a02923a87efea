"""Filter interaction audit: what each filter removes, in every order of application.

Each document gets a mask of the filters that it fails; a count of documents by part and
mask then tells all orders.  Duplicates (filter E) are found by partition refinement:
documents are split by code-point length, then by the hashes of successive blocks of the
text, and groups of one are dropped after each split.  The full texts of what survives
are compared; a document whose id isn't the smallest of its text fails.

Only keys and hashes are carried through the refinement, full texts move once and only
those of documents that survive it.  A group that holds a third of all rows is counted
before it is shuffled, and documents find their group by a join, never in a window.

Defined cases: a null text is an empty one, a null part is the empty string; a document
without an id isn't smaller or larger than another, so it neither fails E nor makes others
fail; rows equal in id and text don't fail E by each other; several label rows of an
id count as one that has each label if any has; labels without an id are left out; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfold.llm.spark import cut, release, sized

#: Each filter's bit in a mask.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
#: White space that separates words: fixed values.
SPACES = " \t\n\x0b\x0c\r"
#: Code points of the successive blocks; a last block takes the rest of the text.
BLOCKS = (64, 960)


def _block_hashes(blocks: tuple[int, ...]) -> list[Column]:
    begins = [1 + sum(blocks[:k]) for k in range(len(blocks))]
    own = [F.xxhash64(F.substring("t", b, w)) for b, w in zip(begins, blocks)]
    return [*own, F.xxhash64(F.expr(f"substring(t, {1 + sum(blocks)})"))] if blocks else []


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", blocks: tuple[int, ...] = BLOCKS) -> tuple[DataFrame, list[str]]:
    """(``doc, part, t, n, <block hashes>, mask``) with the bits of A to D, and the names of the refinement's keys."""
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    base = base.withColumns({"n": F.char_length("t"), "inner": F.btrim("t", F.lit(SPACES))})
    words = base.withColumn("w", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", "[ \\x09-\\x0D]+"))).drop("inner")
    upper = F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[A-Z]", ""))
    how_many, different = F.size("w").cast("long"), F.size(F.array_distinct("w")).cast("long")
    fails = [("A", how_many < 50), ("B", 100 * different < 65 * how_many), ("C", 100 * upper.cast("long") > 5 * F.col("n").cast("long")), ("D", F.col("t").rlike("[#$%&*|]"))]
    mask = sum((F.when(c, BITS[k]).otherwise(0) for k, c in fails), F.lit(0))
    hashes = [h.alias(f"h{k}") for k, h in enumerate(_block_hashes(blocks))]
    return words.select("doc", "part", "t", "n", *hashes, mask.alias("mask")), ["n", *[f"h{k}" for k in range(len(hashes))]]


def _refined(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one document has, found split by split."""
    alive = facts.select(*keys)
    for k in range(1, len(keys)):
        shared = cut(alive.groupBy(*keys[:k]).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c"))
        alive = alive.join(sized(shared), keys[:k], "left_semi")
    return cut(alive.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c"))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``(doc, part, mask)`` of every document, with the bits of A to E."""
    whole, keys = failures(docs, id_col, text_col, part_col, blocks)
    facts = cut(whole.drop("t"))
    shared = _refined(facts, keys)
    texts = whole.select("doc", "t", *keys).join(sized(shared), keys, "left_semi")
    found = cut(texts.groupBy(*keys, "t").agg(F.min("doc").alias("least"), F.count("*").alias("c")).drop("t"))  # a row for each different text
    mixed = cut(found.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c"))  # different texts whose hashes are equal
    late = F.when(F.col("doc") > F.col("least"), BITS["E"]).otherwise(0)
    first = cut(found.where("c > 1").join(sized(mixed), keys, "left_anti").select(*keys, "least"))
    marked = facts.join(sized(first), keys, "left")
    if mixed.limit(1).count():  # their documents are told apart by the texts themselves
        own = whole.join(sized(mixed), keys, "left_semi")
        least = cut(own.groupBy("t").agg(F.min("doc").alias("least")))
        told = own.join(sized(least), "t", "left").select("doc", "part", (F.col("mask") + late).alias("mask"))
        marked = facts.join(sized(mixed), keys, "left_anti").join(sized(first), keys, "left")
        return marked.select("doc", "part", (F.col("mask") + late).alias("mask")).union(told)
    release(found, shared)
    return marked.select("doc", "part", (F.col("mask") + late).alias("mask"))


def steps(spark) -> DataFrame:
    """``(filter_order, step, bit, before, mask)``: each order's steps, for each of the 32 masks."""
    rows = [("".join(p), k + 1, BITS[p[k]], sum(BITS[x] for x in p[:k])) for p in permutations(BITS) for k in range(len(BITS))]
    table = spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")
    return table.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(31))))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    has = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = cut(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(has("quality"), has("toxic")))
    seen = masks(docs, id_col, text_col, part_col, blocks).join(sized(known), "doc", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    tally = cut(seen.groupBy("part", "mask").agg(F.count("*").alias("docs"), total("quality"), total("toxic")))  # 32 rows for a part at most
    bit, before, mask = F.col("bit"), F.col("before"), F.col("mask")
    fails = mask.bitwiseAND(bit) != 0
    earlier = mask.bitwiseAND(before) != 0
    some = lambda when, c="docs": F.sum(F.when(when, F.col(c)).otherwise(F.lit(0)).cast("long"))
    share = F.when(fails, F.col("docs") * (F.lit(120) / F.bit_count("mask")).cast("long")).otherwise(0)  # the filter is the first of those that fail in so many orders
    rules = F.broadcast(steps(docs.sparkSession))  # 120 x 5 x 32 rows
    return tally.join(rules, "mask").groupBy("part", "filter_order", "step").agg(
        some(~fails & ~earlier).alias("kept"), some(fails & ~earlier).alias("removed"), some(fails & earlier).alias("redundant"), some(mask == bit).alias("unique_fails"),
        some(fails & ~earlier, "quality").alias("good_lost"), some(fails & ~earlier, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )


def audit_sql() -> str:
    """The audit in DuckDB's SQL."""
    flag = lambda c, bit: f"CASE WHEN {c} THEN {bit} ELSE 0 END"
    before = " + ".join(flag(f"strpos(substr(o, 1, step - 1), '{k}') > 0", b) for k, b in BITS.items())
    own = " + ".join(flag(f"substr(o, step, 1) = '{k}'", b) for k, b in BITS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
  q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, {flag("len(w) < 50", 1)} + {flag("100 * len(list_distinct(w)) < 65 * len(w)", 2)} + {flag("100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)", 4)}
      + {flag("regexp_matches(t, '[#$%&*|]')", 8)} + {flag("doc_id > least", 16)} AS mask FROM w LEFT JOIN q USING (doc_id)),
  c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
  l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  p AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  s AS (SELECT o, step, {own} AS bit, {before} AS gone FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN mask & (bit | gone) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & gone > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & bit > 0 THEN n * (120 // bit_count(CAST(mask AS INTEGER))) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, o, step"""
