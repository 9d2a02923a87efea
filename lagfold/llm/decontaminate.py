"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are far shorter than the documents that may hold them, so a symmetric
similarity is useless; the search is for containment: the share of an item's 5-word
shingles that a document has.  Items are partitioned by size.  Within a partition whose
largest item has u shingles, an item's sketch is its k = floor((1 - t) u) + 1 smallest
shingle hashes (a bottom-k MinHash sketch; the upper bound of the partition turns the
containment threshold t into k, as in an LSH ensemble).  By the pigeonhole principle a
document that has at least the share t of an item's shingles has one of its sketch, so
no pair is lost.  Documents are partitioned by size too: a document with fewer than
t times the shingles of an item can't contain it.  Candidates are verified by counting
all shingles of the item in the document.

Only DataFrame functions are used.  Defined cases: null, empty and blank texts contain
nothing and are contained in nothing; an item of 1 to 4 words is one shingle of all its
words, and is found in a document's runs of as many words; equal texts have equal
results; repeated rows are each reported; rows with a null id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfold.llm.spark import BROADCAST_BYTES, cut, sized

#: Words are separated by these characters; fixed, the same in Spark's and in DuckDB's regular expressions.
SEPARATORS = "[\\x09-\\x0D\\x20]+"


def words(text: Column) -> Column:
    """The lower-case words of a text (empty array for null and blank ones)."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def grams(w: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words of the array column ``w``."""
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0)))
    return F.when(F.size(w) >= size, F.transform(at, lambda i: F.xxhash64(*[F.element_at(F.col(w), (i + k).cast("int")) for k in range(size)], F.lit(size)))).otherwise(F.array().cast("array<bigint>"))


def item_sketches(items: DataFrame, item_col: str, text_col: str, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """``(item, shingle, q)`` of all shingles and, by size partition, of the sketches."""
    w = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    short = [F.when(F.size("w") == n, grams("w", n)) for n in range(1, size)]
    every = w.select("item", F.array_distinct(F.coalesce(*short, grams("w", size))).alias("g")).withColumn("q", F.size("g"))
    # partitions by powers of two; the upper bound of the partition sets k for all its items
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("q"))))
    k = F.floor((1 - threshold) * upper + 1e-9).cast("int") + 1
    sketch = every.select("item", "q", F.explode(F.slice(F.array_sort("g"), F.lit(1), F.least(k, F.col("q")))).alias("s"))
    return every.select("item", "q", F.explode("g").alias("s")), sketch


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, item_id, common, item_shingles, containment)`` of every document and item at or above the threshold.

    The items' shingles are broadcast only if they take at most ``broadcast_bytes``; else
    the documents' shingles are joined to them by a shuffle.
    """
    every, sketch = (cut(x) for x in item_sketches(items, item_col, item_text, threshold, size))
    n_words = items.select(F.size(words(F.col(item_text))).alias("n")).where(f"n > 0 and n < {size}").distinct().collect()  # at most size - 1 rows
    lengths = [*sorted(r.n for r in n_words), size]
    sketch_side, every_side = sized(sketch, broadcast_bytes), sized(every, broadcast_bytes)

    def shingled(part: DataFrame) -> DataFrame:
        w = part.select("doc", words(F.col("_t")).alias("w"))
        g = grams("w", size) if len(lengths) == 1 else F.concat(*[grams("w", n) for n in lengths])
        return w.select("doc", F.size("w").alias("_n"), F.explode(g).alias("s"))

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("_t"))
    # candidates: a shingle of the sketch met in a document that has words enough
    candidates = cut(shingled(texts).join(sketch_side, "s").where(F.col("_n") >= threshold * F.col("q")).select("doc", "item").distinct())
    found = shingled(texts.join(sized(candidates.select("doc").distinct(), broadcast_bytes), "doc", "left_semi")).join(every_side, "s").select("doc", "item", "q", "s")
    common = found.join(sized(candidates, broadcast_bytes), ["doc", "item"]).groupBy("doc", "item", "q").agg(F.count_distinct("s").alias("common"))
    return common.where(F.col("common") >= threshold * F.col("q") - 1e-9).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "common", F.col("q").cast("long").alias("item_shingles"), (F.col("common") / F.col("q")).alias("containment"))
