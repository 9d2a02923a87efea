"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfold.shipping import ship

#: Where the public tokenizer files lie; a parameter, never copied.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


#: Exact containment of each item's different 5-word shingles (all its words, if fewer) in each document.
CONTAINMENT_SQL = """
  dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM {documents} WHERE doc_id IS NOT NULL),
  iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
  ig AS (SELECT DISTINCT item_id, least(len(w), 5) AS n, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) > 0),
  q AS (SELECT item_id, count(*) AS q FROM ig GROUP BY item_id),
  lengths AS (SELECT DISTINCT n FROM ig),
  dg AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM dw, lengths WHERE len(w) >= n),
  hit AS (SELECT doc_id, item_id, count(*) AS common FROM dg JOIN ig USING (n, s) GROUP BY ALL),
  contained AS (SELECT doc_id, item_id, common, q AS item_shingles, common / q AS containment FROM hit JOIN q USING (item_id) WHERE common >= 0.8 * q - 1e-9)
"""
OP2_SQL = "WITH" + CONTAINMENT_SQL.format(documents="documents") + "SELECT * FROM contained"

OP4_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts by bytes, not by 10,000 rows; a smaller bound of the session stays."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int):
    """Whether crc32(doc_id as text) leaves the rest; rows without an id aren't held out."""
    from lagfold.llm.text import crc_rest

    return F.coalesce(crc_rest("doc_id", modulus) == rest, F.lit(False)).alias("held_out")


def tokenizer_spec(name: str) -> str:
    """The text of a tokenizer's file, read by the driver."""
    try:
        import public_tokenizers

        return Path(public_tokenizers.path(name)).read_text()
    except ModuleNotFoundError:
        return Path(TOKENIZERS, name).read_text()


def word_bpe_spec() -> str:
    return tokenizer_spec("word_bpe_49k.json")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.suffix import repeats

    return repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "copy", "shared", "spans", "removable")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(4, 2), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(3, 1), "score", "predicted")


def op1_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm import lm
    from lagfold.llm.text import crc_rest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, crc_rest("doc_id", 5) != 1, order=3)
    return scored.select("doc_id", held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.decontaminate import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm import warc
    from lagfold.llm.spark import shared_folder

    folder = shared_folder(spark, "warc")
    warc.write(warc.plan(table(spark, sf_dir, "pages")), folder)
    return warc.read(spark, folder).select(
        warc.id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.id_of(F.col("refers_to")).alias("refers_to"), "intact"
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", F.col("n").alias("n_shingles"))


def op8_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), word_bpe_spec())


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.kdcodes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagfold.llm import tokenfile
    from lagfold.llm.spark import shared_folder

    folder = shared_folder(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), folder, tokenizer_spec("byte_bpe_50k.json"))
    return tokenfile.read(spark, folder).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_trie_lm": op1_trie_lm, "op2_containment": op2_containment, "op3_warc": op3_warc, "op4_topk": op4_topk, "op5_bagminhash": op5_bagminhash, "op6_suffix": op6_suffix, "op7_quality": op7_quality, "op8_propagation": op8_propagation, "op10_toxicity": op10_toxicity, "op9_bpe": op9_bpe, "op11_filtering_lloyd": op11_filtering_lloyd, "op12_filter_audit": op12_filter_audit, "op13_token_file": op13_token_file}


def oracle_sql() -> dict[str, str]:
    from lagfold.llm.audit import audit_sql
    from lagfold.llm.kdcodes import compress_sql

    return {"op2_containment": OP2_SQL, "op4_topk": OP4_SQL, "op11_filtering_lloyd": compress_sql(), "op12_filter_audit": audit_sql()}
