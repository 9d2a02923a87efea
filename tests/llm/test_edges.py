"""Every registered corpus query on tables with nulls, empty and very long texts, repeated rows and clashing names; and on empty tables."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagfold.llm import neardup, quality, queries, suffix
from lagfold.llm.spark import fresh

CLASH = ("_k", "_id", "_drop", "_tag", "_d", "removable", "_score", "_hit", "id", "k", "t", "row", "label", "_text", "shard", "score")


def texts():
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3000, n))
    long, item, passage = word(30_000), word(30), word(60)
    rows = [(i, word(int(rng.integers(30, 90)))) for i in range(60)]
    rows += [(None, word(50)), (None, f"{word(20)} {item} {word(20)}"), (None, rows[3][1] + " x"), (None, None), (70, None), (71, ""), (72, " \n\t"), (73, long), (74, long + " y"), (75, "one"), (76, "ONE")]
    rows += [rows[5], rows[5], (5, word(40)), (80, f"{word(30)} {passage} {word(9)}"), (81, f"{passage} {word(70)}"), (82, f"{word(15)} {item}"), (83, "q" * 20_000)]
    rows += [(100 + i, "BUY!! NOW!! " * 20 + f"A{i}") for i in range(30)] + [(200 + i, word(40) + " you scumbag") for i in range(30)]
    return rows, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('edges')}"
    rows, item = texts()
    docs = spark.createDataFrame([(i, t, None if k % 7 == 0 else "en", "hot", len(t) if t else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(f"{c}!") for c in CLASH}).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0 if 100 <= i < 130 else 1, int(200 <= i < 230)) for i, _ in rows if i is not None] + [(None, 1, 1), (9, None, None), (12345, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (None, item), (2, None), (3, ""), (4, "absent words here")], "item_id long, text string").withColumn("doc", F.lit(1)).write.parquet(f"{d}/benchmark.parquet")
    pages = [(i, None if i % 5 == 0 else f"http://h/{i}", [None, "", "same", f"p{i}", "WARC/1.1\r\nx"][i % 5]) for i in range(25)] + [(3, "u", "p3"), (None, None, "same")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit("z"), "id": F.lit(0)}).write.parquet(f"{d}/pages.parquet")
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(50, None), (None, [1.0] * 6), (7, [9.0] * 6), (7, [9.0] * 6), (200, []), (300, [float("nan")] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "row": F.lit(2), "label": F.expr("cast(vec_id % 3 as int)")}).write.parquet(f"{d}/embeddings.parquet")
    return d, rows


@pytest.fixture(scope="module")
def nothing(spark, tables, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('empty')}"
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


def test_no_rows(spark, nothing):
    for name, query in (queries.queries() | {"pipeline": corpus_pipeline.run}).items():
        assert query(spark, nothing).count() == 0, name


@pytest.mark.parametrize("name", ["op1_trie_lm", "op5_bagminhash", "op7_quality", "op8_propagation", "op9_bpe", "op10_toxicity"])
def test_a_row_for_each_document(spark, tables, name):
    d, rows = tables
    got = queries.queries()[name](spark, d).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    if name in ("op1_trie_lm", "op7_quality", "op10_toxicity"):
        m, rest = {"op1_trie_lm": (5, 1), "op7_quality": (4, 2), "op10_toxicity": (3, 1)}[name]
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % m == rest) for r in got)
        assert all(math.isfinite(r.score) for r in got)
    if name == "op7_quality":
        assert len({r.score for r in got if r.doc_id in (70, 71, 72)}) == 1 and all(r.predicted == (r.score >= 0.7) for r in got)
        assert sum(r.predicted for r in got if r.doc_id and 100 <= r.doc_id < 130) == 0
    if name == "op10_toxicity":
        assert all(r.predicted == (r.doc_id is not None and 200 <= r.doc_id < 230) for r in got)
    if name == "op5_bagminhash":
        of = {r.doc_id: r.class_id for r in got}
        assert of[74] == 73 and of[76] == 75 and of[70] == 70 and of[72] == 72
        assert [r.class_id for r in got if r.doc_id is None].count(3) == 1  # a near copy without an id


def test_sql_of_the_rows_found(spark, tables):
    d, _ = tables
    c = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d.removeprefix('file://')}/{name}.parquet/*.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, d)
        rel = c.execute(sql)
        names = [x[0] for x in rel.description]
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, rel.fetchall())), name


def test_archives(spark, tables):
    d, _ = tables
    got = queries.op3_warc(spark, d).collect()
    assert len(got) == 27 and all(r.intact for r in got)
    assert {(r.record_type, r.refers_to) for r in got if r.page_id is None} == {("revisit", 2)}


def test_passages(spark, tables):
    d, _ = tables
    got = {r.doc_id for r in queries.op6_suffix(spark, d).collect()}
    assert {73, 74, 80, 81} <= got and not got & {70, 71, 72, 83}


def test_stages_keep_columns_and_rows_without_ids(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = neardup.keep_one(docs)
    assert kept.columns == columns
    got = kept.select("doc_id", "text").collect()
    assert sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None and r.text is None for r in got) == 1
    assert not any(r.doc_id is None and r.text == rows[3][1] + " x" for r in got)
    cut = suffix.without_repeats(docs, length_col="n_chars")
    assert cut.columns == columns and all(r.n_chars == len(r.text) for r in cut.collect() if r.text and r.doc_id not in (5,))
    assert quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))).columns == columns
    item = texts()[1]
    left = corpus_pipeline.decontamination(spark, docs, d)
    assert left.columns == columns and left.count() == len(rows) - 2 and not any(item in (r.text or "") for r in left.collect())
    out = corpus_pipeline.run(spark, d).collect()
    assert out and not any(r.doc_id in (74, 82) or r.doc_id and 100 <= r.doc_id < 130 for r in out)


def test_fresh_names():
    assert fresh(["a", "_K", "_k_"], "_k", "b", "b") == ("_k__", "b", "b_")
