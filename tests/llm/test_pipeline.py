import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lagfold.llm.queries import word_bpe_spec
from tests.llm.test_neardup import brute as classes
from tests.llm.test_suffix import coverage


def write(spark, folder):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    passage, item = word(60), word(12)
    good = [(i, " ".join(word(int(rng.integers(60, 120))))) for i in range(80)]
    rows = good + [(80 + i, good[i][1] + " x") for i in range(10)] + [(100 + i, " ".join(word(40) + passage + word(30))) for i in range(5)]
    rows += [(110, " ".join(word(30) + item + word(30)))] + [(120 + i, "SPAM!! WOW!! " * 40 + f"A{i}!!") for i in range(40)] + [(5, good[5][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int("SPAM" not in t), 0) for i, t in rows if i < 80 or i >= 120], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_by_brute_force(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = write(spark, d)
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, d))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    good = sorted(r for r in rows if "SPAM" not in r[1])
    assert left["quality"] == good
    of = classes(good)
    assert left["near_dedup"] == sorted({r for r in good if of[r] == r[0]})
    _, cover = coverage(left["near_dedup"])
    seen = {tuple(t.split()) for _, t in left["passage_dedup"]}
    for i, t in left["near_dedup"]:
        ws = tuple(t.split())
        first = i == min((j for j, u in left["near_dedup"] if cover.get(tuple(u.split()))), default=-1)
        assert (ws if first or not cover.get(ws) else tuple(w for k, w in enumerate(ws) if k not in cover[ws])) in seen
    assert left["decontamination"] == [r for r in left["passage_dedup"] if r[0] != 110]
    tok = Tokenizer.from_str(word_bpe_spec())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in left["decontamination"]}


def test_decontamination_without_ids(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"some words {item} and more"), (None, "clean words"), (None, None), (5, f"before {item}"), (5, "clean with the same id"), (6, "clean")]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, left), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
