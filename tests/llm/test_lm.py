import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfold.llm import lm
from lagfold.llm.eliasfano import EliasFano, MappedTrie, Trie, quantise

U = np.uint64


@pytest.mark.parametrize("universe", [50, 1000, 10**6, 1 << 40, 1 << 63])
def test_elias_fano(universe):
    rng = np.random.default_rng(universe % 97)
    for n in (0, 1, 40, 3000):
        v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        ef = EliasFano.build(v, universe)
        assert (ef.access(np.arange(len(v))).astype(U) == v).all()
        x = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
        want = [int(np.searchsorted(v, y)) if y in set(v.tolist()) else -1 for y in x]
        assert ef.find(x).tolist() == want
    steps = np.sort(rng.integers(0, 30, 200))
    assert (EliasFano.build(steps, 31).access(np.arange(200)) == steps).all()


def test_quantise():
    v = np.random.default_rng(0).normal(size=20_000)
    code, book = quantise(v)
    assert code.max() < 255 and np.abs(book[code] - v).mean() < 0.02
    code, book = quantise(np.array([1.0, 2.0, 1.0]))
    assert book[code].tolist() == [1.0, 2.0, 1.0]


def test_trie_children():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 1 << 62, 50, dtype=np.uint64))
    vocab = np.unique(rng.integers(0, 1 << 40, 80, dtype=np.uint64))
    pair = np.unique(rng.integers(0, len(words) * len(vocab), 300))
    parent, rank = pair // len(vocab), pair % len(vocab)
    t = MappedTrie(Trie.arrays(words, np.full(len(words), 99), vocab, [(parent, rank, np.ones(len(pair), np.int64))], 0.5))
    every = np.arange(len(words) * len(vocab))
    got = t.child(0, every // len(vocab), every % len(vocab))
    assert (got >= 0).sum() == len(pair) and (got[pair] == np.arange(len(pair))).all()


def brute(rows, order, d):
    train, grams = Counter(), [Counter() for _ in range(order + 1)]
    tokens = [(i, t, [*(t or "").lower().split(), "</s>"]) for i, t, _ in rows]
    for (_, _, ws), (_, _, learn) in zip(tokens, rows):
        if learn:
            train.update(ws)
            seq = ["<s>", *ws]
            for k in range(2, order + 1):
                grams[k].update(tuple(seq[j : j + k]) for j in range(len(seq) - k + 1))
    n, v = sum(train.values()), len(train)
    mass, kinds = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            mass[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1
    out = []
    for i, _, ws in tokens:
        seq, base, total = ["<s>", *ws], 0.0, 0.0
        for j in range(1, len(seq)):
            p = (train[seq[j]] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, min(order, j + 1) + 1):
                g = tuple(seq[j - k + 1 : j + 1])
                if mass[k][g[:-1]]:
                    p = max(grams[k][g] - d, 0) / mass[k][g[:-1]] + d * kinds[k][g[:-1]] / mass[k][g[:-1]] * p
            total += math.log10(p)
        out.append((i, len(ws), sum(train[w] > 0 for w in ws), n, base, total))
    return sorted(out, key=str)


@pytest.mark.parametrize("order,block,shards", [(2, 10**6, 5), (3, 300, 5), (3, 200, 40), (4, 500, None)])
def test_scores_by_brute_force(spark, order, block, shards):
    """With 40 shards most words' n-grams lie in several."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"W{k}" for k in (rng.zipf(1.4, rng.integers(0, 60)) % 90)), i % 4 != 1) for i in range(120)]
    rows += [(None, "w1 w2 w1", True), (-(2**63), "w1 w3", True), (500, None, True), (501, "", False), (502, " \n", True), (3, rows[3][1], True), (503, "unheard words", False)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, learn boolean, score int").repartition(3)
    got = sorted((tuple(r) for r in lm.score(df, F.col("learn"), order=order, block_tokens=block, shards=shards).collect()), key=str)
    want = brute(rows, order, 0.75)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=0.01)
    assert lm.score(df.limit(0), F.col("learn")).count() == 0


def test_layout_cuts_frequent_words():
    layout = lm.Layout(4, [(1 << 60, 0.5), (5, 0.01)])
    assert len(layout) == 4 + 4 + 1 and layout.first[0] == 0 and (layout.first == 1 << 60).sum() == 4
    words = np.array([7, 1 << 60, 1 << 62], U)
    parent, word = np.array([0, 1, 1, 2]), np.array([1, 0, 2, 0])
    at, pair, within = layout.cuts(words, parent, word)
    assert at.tolist()[:6] == [0, 1, 1, 1, 1, 2] and within.tolist()[:6] == [False, False, True, True, True, False]
    assert pair.tolist()[:6] == [0, 1, 2, 2, 3, 3]


def test_query_scores_by_trigrams(spark, tmp_path):
    from lagfold.llm.queries import op1_trie_lm

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in (rng.zipf(1.4, rng.integers(0, 60)) % 20))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op1_trie_lm(spark, str(tmp_path)).collect(), key=lambda r: str(r.doc_id))
    learn = {r.doc_id: not r.held_out for r in got}
    want = brute([(i, t, learn[i]) for i, t in rows], 3, 0.75)
    assert [r.doc_id for r in got] == [w[0] for w in want] and 0 < sum(learn.values()) < 120
    assert np.allclose([r.score for r in got], [w[5] for w in want], rtol=0.01)
