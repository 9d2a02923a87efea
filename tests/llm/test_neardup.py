from collections import Counter

import numpy as np
import pyarrow as pa

from lagfold.llm import neardup
from lagfold.llm.text import Words, buffers, shingles


def grams(t):
    w = (t or "").lower().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def sim(a, b):
    x, y = grams(a), grams(b)
    low, high = sum((x & y).values()), sum((x | y).values())
    return low / high if high else 0.0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = [f"x{i}" for i in rng.integers(0, 40, 200)]
    b = a[:120] + [f"y{i}" for i in rng.integers(0, 40, 60)] + a[:30]
    texts = [" ".join(a), " ".join(b), " ".join(a + a), "q", "", None]
    w = Words(*buffers(pa.array(texts)))
    s, t = shingles(w.hashes(), w.of)
    sig = neardup.bagminhash(*neardup.multiset(s, t), len(texts), 4096)
    for i, j in ((0, 1), (0, 2), (1, 2), (0, 3)):
        assert abs((sig[i] == sig[j]).mean() - sim(texts[i], texts[j])) < 0.035, (i, j)
    assert not sig[4:].any() and sig[:4].all()


def brute(rows):
    """Smallest id by class, of links at 0.8 or more, in a plain union-find."""
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = {t for _, t in rows if grams(t)}
    root = {t: t for t in texts}
    for x in texts:
        for y in texts:
            if x < y and sim(x, y) >= 0.8:
                root[find(x)] = find(y)
    out = {}
    for i, t in rows:
        out[(i, t)] = min(j for j, u in rows if grams(u) and find(u) == find(t)) if grams(t) else i
    return out


def corpus():
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        rows.append((i, " ".join(base)))
        i += 1
        for _ in range(6):  # copies with 1 to 5 words changed: similarities on both sides of 0.8
            t = list(base)
            for k in rng.integers(0, 120, rng.integers(1, 6)):
                t[k] = f"v{rng.integers(0, 5000)}"
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A  B"), (505, "a b c"), (0, rows[0][1]), (506, rows[5][1].upper())]
    return rows


def test_classes_by_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = sorted((r.id, r.class_id) for r in neardup.classes(df).collect())
    assert got == sorted((i, c) for (i, _), c in zip(rows, (brute(rows)[r] for r in rows)))
    assert neardup.classes(df.limit(0)).count() == 0


def test_chain_needs_other_leaders(spark):
    """Each text is near only its neighbours; one class all the same."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([f"v{j}" for j in range(6 * k)] + base[6 * k :])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in neardup.classes(df).collect()} == set(brute(rows).values())


def test_a_meeting_gives_a_forest_of_links(spark, monkeypatch):
    """Near copies on both sides of 0.8 in one bucket: fewer links than members come out, whatever the number of pairs, and small blocks lose none."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(120):
        t = list(base)
        for k in rng.choice(100, rng.integers(1, 5), replace=False):
            t[k] = f"v{rng.integers(0, 40)}"
        rows.append((i, " ".join(t)))
    texts = Words(*buffers(pa.array([t for _, t in rows])))
    s, of = shingles(texts.hashes(), texts.of)
    code, text, _ = neardup.multiset(s, of)
    many = np.bincount(text, minlength=len(rows))
    lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x))
    t = pa.array(np.arange(len(rows)))
    block = neardup._Block(t, pa.array(many), pa.array(many), t, lists(np.zeros(len(rows), np.int64), np.ones(len(rows), int)), lists(code.view(np.int64), many))
    pairs = sum(sim(a, b) >= 0.8 for k, (_, a) in enumerate(rows) for _, b in rows[:k])
    links = neardup._forest(block, block, 0, 0.8)
    assert len(links) < len(rows) < pairs
    root = list(range(len(rows)))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    want = brute(rows)
    assert [min(j for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))] == [want[r] for r in rows]

    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = {r.id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[(i, t)] for i, t in rows}
