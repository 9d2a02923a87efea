"""Filter audit and vector codes against SQL and plain versions."""

import glob
import hashlib
import os
from itertools import permutations

import duckdb
import numpy as np
import pytest

from lagfold.llm import audit, kdcodes, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", ["op11_filtering_lloyd", "op12_filter_audit"])
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())


def plain_audit(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = [x for x in __import__("re").split("[ \t\n\x0b\x0c\r]+", t) if x]
        late = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        docs.append((part or "", i in good, i in bad, {"A": len(w) < 50, "B": 100 * len({*w}) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": late}))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = {}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                there = [d for d in own if not any(d[3][x] for x in order[:k])]
                gone = [d for d in there if d[3][f]]
                shapley[f] = shapley.get(f, 0) + len(gone)
                redundant = sum(d[3][f] for d in own) - len(gone)
                out[part, order, k + 1] = [f, len(there) - len(gone), len(gone), redundant, sum(d[3][f] and sum(d[3].values()) == 1 for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[v[0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG + " x", "a"), (4, LONG + " y", None), (5, None, ""), (6, "", "a"), (7, " \n ", "b"), (None, LONG, "b"), (None, "", "b"),
    (8, "UP " * 60, "b"), (9, LONG + " 50%", "b"), (10, "é" * 100 + "ABCDEF", "a"), (11, "x" * 3000 + "a", "a"), (12, "x" * 3000 + "b", "a"), (13, "x" * 3000 + "b", "b"), (14, ("w " * 30 + "v ") * 5000, "b"), (15, "a\x1cb c d", "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (8, 0, 1), (9, 1, None), (None, 1, 1), (12, None, 1), (99, 1, 1)]


@pytest.mark.parametrize("blocks", [audit.BLOCKS, (2,), ()])
def test_audit_by_hand(spark, blocks):
    """Without blocks, texts of equal length count as texts of equal hashes and are told apart by themselves."""
    docs = spark.createDataFrame([(*r, 0, "n") for r in ROWS], "doc_id long, text string, source string, mask int, t string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(docs, labels, blocks=blocks).collect()}
    assert got == plain_audit(ROWS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0 and audit.audit(docs, labels.limit(0)).count() == 600 * 3


def plain_codes(rows, entries=16, rounds=6, parts=8):
    kept = sorted(((i is None, i or 0, [int(np.clip(np.floor(4096 * float(x)), -(1 << 24), 1 << 24)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v) and len(v) % parts == 0), key=lambda r: r[:3])
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    w = len(kept[0][2]) // parts
    points = [[r[2][p * w : (p + 1) * w] for r in kept] for p in range(parts)]
    books = [own[:entries] for own in points]
    nearest = lambda x, c: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(c))
    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(x, books[p])[1] for x in points[p]]
            books[p] = [[sum(v) // len(v) for v in zip(*own)] if (own := [x for x, a in zip(points[p], at) if a == k]) else e for k, e in enumerate(books[p])]
    coded = [[nearest(points[p][n], books[p]) for p in range(parts)] for n in range(len(kept))]
    error = [sum(d for d, _ in c) for c in coded]
    by = {}
    for r, e in zip(kept, error):
        by[r[3]] = by.get(r[3], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((None if r[0] else r[1], "".join(f"{k:02x}" for _, k in c), e, by[r[3]], digest)) for r, c, e in zip(kept, coded, error))


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) * spread) / spread  # many ties
    return [(int(k), [float(v) for v in row], int(k % 3) if k % 7 else None) for k, row in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("n,dim,spread,block", [(700, 16, 2, 300), (300, 8, 1, 64), (900, 24, 50, 4096), (5, 16, 3, 100)])
def test_codes_by_hand(spark, n, dim, spread, block):
    rows = vectors(n, n, dim, spread)
    rows += [rows[0], rows[1], (None, rows[2][1], 1), (3, rows[4][1], None), (-5, None, 1), (-4, [], 1), (-3, [0.0] * 7 + [None] * (dim - 7), 1), (-2, [float("nan")] * dim, 1), (-1, [float("inf")] * dim, 1), (-6, [1.0] * (dim - 1), 1), (2, [1e30, -1e30] * (dim // 2), 1), (50, [0.5] * dim * 2, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, error int, vec int")
    got = kdcodes.compress(df, block=block).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_codes(rows)
    assert kdcodes.compress(df.limit(0)).count() == 0 and kdcodes.compress(df.where("embedding is null")).count() == 0


def test_trees_assign_whole_nodes():
    """Filtering equals looking at every point, and looks at far fewer."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-40, 40, (2000, 3)) + c for c in rng.integers(-4000, 4000, (12, 3))])
    tree, order = kdcodes.Tree.build(x)
    assert (x[order] == tree.points).all() and sorted(order.tolist()) == list(range(len(x)))
    books = x[rng.choice(len(x), 16)]
    chosen = np.zeros(len(x), np.int64)
    sums, counts = tree.filter(books, chosen)
    best = ((tree.points[:, None] - books) ** 2).sum(2).argmin(1)
    assert (chosen == best).all() and (counts == np.bincount(best, minlength=16)).all()
    assert all((sums[k] == tree.points[best == k].sum(0)).all() for k in range(16))
