import zlib
from collections import Counter

from lagfold.llm.sharding import _grants, shard


def check(rows, n, shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max((sizes.get(k, 0) for k in range(shards)), default=0) - min((sizes.get(k, 0) for k in range(shards)), default=0) <= 1
    for k, c in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(c))
    assert all(0 <= r.shard < shards and r.law == "rows" and r.grown_shard is None for r in rows)


def cut_share(rows, text):
    """Of the rows of small groups, the share that aren't with most of their group."""
    where = {}
    for r in rows:
        where.setdefault(text[r.doc_id], []).append(r.shard)
    small = [v for v in where.values() if 1 < len(v) <= 20]
    return sum(len(v) - max(Counter(v).values()) for v in small) / max(1, sum(map(len, small)))


def test_balance_and_links(spark):
    text = {i: "hot" for i in range(300)} | {300 + i: f"pair {i // 2}" for i in range(200)} | {500 + i: f"five {i // 5}" for i in range(100)} | {600 + i: f"single {i} é" for i in range(303)}
    df = spark.createDataFrame([(k, v, 1) for k, v in text.items()], "doc_id long, text string, slot int")
    rows = shard(df).collect()
    check(rows, len(text), 8)
    assert cut_share(rows, text) < 0.12
    assert len({r.shard for r in rows if text[r.doc_id] == "hot"}) <= 5
    for r in rows:
        raw = text[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (None, "x"), (3, "y")], "doc_id long, text string")
    rows = shard(df, 3).collect()
    check(rows, 6, 3)
    assert all(r.size == 1 and r.text_crc32 == 0 for r in rows if r.doc_id in (1, 2))
    assert shard(df.limit(0)).count() == 0


def test_grants_keep_the_quota():
    sizes, wishes = [10, 10, 4], {(0, 1): 5, (1, 0): 3, (0, 2): 4, (1, 2): 9}
    g = _grants(sizes, wishes, 8, 3)
    for k in range(3):
        into, out = (sum(g[p] * n for p, n in wishes.items() if p[e] == k) for e in (1, 0))
        assert sizes[k] + into - out <= max(8, sizes[k]) + 1e-9
    assert g[1, 0] == 1.0 and sum(g[p] * n for p, n in wishes.items() if p[1] == 2) == 4
