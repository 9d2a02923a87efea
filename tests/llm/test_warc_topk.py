import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfold.llm import topk, warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("per_file,range_bytes", [(7, 1 << 27), (1000, 700), (1000, 97)])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, per_file, range_bytes):
    """Chains cross byte ranges, also of fewer bytes than a header; payloads hold the magic and whole records."""
    try:
        _round_trip(spark, tmp_path, per_file, range_bytes)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _round_trip(spark, tmp_path, per_file, range_bytes):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    html = [trap, "é" * 10, "", None, "dup", "dup", trap, "a\r\n\r\nb\n", "\x00nul"] + [f"<p>{i}</p>" for i in range(40)]
    df = spark.createDataFrame([(i, f"http://h/{i} \n", h, "c") for i, h in enumerate(html)] + [(None, None, "q", "")], "page_id long, url string, html string, type string").repartition(3)
    folder = f"file://{tmp_path}/w"
    warc.write(warc.plan(df), folder, records_per_file=per_file)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    rows = warc.read(spark, folder, payloads=True).select("*", warc.id_of(F.col("record_id")).alias("i"), warc.id_of(F.col("refers_to")).alias("r")).collect()
    got = {r.i: r for r in rows}
    assert len(rows) == len(html) + 1 and all(r.intact for r in rows) and None in got
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), sha(raw))
        want = None if first[h or ""] == i else first[h or ""]
        assert r.r == want and r.type == ("revisit" if want is not None else "response")
        assert bytes(r.payload) == (b"" if want is not None else raw)
    assert warc.plan(df, least_bytes=10).where("refers_to is not null and bytes < 10").count() == 0


def test_truncated_file(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 5) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.plan(df), f"file://{tmp_path}/w")
    (part,) = (tmp_path / "w").glob("part-*")
    raw = part.read_bytes()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.warc").write_bytes(raw[: raw.rindex(warc.MAGIC) + 200])
    (tmp_path / "x" / "b.warc").write_bytes(b"junk" + raw)
    assert warc.read(spark, f"file://{tmp_path}/x").count() == 8


def test_pointer_jumping():
    off = np.array([0, 10, 15, 30, 44, 60])
    nxt = np.array([10, 30, 30, 60, 60, 71])
    assert warc.reachable(off, nxt).tolist() == [True, True, False, True, False, True]
    n = 1000
    assert warc.reachable(np.arange(n), np.arange(1, n + 1)).all()
    assert warc.exits(off, nxt).tolist() == [71, 71, 71, 71, 71, 71] and warc.exits(off[1:3], nxt[1:3]).tolist() == [30, 30]
    assert not warc.reachable(np.array([5, 9]), np.array([9, 12])).any() and not len(warc.reachable(off[:0], nxt[:0]))


def brute(rows, k, div):
    v = [(i, [int(np.floor(256 * c)) for c in x]) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(256 * c) for c in x)]
    out = []
    for q, own in v:
        if q % div == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, other)))), c) for c, other in v if c != q and len(other) == len(own))[:k]
            out += [(q, r, c, -x) for r, (x, c) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_by_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)) * np.exp(spread * rng.normal(size=(400, 1)))
    x[100:140] = x[7]  # ties
    x[200] = 0
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [float("nan")] * 8), (1002, [None] + [1.0] * 7), (1003, []), (1010, [1.0, 2.0]), (1011, [3.0, 4.0]), (None, [1.0] * 8), (1020, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    assert sorted(map(tuple, topk.top_k(df, 5, 10, block_values=480).collect())) == brute(rows, 5, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_of_repeated_rows_and_huge_components(spark):
    """Every row is a candidate: six copies of the best one fill the ranks; a repeated query is answered twice."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(45)]
    rows += [(7, [5.0] * 4)] * 6 + [(10, rows[10][1])] + [(60, [1e30, 0.0, 0.0, 0.0]), (61, [3.0, 0.0, 0.0, 0.0]), (62, [-1e15, 2.0, 0.0, 0.0]), (63, [1e306] * 4), (64, [1e307] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query_row": F.lit("x"), "row": F.lit(0)})
    got = sorted(map(tuple, topk.top_k(df, 5, 10, block_values=32).collect()))
    assert got == brute(rows, 5, 10) and len(got) == 5 * 7


def test_survivors_keep_all_that_reach_the_bound():
    rng = np.random.default_rng(9)
    for scale in (1.0, 30.0):
        q, c = np.rint(rng.normal(size=(30, 6)) * 50), np.rint(rng.normal(size=(500, 6)) * 50 * np.exp(rng.normal(size=(500, 1)) / scale))
        s = topk.products(q, c)
        bound = np.sort(s, axis=1)[:, -5]
        keep = topk.survivors(q, bound, c, np.sqrt((c**2).sum(1)))
        assert keep[s >= bound[:, None]].all() and keep.mean() < 0.8
