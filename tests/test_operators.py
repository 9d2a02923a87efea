"""Operators on small generated runs: seams, contrast, geometry, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfold.functions import kinetics as K
from lagfold.operators import bound, coding, counts, frames, geometry, stats
from lagfold.streaming.counts import stream_counts, stream_moments
from tests.test_kinetics import chain, two_state


def runs(spark, *states):
    return spark.createDataFrame([(r, t, int(s)) for r, ss in enumerate(states) for t, s in enumerate(ss)], "run_id long, t long, state int")


def test_no_pair_crosses_a_run(spark):
    df = runs(spark, [0, 0, 1, 1], [1, 1, 0, 0])
    assert counts.transition_counts(df).agg(F.sum("c")).first()[0] == 6
    assert counts.transition_counts(df, 4).count() == 0
    assert {(r.lag, r.i, r.j): r.c for r in counts.counts_by_lag(df, [1, 2]).collect()}[(2, 0, 1)] == 2


def test_empty_and_null_states(spark):
    df = spark.createDataFrame([], "run_id long, t long, state int")
    assert counts.transition_counts(df).count() == 0 and counts.stationary(counts.symmetrised(counts.transition_counts(df))).count() == 0
    assert stats.entropy(df, "state").first().n is None


def test_transition_term_sees_slower_kinetics(spark):
    p, q = (np.array(x) for x in (two_state(0.02), two_state(0.2)))
    pair = [counts.dense(counts.symmetrised(counts.transition_counts(runs(spark, chain(t, 8000, 1)))), 2) for t in (p, q)]
    t, pi = zip(*[(counts.transition_matrix(c), counts.stationary(c)) for c in pair])
    ens, tra = bound.ensemble_kl(pi[0], pi[1]).first()[0], bound.transition_kl(t[0], t[1], pi[0]).first()[0]
    assert tra > 10 * ens and tra > 0.05
    dense = [K.dense_counts([(r.i, r.j, r.c) for r in c.collect()], 2) for c in pair]
    f = K.fidelity(*(K.transition_matrix(c)[0] for c in dense))
    assert (f.ensemble, f.transition) == (pytest.approx(ens, abs=1e-9), pytest.approx(tra, abs=1e-9))


def wells(n, atoms, seed=0):
    rng = np.random.default_rng(seed)
    s = chain(np.array([[0.99, 0.01, 0], [0.01, 0.98, 0.01], [0, 0.01, 0.99]]), n, seed)
    base, mode = rng.normal(size=(atoms, 3)) * 2, rng.normal(size=(atoms, 3))
    mode /= np.linalg.norm(mode)
    return base + ((s - 1) * 2 + 0.25 * rng.normal(size=n))[:, None, None] * mode + 0.1 * rng.normal(size=(n, atoms, 3))


@pytest.fixture(scope="module")
def coords(spark):
    x = [wells(500, 6, k) for k in (1, 1)]
    df = spark.createDataFrame([(r, t, [float(v) for v in f.ravel()]) for r, fs in enumerate(x) for t, f in enumerate(fs)], "run_id long, t long, xyz array<double>")
    return df.cache(), x


def test_alignment_undoes_rotations(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(size=(12, 3))
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    moved = np.stack([ref @ q + [3.0, -1, 2], ref])
    aligned, rmsd = geometry.superpose(moved, ref)
    assert np.allclose(aligned, ref - ref.mean(0)) and np.allclose(rmsd, 0, atol=1e-6)
    assert np.allclose(geometry.superpose(moved, ref, True)[0], ref)
    df = spark.createDataFrame([(0, t, [float(v) for v in f.ravel()]) for t, f in enumerate(moved)], "run_id long, t long, xyz array<double>")
    assert max(r.rmsd for r in geometry.kabsch(df, ref).collect()) < 1e-6


def test_moments_add_up_and_tica(spark, coords):
    df, x = coords
    flat = [f.reshape(len(f), -1) for f in x]
    frame = df.withColumn("x", F.col("xyz"))
    n, s, _, c, _, _ = geometry.moments(frame)
    assert n == 1000 and np.allclose(s, sum(f.sum(0) for f in flat)) and np.allclose(c, sum(f.T @ f for f in flat))
    whole = geometry.Tica(5, 2).fit(frame)
    parts = geometry.Tica(5, 2).partial_fit(frame.where("run_id = 0")).partial_fit(frame.where("run_id = 1")).finalise()
    assert np.allclose(whole.projection, parts.projection, atol=1e-6) and whole.timescales[0] > 10
    w = geometry.Whitening.fit(frame, rank=4)
    z = w.forward(np.concatenate(flat))
    assert np.allclose(np.cov(z.T), np.eye(4), atol=1e-6)
    cells, centres = geometry.discretise(whole.transform(frame), 3)
    assert cells.agg(F.count_distinct("state")).first()[0] == 3 and centres.shape == (3, 2)


def test_coders_over_runs(spark):
    df = runs(spark, chain(two_state(0.05), 500, 3), [1], chain(two_state(0.2), 300, 4))
    t, pi = coding.markov_model(df, 2)
    back = coding.decode_runs(coding.encode_runs(df, t, pi), t, pi)
    assert back.exceptAll(df.select("run_id", "t", "state")).count() == 0 and back.count() == df.count()


def test_nearest_weights_and_ties(spark):
    pts = spark.createDataFrame([(k, float(k)) for k in range(11)], "id int, x double")
    centres = spark.createDataFrame([(1, 8.0), (0, 2.0), (2, 100.0)], "state int, x double")
    got = stats.nearest(pts, centres, ["x"])
    assert {r.id: r.state for r in got.collect()} == {k: 0 if k <= 5 else 1 for k in range(11)}
    assert {r.state: round(r.weight, 6) for r in stats.cell_weights(got, centres).collect()} == {0: round(6 / 11, 6), 1: round(5 / 11, 6), 2: 0.0}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.5, 1.0, 1.0001)], "x double")
    assert [r.n for r in stats.histogram(df, F.col("x"), 0.0, 1.0, 4).orderBy("bin").collect()] == [1, 0, 1, 1]


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    s = rng.integers(0, 3, (4, 60))
    source = str(tmp_path / "in")
    for k in range(3):  # three micro-batches
        rows = [(r, t, int(s[r, t]), [float(s[r, t]), float(t % 7)]) for r in range(4) for t in range(20 * k, 20 * k + 20)]
        spark.createDataFrame(rows, "run_id long, t long, state int, x array<double>").coalesce(1).write.mode("append").parquet(source)
    batch = spark.read.parquet(source)
    for lag in (1, 3):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream_counts(stream, lag).writeStream.format("memory").queryName(f"c{lag}").outputMode("append").option("checkpointLocation", str(tmp_path / f"k{lag}")).start()
        q.processAllAvailable()
        q.stop()
        got = {(r.i, r.j): r.c for r in spark.sql(f"SELECT i, j, sum(c) AS c FROM c{lag} GROUP BY i, j").collect()}
        files = sorted({r[0] for r in batch.select(F.input_file_name()).distinct().collect()})
        assert len(files) == 3 and got == {(r.i, r.j): r.c for r in counts.transition_counts(batch, lag).collect()}
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream_moments(stream, 2).writeStream.format("memory").queryName("m").outputMode("append").option("checkpointLocation", str(tmp_path / "m")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM m").collect()
    n, _, _, c, _, _ = geometry.moments(batch)
    nt, _, _, _, ct, _ = geometry.moments(counts.lag_pairs(batch, 2, columns=("x",)), "x", "next_x")
    assert sum(r.n for r in rows) == n and sum(r.nt for r in rows) == nt
    assert np.allclose(sum(np.array(r.c0) for r in rows), c.ravel()) and np.allclose(sum(np.array(r.ct) for r in rows), ct.ravel())


def test_names_and_strides():
    assert frames.evenly_spaced(5, 64) == [0, 1, 2, 3, 4] and frames.evenly_spaced(100, 3) == [0, 49, 99] and frames.evenly_spaced(4, 1) == [0]


def test_a_long_run_in_ranges_has_the_pairs_of_a_window(spark):
    rng = np.random.default_rng(2)
    df = runs(spark, rng.integers(0, 4, 1000), rng.integers(0, 4, 7), rng.integers(0, 4, 30))
    for lag in (1, 3, 10, 40):
        for span in (1, 16, 64, 1 << 16):
            got = sorted((r.i, r.j, r.c) for r in counts.transition_counts(df, lag, span=span).collect())
            want = {}
            rows = sorted((r.run_id, r.t, r.state) for r in df.collect())
            by = {}
            for r, _, s in rows:
                by.setdefault(r, []).append(s)
            for s in by.values():
                for a, b in zip(s, s[lag:]):
                    want[a, b] = want.get((a, b), 0) + 1
            assert got == sorted((*k, c) for k, c in want.items())
    many = sorted(map(tuple, counts.counts_by_lag(df, [1, 10], span=16).collect()))
    assert many == sorted((n, *r) for n in (1, 10) for r in map(tuple, counts.transition_counts(df, n).collect()))


def test_numbering_without_gaps(spark):
    df = spark.createDataFrame([(r, t * t, t) for r in (1, None) for t in range(50)], "run_id long, t long, want long")
    assert frames.renumbered(df, span=100).where("t != want").count() == 0
    every = frames.stride(spark.createDataFrame([(0, t) for t in range(35)], "run_id long, t long"), 10)
    assert sorted(r.t for r in every.collect()) == [0, 1, 2, 3]
    names = spark.createDataFrame([(f"run-{k:03d}", 2) for k in range(40)], "run_id string, n long")
    assert frames.offsets(names, "run_id", "n", "at", 8).where("at != 2 * cast(substring(run_id, 5) as int)").count() == 0


def test_moments_of_hard_tables(spark):
    rows = [(0, t, [float(t), float(t % 3)]) for t in range(40)] + [(1, 0, None), (1, 1, None)]
    df = spark.createDataFrame(rows, "run_id long, t long, x array<double>")
    n, s, _, xx, xy, yy = geometry.moments(df)
    x = np.array([r[2] for r in rows[:40]])
    assert n == 40 and np.allclose(s, x.sum(0)) and np.allclose(xx, x.T @ x) and xy is xx and yy is xx
    n, a, b, xx, xy, yy = geometry.moments(counts.lag_pairs(df, 2, columns=("x",)), "x", "next_x")
    assert n == 38 and np.allclose(xy, x[:-2].T @ x[2:]) and np.allclose(yy, x[2:].T @ x[2:])
    assert geometry.moments(df.limit(0))[0] == 0
    one = geometry.Tica(3, 1).fit(df.where("run_id = 0 and t = 0"))
    assert one.transform(df.where("t = 0 and run_id = 0")).first().cv == [0.0]
    two = spark.createDataFrame([(0, 0, [0.0] * 6)], "run_id long, t long, xyz array<double>")
    assert geometry.contacts(two).first().x == []


def test_percentiles_beside_infinity(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "x double")
    assert stats.percentiles(df, "x", [0.5]) == [2.0]


def test_batches_are_worked_on_in_pieces_by_few_workers(spark):
    """What a Python worker makes of a batch doesn't grow with the batch, and the ruler reads frames by one worker a task."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from lagfold.operators import sums
    from lagfold.plans import benchmark

    rows = spark.range(0, 5000, 1, 1)
    got = sums.with_column(rows, "n", T.LongType(), lambda b: pa.array([b.num_rows] * b.num_rows, pa.int64()))
    assert got.count() == 5000 and got.agg(F.max("n")).first()[0] <= sums.ROWS
    xyz = F.array(*[F.rand(k) + F.col("id") * 0.001 * k for k in range(21)])
    frames = rows.where("id < 60").select(F.lit(0).cast("long").alias("run_id"), F.col("id").alias("t"), xyz.alias("xyz")).localCheckpoint()
    ruler = benchmark.Ruler(frames, 1, 3)
    back, _ = benchmark.pca(frames, 3)
    states = ruler.states(back)
    assert states._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    old = geometry.assign(ruler.modes.transform(ruler._features(back)).select("run_id", "t", "cv"), ruler.centres)
    assert sorted((r.t, r.state) for r in states.collect()) == sorted((r.t, r.state) for r in old.collect())
