"""Analysis, predictive coding, the benchmark, inspection and range-ranked plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfold.functions import kinetics as K
from lagfold.operators import analysis, coding, frames, inspect, stats
from lagfold.plans import benchmark
from lagfold.sources import trajectory
from tests.test_kinetics import chain, two_state
from tests.test_operators import runs, wells


def coordinates(spark, xs):
    return spark.createDataFrame([(r, t, [float(v) for v in f.ravel()]) for r, x in enumerate(xs) for t, f in enumerate(x)], "run_id long, t long, xyz array<double>")


def test_lag_scan_leaves_long_lags_out(spark):
    df = runs(spark, chain(two_state(0.05), 4000, 1), chain(two_state(0.05), 300, 2))
    got = dict(analysis.lag_scan(df, [1, 5, 149, 150, 400], 2, 2))
    assert sorted(got) == [1, 5, 149] and got[1][0] == pytest.approx(9.49, rel=0.2) and np.isnan(got[1][1])
    assert analysis.usual_lags(8) == [2, 4, 8, 16, 32]


def test_bootstrap_holds_the_timescale(spark):
    many = runs(spark, *[chain(two_state(0.02), 1500, k) for k in range(8)])
    one = runs(spark, chain(two_state(0.02), 12_000, 3))
    for df in (many, one):
        mean, low, high = analysis.bootstrap_timescales(df, 1, 1, 2, replicates=40)
        assert low[0] < mean[0] < high[0] and low[0] < 24.5 < high[0] * 1.2 and high[0] - low[0] > 1
    assert analysis.bootstrap_timescales(runs(spark, [0]), 5, 1, 2) is None
    dev = analysis.ck_test(one, 1, 2)
    assert dev[1] < 1e-12 and max(dev.values()) < 0.1


def test_predictive_codec_decodes_from_its_stream(spark):
    rng = np.random.default_rng(0)
    xs = []
    for n in (400, 77):
        x = [rng.normal(size=2)]
        for _ in range(n - 1):
            x.append(x[-1] @ np.array([[0.95, 0.1], [0.0, 0.9]]) + 0.2 * rng.normal(size=2))
        xs.append(np.array(x))
    df = spark.createDataFrame([(r, t, v.tolist()) for r, x in enumerate(xs) for t, v in enumerate(x)], "run_id long, t long, z array<double>")
    model = coding.LinearPredictor.fit(df)
    assert np.allclose(model.a, [[0.95, 0.1], [0, 0.9]], atol=0.08) and np.allclose(np.exp(model.log_s), 0.2, atol=0.03)
    error, size = [], []
    for bits in (5, 8, 11):
        streams = coding.encode_predictive(df, model, bits)
        back = {(r.run_id, r.t): np.array(r.z) for r in coding.decode_predictive(streams, model, bits).collect()}
        error.append(max(np.abs(back[r, t] - v).max() for r, x in enumerate(xs) for t, v in enumerate(x)))
        size.append(streams.agg(F.sum(F.length("stream"))).first()[0])
        assert len(back) == 477
    assert error[0] > error[1] > error[2] and error[2] < 0.02 and size[0] < size[1] < size[2]
    z = df.select("run_id", "t", F.col("z")[0].alias("z"))
    levels = coding.predictive_levels(z, 0.9, 0.5, 12)
    both = levels.withColumnRenamed("back", "own").join(coding.predictive_back(levels, 0.9, 0.5, 12), ["run_id", "t"])
    assert both.where(F.abs(F.col("own") - F.col("back")) > 1e-12).count() == 0


@pytest.fixture(scope="module")
def moving(spark):
    return coordinates(spark, [wells(1500, 8, 1), wells(500, 8, 2)]).cache()


def test_benchmark_contrast(spark, moving, tmp_path):
    rows = {r["method"]: r for r in benchmark.run_benchmark(moving, ["stored", "shuffle", "quantize", "other"], lag=5, states=12)}
    assert rows["stored"]["transition"] < 1e-9 and rows["shuffle"]["transition"] > 1e-2 and rows["shuffle"]["ensemble"] < 0.2
    assert not rows["other"]["available"] and rows["quantize"]["available"]
    benchmark.write_csv(spark, list(rows.values()), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 4


def test_rates_and_ruler(spark, moving):
    few, small = benchmark.pca(moving, 2)
    more, large = benchmark.pca(moving, 12)
    ref = np.array(moving.orderBy("run_id", "t").first().xyz).reshape(-1, 3)
    from lagfold.operators import geometry

    own = geometry.kabsch(moving, ref).select("run_id", "t", "aligned")
    d2 = F.aggregate(F.zip_with("aligned", "xyz", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    error = [own.join(x, ["run_id", "t"]).agg(F.avg(d2)).first()[0] for x in (few, more)]
    assert error[1] < error[0] and small < large and few.count() == 2000
    fine, many = benchmark.xtc(moving, 100.0)
    coarse, less = benchmark.xtc(moving, 2.0)
    assert less < many and fine.join(moving.withColumnRenamed("xyz", "o"), ["run_id", "t"]).where(F.exists(F.zip_with("xyz", "o", lambda a, b: F.abs(a - b) > 0.0051), lambda x: x)).count() == 0
    ruler = benchmark.Ruler(moving, 5, 10, dt=0.2)
    t1, off = ruler.score(moving)
    assert off < 1e-6 and t1 > 1 and ruler.score(benchmark.shuffle(moving))[1] > 20


def test_inspect(spark):
    rows = [(0, "N", "ALA", "A", 1, "N"), (1, "CA", "ALA", "A", 1, "C"), (2, "H", "ALA", "A", 1, "H"), (3, "O", "HOH", "B", 2, "O"), (4, "X1", "LIG", "B", 3, "C"), (5, "NA", "NA", "B", 4, "Na")]
    top = spark.createDataFrame(rows, "atom_index int, name string, resname string, chain string, res_id int, element string")
    x = np.zeros((3, 6, 3))
    x[:, :, 0] = [0.0, 0.15, 0.2, 0.3, 0.45, 0.6]
    got = inspect.inspect(top, coordinates(spark, [x]), 100.0)
    assert (got["atoms"], got["residues"], got["chains"], got["frames"]) == (6, 4, 2, 3) and got["residue classes"] == {"protein": 1, "water": 1, "ion": 1, "other": 1}
    assert got["selections"] == {"protein": 3, "protein and CA": 1, "backbone": 2, "water": 1, "not water": 5, "resname LIG": 1}
    assert got["nearest neighbour"] == pytest.approx(0.15) and got["units"] == "nm" and got["stored atoms"] == 3 and got["raw bytes"] == 108 and got["other residues"] == {"LIG": 1}


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.exponential(size=3001), 2)
    df = spark.createDataFrame([(int(k), float(x)) for k, x in zip(rng.permutation(3001), v)] + [(9999, None)], "k long, v double")
    shares = [0, 0.005, 0.5, 0.77, 1]
    assert stats.percentiles(df, "v", shares) == pytest.approx(np.percentile(v, [100 * p for p in shares]).tolist())
    assert stats.percentiles(df.limit(0), "v", [0.5]) == [None]
    rows = frames.numbered_whole(df, "k").orderBy("k").collect()
    assert [r.t for r in rows] == list(range(3002)) and {r.run_id for r in rows} == {0}


def test_runs_of_chunk_files_and_raw_frames(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(25, 4, 3)) * 10
    for k, part in enumerate((x[:7], x[7:18], x[18:])):
        trajectory.write_dcd(str(tmp_path / f"c{k}.dcd"), part)
        (tmp_path / f"c{k}.raw").write_bytes(part.astype("<f4").tobytes())
    whole = [str(tmp_path / f"c{k}.dcd") for k in range(3)]
    rows = sorted(trajectory.read_dcd(spark, [whole], stride=3, chunk=5).collect())
    assert [(r.run_id, r.t) for r in rows] == [(0, t) for t in range(9)] and np.allclose([r.xyz for r in rows], x[::3].reshape(9, -1) / 10, atol=1e-5)
    assert {r.run_id for r in trajectory.read_dcd(spark, [str(tmp_path / "c*.dcd")]).collect()} == {0, 1, 2}
    raw = sorted(trajectory.read_dcd(spark, [[f"file://{tmp_path}/c{k}.raw" for k in range(3)]], raw_atoms=4).collect())
    assert len(raw) == 25 and np.allclose([r.xyz for r in raw], x.reshape(25, -1), atol=1e-5)


def test_estimates_agree_with_detailed_balance():
    c = np.array([[80.0, 20, 0], [18, 60, 22], [0, 25, 75]])
    for kind in K.ESTIMATES:
        t, _ = K.estimate(c, (kind,))
        pi = K.stationary_distribution(t)
        assert np.allclose(pi[:, None] * t, (pi[:, None] * t).T, atol=1e-9)
