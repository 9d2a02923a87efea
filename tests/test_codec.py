import numpy as np
from pyspark.sql import functions as F

from lagfold import cli
from lagfold.operators import counts
from lagfold.plans import codec
from lagfold.sources import artifact
from tests.test_kinetics import chain, two_state
from tests.test_operators import runs, wells


def frames(spark, n=300):
    x = [wells(n, 6, 1) for _ in range(2)]
    return spark.createDataFrame([(r, t, [float(v) for v in f.ravel()]) for r, fs in enumerate(x) for t, f in enumerate(fs)], "run_id long, t long, xyz array<double>")


def test_round_trip_through_files(spark, tmp_path, capsys):
    df = frames(spark)
    folder = f"file://{tmp_path}/art"
    art = codec.fit_encode(df, lag=5, dim=2, states=8, n_bits=8)
    artifact.save(spark, art, folder)
    got = artifact.load(spark, folder)
    back = codec.decode(got)
    rmsd = codec.geometry.kabsch(df, np.array(got.config["reference"]).reshape(-1, 3)).select("run_id", "t", "aligned").join(back, ["run_id", "t"])
    d2 = F.aggregate(F.zip_with("aligned", "xyz", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b) / 6
    assert rmsd.count() == 600 and rmsd.agg(F.sqrt(F.avg(d2))).first()[0] < 0.05
    assert back.select("run_id", "t", "state").exceptAll(got.tables["dtraj"].select("run_id", "t", "state")).count() == 0
    r = codec.report(got)
    assert r["frames"] == 600 and r["ratio"] > 1 and r["timescales"][0] > 5
    cli.main(["analyze", folder, "--lags", "1,5", "--mfpt", "2", "--resolution", "--n-samples", "5", "--bayes", "--bootstrap", "5", "--cktest", "2"])
    cli.main(["bound", folder, folder])
    out = capsys.readouterr().out
    assert "transition: 0.0" in out and "scan, lag 5: timescales" in out and "populations" in out and "bootstrap: means" in out and "posterior: means" in out and "staying" in out


def test_contrast_sees_a_shuffle(spark):
    s = chain(two_state(0.02), 4000, 2)
    ref, same = runs(spark, s), runs(spark, s)
    shuffled = runs(spark, np.random.default_rng(0).permutation(s))
    rows = {r.method: r for r in codec.contrast(ref, {"stored": same, "shuffle": shuffled}, 2).collect()}
    assert rows["stored"].transition < 1e-9 and rows["shuffle"].transition > 1e-2 and rows["shuffle"].ensemble < 0.2
    assert counts.transition_counts(ref).count() == 4


def test_lag_rule():
    assert cli.lag_frames(5, 10, 100) == 5 and cli.lag_frames(0.1, 10, 100) == 1
