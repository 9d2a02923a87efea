import numpy as np
from pyspark.sql import functions as F

from lagfold.operators import frames
from lagfold.sources import artifact, trajectory


def test_dcd(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(n, 5, 3)) * 10 for n in (103, 7)]
    paths = [str(tmp_path / f"{k}.dcd") for k in range(2)]
    for p, f in zip(paths, x):
        trajectory.write_dcd(p, f)
    df = trajectory.read_dcd(spark, paths, stride=10, atoms=[1, 4], chunk=25)
    rows = sorted(df.collect())
    assert [(r.run_id, r.t) for r in rows] == [(0, t) for t in range(11)] + [(1, 0)]
    assert np.allclose(rows[3].xyz, x[0][30][[1, 4]].ravel() / 10, atol=1e-5) and np.allclose(rows[-1].xyz, x[1][0][[1, 4]].ravel() / 10, atol=1e-5)
    assert trajectory.read_dcd(spark, paths).count() == 110


def test_pdb(spark, tmp_path):
    line = "{:6s}{:5d} {:^4s} {:3s} {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00          {:>2s}\n"
    p = tmp_path / "t.pdb"
    p.write_text("TITLE x\n" + line.format("ATOM", 1, "CA", "ALA", "A", 1, 1, 2, 3, "C") + line.format("ATOM", 2, "H", "ALA", "A", 1, 1, 2, 4, "H") + line.format("HETATM", 3, "O", "HOH", "B", 2, -1.5, 2, 4, "O") + line.format("HETATM", 4, "X", "LIG", "B", 3, 0, 0, 0, "") + "END\n")
    t = trajectory.read_pdb(spark, str(p))
    assert [tuple(r) for r in t.select("atom_index", "resname", "element", "x").collect()] == [(0, "ALA", "C", 1.0), (1, "ALA", "H", 1.0), (2, "HOH", "O", -1.5), (3, "LIG", None, 0.0)]
    assert [r.atom_index for r in frames.heavy(t).collect()] == [0, 2] and frames.heavy(t, ["ala"]).count() == 1
    assert {r.c: r.n for r in t.groupBy(frames.classify(F.col("resname")).alias("c")).agg(F.count("*").alias("n")).collect()} == {"protein": 2, "water": 1, "other": 1}


def test_matrices_and_artifacts(spark, tmp_path):
    c = np.arange(9.0).reshape(3, 3)
    np.save(tmp_path / "c.npy", c)
    np.savez(tmp_path / "c.npz", other=c * 2, counts=c)
    np.savez(tmp_path / "o.npz", zzz=c * 3)
    assert (trajectory.read_matrix(str(tmp_path / "c.npy")) == c).all() and (trajectory.read_matrix(str(tmp_path / "c.npz")) == c).all() and (trajectory.read_matrix(str(tmp_path / "o.npz")) == 3 * c).all()
    rows = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(3) for j in range(3)], "i int, j int, c double")
    small, large = (spark.createDataFrame([(0, [1, -v])], "pos long, q array<int>") for v in (32000, 32001))
    for k, (r, kind) in enumerate(((small, "smallint"), (large, "int"))):
        folder = f"file://{tmp_path}/a{k}"
        artifact.save(spark, artifact.Artifact({"n_states": 3, "lag": 7}, {"counts": rows, "residual": r}), folder)
        got = artifact.load(spark, folder)
        assert dict(got.tables["residual"].dtypes)["q"] == f"array<{kind}>" and (got.counts() == c).all() and got.config["lag"] == 7 and got.config["dt_ps"] == 100.0
        assert list(artifact.load(spark, folder, only=("counts",)).tables) == ["counts"]
        assert artifact.is_artifact(spark, folder) and not artifact.is_artifact(spark, f"{folder}/none")
