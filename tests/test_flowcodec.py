"""The flow codec end to end, on tables and on the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfold import cli
from lagfold.operators import frames as fr, geometry
from lagfold.plans import flowcodec
from lagfold.sources import artifact
from tests.test_operators import wells


@pytest.fixture(scope="module")
def moving(spark):
    x = [wells(700, 6, k) for k in (1, 2)]
    return spark.createDataFrame([(r, t, [float(v) for v in f.ravel()]) for r, fs in enumerate(x) for t, f in enumerate(fs)], "run_id long, t long, xyz array<double>").cache()


def test_flow_codec_round_trip(spark, moving, tmp_path):
    art, report = flowcodec.fit_encode(moving, lag=5, dim=2, states=12, keep=0.1, n_bits=8, steps=25, hidden=16, layers=4, flow_decoder=True)
    folder = f"file://{tmp_path}/flow"
    artifact.save(spark, art, folder)
    got = artifact.load(spark, folder)
    kept = flowcodec.decode(got).collect()
    assert len(kept) == report["n_keep"] == 140 and report["cv_error"] < 0.05 and sum(r.weight for r in kept) == pytest.approx(1)
    ref = np.array(got.config["reference"]).reshape(-1, 3)
    aligned = {(r.run_id, r.t): np.array(r.aligned) for r in geometry.kabsch(moving, ref).select("run_id", "t", "aligned").collect()}
    rmsd = lambda rows: np.sqrt(np.mean([((np.array(r.xyz) - aligned[r.run_id, r.t]) ** 2).sum() / 6 for r in rows]))
    full = rmsd(flowcodec.decode(got, full_atom=True).collect())
    assert full < 0.05 and full == pytest.approx(report["fullatom_rmsd"], abs=1e-6)
    smooth = rmsd(flowcodec.decode(got, full_atom=True, smooth=True).collect())
    assert smooth > 3 * full  # a mode isn't the frame itself
    assert np.isfinite(report["timescales"][0]) and report["coded_bytes"] > 0 and report["neighbour_gap"][1] >= 0.9 * report["neighbour_gap"][0]
    # weights carry averages over the kept frames back to those of all frames
    first = F.col("cv")[0]
    mean = flowcodec.ensemble_average(flowcodec.decode(got), F.pow(first, 2))
    cv, _ = flowcodec.modes(moving, ref, "cartesian", 5, 2)
    true, plain = cv.agg(F.avg(F.pow(first, 2))).first()[0], flowcodec.decode(got).agg(F.avg(F.pow(first, 2))).first()[0]
    assert abs(mean - true) < abs(plain - true)


def test_command_line_with_stride(spark, moving, tmp_path, capsys):
    src = f"file://{tmp_path}/frames"
    moving.write.parquet(src)
    shape = ["--stride", "10", "--cv-dim", "2", "--nstates", "6", "--lag-ns", "1", "--n-bits", "8"]
    cli.main(["compress", src, "-o", f"file://{tmp_path}/plain", "--classical", *shape])
    cli.main(["decompress", f"file://{tmp_path}/plain", "-o", f"file://{tmp_path}/back"])
    back = spark.read.parquet(f"file://{tmp_path}/back")
    assert back.count() == 140 and sorted({r.t for r in back.select("t").collect()}) == list(range(70))
    cli.main(["compress", src, "-o", f"file://{tmp_path}/art", "--steps", "10", "--keep-frac", "0.2", "--features", "contacts", *shape])
    cli.main(["decompress", f"file://{tmp_path}/art", "-o", f"file://{tmp_path}/full", "--full-atom"])
    cli.main(["decompress", f"file://{tmp_path}/art", "-o", f"file://{tmp_path}/cv"])
    full = spark.read.parquet(f"file://{tmp_path}/full")
    assert full.count() == 28 and len(full.first().xyz) == 18 and "cv" in spark.read.parquet(f"file://{tmp_path}/cv").columns
    cli.main(["bound", f"file://{tmp_path}/art", f"file://{tmp_path}/plain"])
    cli.main(["analyze", f"file://{tmp_path}/art"])
    out = capsys.readouterr().out
    assert "fullatom_rmsd" in out and "ensemble:" in out and "timescales" in out


def test_one_frame_and_no_pairs(spark):
    one = spark.createDataFrame([(0, 0, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0])], "run_id long, t long, xyz array<double>")
    from lagfold.plans import codec

    art = codec.fit_encode(one, lag=1, dim=1, states=2)
    assert [r.t for r in codec.decode(art).collect()] == [0]
    with pytest.raises(ValueError):
        flowcodec.fit_encode(one)
    assert fr.stride(one, 10).count() == 1


def test_soft_modes_and_rates(spark, moving):
    art, report = flowcodec.fit_encode(moving, lag=5, dim=2, states=8, keep=0.05, steps=12, hidden=8, layers=2, cv="soft", entropy="temporal", n_bits=8)
    expects = flowcodec.predictor_of(art)
    assert expects.kind == "dilated" and len(expects.start()[1]) == 2
    with pytest.raises(ValueError):
        flowcodec.decoder_of(art)
    assert art.config["cv"] == "soft" and report["rate_conditional"] < report["rate_static"] and report["fullatom_rmsd"] < 0.05


class Stopped(Exception):
    pass


def test_a_stopped_stream_goes_on(spark, moving, tmp_path, monkeypatch):
    from lagfold.streaming import compress as streaming

    for k in range(4):
        moving.where(f"t >= {175 * k} and t < {175 * k + 175}").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    source = lambda: spark.readStream.schema(moving.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    ref = geometry.reference_frame(moving)
    args = dict(lag=5, dim=2, states=8, keep=0.05, steps=5, hidden=8, layers=2, n_bits=8)
    batches, seen = streaming._batches, []

    def stopping(frames, folder, name, work):
        def once(b):
            if name == "cvs":
                seen.append(1)
                if len(seen) == 3:
                    raise Stopped
            return work(b)

        return batches(frames, folder, name, once)

    monkeypatch.setattr(streaming, "_batches", stopping)
    with pytest.raises(Exception, match="Stopped"):
        streaming.compress(spark, source, ref, f"file://{tmp_path}/work", **args)
    art, report = streaming.compress(spark, source, ref, f"file://{tmp_path}/work", **args)
    assert len(seen) == 5  # two batches before the stop, the stopped one again, and the last
    plain, model = flowcodec.modes(moving, ref, "cartesian", 5, 2)
    cvs = spark.read.parquet(f"file://{tmp_path}/work/cvs")
    both = plain.join(cvs.select("run_id", "t", F.col("cv").alias("own")), ["run_id", "t"])
    assert both.count() == 1400 and both.agg(F.max(F.array_max(F.zip_with("cv", "own", lambda a, b: F.abs(F.abs(a) - F.abs(b)))))).first()[0] < 1e-6
    assert report["n_keep"] == 70 and report["fullatom_rmsd"] < 0.05 and art.tables["dtraj"].count() == 1400


def test_ladders_and_round_trip_rows(spark, moving):
    from lagfold.plans import benchmark

    ruler = benchmark.Ruler(moving, 5, 8)
    rows = benchmark.ladders(moving, ruler, {"xtc": (100, 2), "pca": (6,), "other": (1,)})
    assert [r["available"] for r in rows] == [True, True, True, False] and rows[0]["bits_per_frame"] > rows[1]["bits_per_frame"] and rows[0]["error"] < 10
    art, _ = flowcodec.fit_encode(moving, lag=5, dim=2, states=8, keep=0.1, steps=5, hidden=8, layers=2, n_bits=8)
    both = benchmark.codec_rows(moving, ruler, art, 5)
    assert [r["method"] for r in both] == ["codec, stored model", "codec, round trip"] and all(np.isfinite(r["error"]) for r in both)
    shown = benchmark.text(rows).split("\n")
    assert len(shown) == 5 and shown[-1].split()[:2] == ["other", "False"] and "-" in shown[-1]
    assert geometry.rmsd(np.eye(3), np.eye(3) + 5) < 1e-7
