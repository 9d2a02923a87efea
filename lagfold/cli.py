"""Command line: ``python -m lagfold.cli {compress,decompress,analyze,bound,inspect,benchmark} ...``

Frames are Parquet tables ``(run_id, t, xyz)`` or DCD files with a PDB topology.
"""

from __future__ import annotations

import argparse
import sys

import numpy as np


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lagfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load_frames(spark, args):
    from lagfold.operators.frames import heavy
    from lagfold.sources import trajectory

    if args.frames.endswith(".dcd") or ".dcd," in args.frames:
        atoms = [r.atom_index for r in heavy(trajectory.read_pdb(spark, args.top)).select("atom_index").orderBy("atom_index").collect()] if args.top else None
        return trajectory.read_dcd(spark, args.frames.split(","), args.stride, atoms)
    from lagfold.operators.frames import stride

    return stride(spark.read.parquet(args.frames), args.stride)


def lag_frames(lag_ns: float, stride: int, dt_ps: float) -> int:
    return max(1, round(lag_ns / (stride * dt_ps / 1000)))


def compress(args) -> None:
    from lagfold.plans import codec, flowcodec
    from lagfold.shipping import ship
    from lagfold.sources import artifact

    spark = session()
    ship(spark)
    frames, lag = load_frames(spark, args), lag_frames(args.lag_ns, args.stride, args.dt_ps)
    if args.streaming:
        art, report = streamed(spark, args, lag)
    elif args.classical:
        art, report = codec.fit_encode(frames, lag, args.cv_dim, args.nstates, args.n_bits, args.seed), None
    else:
        art, report = flowcodec.fit_encode(frames, lag, args.cv_dim, args.nstates, args.keep_frac, args.lat_bits, args.n_bits, args.features, args.flow, args.steps, seed=args.seed, flow_decoder=args.flow_decoder, cv=args.cv, entropy=args.entropy, predictor=args.predictor)
    art.config |= {"stride": args.stride, "dt_ps": args.dt_ps}
    artifact.save(spark, art, args.out)
    for k, v in (report or codec.report(artifact.load(spark, args.out))).items():
        print(f"{k}: {v}")


def streamed(spark, args, lag: int):
    """Frames from a folder of Parquet files that is read as a stream, pass by pass; the passes' state lies beside the artifact."""
    from lagfold.operators.frames import stride
    from lagfold.operators.geometry import reference_frame
    from lagfold.streaming import compress as streaming

    table = stride(spark.read.parquet(args.frames), args.stride)
    schema = spark.read.parquet(args.frames).schema
    source = lambda: stride(spark.readStream.schema(schema).option("maxFilesPerTrigger", args.chunk_files).parquet(args.frames), args.stride)
    return streaming.compress(
        spark, source, reference_frame(table), f"{args.out}-passes", lag, args.cv_dim, states=args.nstates, keep=args.keep_frac, lat_bits=args.lat_bits, n_bits=args.n_bits, flow=args.flow, steps=args.steps, seed=args.seed, entropy=args.entropy, predictor=args.predictor
    )


def decompress(args) -> None:
    from lagfold.plans import codec, flowcodec
    from lagfold.shipping import ship
    from lagfold.sources import artifact

    spark = session()
    ship(spark)
    art = artifact.load(spark, args.artifact)
    frames = flowcodec.decode(art, args.full_atom or args.smooth, args.smooth) if "latents" in art.tables else codec.decode(art)
    frames.write.mode("overwrite").parquet(args.out)


def analyze(args) -> None:
    from lagfold.functions import kinetics
    from lagfold.operators import analysis, counts, posterior
    from lagfold.sources import artifact

    spark = session()
    art = artifact.load(spark, args.artifact, only=("dtraj", "counts"))
    n, lag = art.config["n_states"], args.lag or art.config["lag"]
    runs = art.tables["dtraj"]
    frames = runs.count()
    dt = art.config["dt_ps"] * art.config["stride"] / 1000  # ns
    show = lambda x: " ".join("-" if np.isnan(v) else f"{v:.4g}" for v in x)
    c = kinetics.dense_counts(counts.transition_counts(runs, lag).collect(), n)
    try:
        print(f"lag {lag}: timescales " + show(kinetics.implied_timescales(kinetics.reversible_mle(c)[0], lag, args.k)))
    except ValueError as e:
        print(f"lag {lag}: {e}")
    if args.lags or args.lag_scan:
        lags = sorted({int(x) for x in args.lags.split(",")}) if args.lags else analysis.usual_lags(lag)
        for tau, its in analysis.lag_scan(runs, lags, args.k, n):
            print(f"scan, lag {tau}: timescales {show(its)}" + (" (no estimate)" if np.isnan(its).all() else ""))
    samples = posterior.timescales(spark, c, lag, args.k, args.n_samples) if args.bayes or args.resolution else None
    if args.bayes:
        each = kinetics.kinetic_resolution(samples, frames)
        print(f"posterior: means {show([r.timescale for r in each])}; deviations {show([r.std for r in each])}")
    if args.bootstrap:
        got = analysis.bootstrap_timescales(runs, lag, args.k, n, args.bootstrap)
        print("bootstrap: no replicate has an estimate" if got is None else "bootstrap: means {}; low {}; high {}".format(*map(show, got)))
    if args.cktest:
        print("staying probabilities, largest difference by factor: " + " ".join(f"{f}: {v:.4g}" for f, v in analysis.ck_test(runs, lag, n, args.cktest).items()))
    if args.resolution:
        for r in kinetics.kinetic_resolution(samples, frames, dt):
            print(f"timescale {r.timescale:.4g} ns [{r.low:.4g}, {r.high:.4g}], {r.events:.3g} events: " + ("resolved" if r.resolved else "not resolved"))
    if args.mfpt:
        act = kinetics.largest_connected_set(c)
        t, pi = kinetics.transition_matrix(c[np.ix_(act, act)])
        _, pops, m = kinetics.metastable_mfpt(t, pi, args.mfpt, dt * lag)
        print("populations " + show(pops))
        print("passage times in ns\n" + "\n".join(map(show, m)))


def inspect(args) -> None:
    from lagfold.operators.inspect import inspect as look
    from lagfold.sources import trajectory

    spark = session()
    frames = trajectory.read_dcd(spark, args.frames.split(",")) if ".dcd" in args.frames else spark.read.parquet(args.frames)
    for k, v in look(trajectory.read_pdb(spark, args.top), frames, args.dt_ps).items():
        print(f"{k}: {v}")


def benchmark(args) -> None:
    from lagfold.plans import benchmark as bench

    spark = session()
    rows = bench.run_benchmark(load_frames(spark, args), args.methods.split(","), lag_frames(args.lag_ns, args.stride, args.dt_ps), args.nstates, args.cv_dim, args.dt_ps * args.stride / 1000, args.seed)
    print(bench.text(rows))
    if args.ladders:
        frames = load_frames(spark, args)
        lag = lag_frames(args.lag_ns, args.stride, args.dt_ps)
        print(bench.text(bench.ladders(frames, bench.Ruler(frames, lag, args.nstates, args.dt_ps * args.stride / 1000, seed=args.seed))))
    if args.csv:
        bench.write_csv(spark, rows, args.csv)


def bound(args) -> None:
    from lagfold.functions import kinetics
    from lagfold.sources import artifact, trajectory

    spark = session()
    art = artifact.load(spark, args.artifact, only=("counts", "dtraj"))
    q = art.counts()
    p = trajectory.read_matrix(args.reference) if args.reference.endswith((".npy", ".npz")) else artifact.load(spark, args.reference, only=("counts",)).counts()
    if len(p) != len(q):
        print(f"warning: {len(p)} and {len(q)} states; the first {min(len(p), len(q))} are compared")
    n = min(len(p), len(q))
    p, q = p[:n, :n], q[:n, :n]
    act = kinetics.largest_connected_set(p + q)
    length = args.length or art.tables["dtraj"].count()
    f = kinetics.fidelity(*(kinetics.transition_matrix(x[np.ix_(act, act)])[0] for x in (p, q)), args.lag or art.config["lag"], length)
    for k in ("ensemble", "transition", "two_slice", "path", "pair_bound", "ensemble_bound", "support_ok"):
        print(f"{k}: {getattr(f, k)}")
    if not f.support_ok:
        print("warning: transitions of the reference are missing; the divergence is a lower bound")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lagfold")
    sub = top.add_subparsers(required=True)
    c = sub.add_parser("compress")
    c.add_argument("frames")
    c.add_argument("-o", "--out", required=True)
    c.add_argument("--top")
    for name, kind, default in (("stride", int, 10), ("cv-dim", int, 6), ("nstates", int, 200), ("lag-ns", float, 5.0), ("dt-ps", float, 100.0), ("n-bits", int, 4), ("seed", int, 0), ("keep-frac", float, 0.1), ("lat-bits", int, 14), ("steps", int, 200)):
        c.add_argument(f"--{name}", type=kind, default=default)
    c.add_argument("--features", choices=("cartesian", "contacts"), default="cartesian")
    c.add_argument("--flow", choices=("coupling", "spline"), default="coupling")
    c.add_argument("--cv", choices=("tica", "soft"), default="tica")
    c.add_argument("--entropy", choices=("gaussian", "temporal", "predictive"), default="gaussian")
    c.add_argument("--predictor", choices=("recurrent", "dilated"), default="recurrent")
    c.add_argument("--flow-decoder", action="store_true", help="also a flow of what the linear decoder leaves")
    c.add_argument("--streaming", action="store_true", help="read the frames' files as a stream; passes can be resumed")
    c.add_argument("--chunk-files", type=int, default=100, help="files of a micro-batch")
    c.add_argument("--classical", action="store_true", help="every frame: coded states and residuals, no flow")
    c.set_defaults(func=compress)
    d = sub.add_parser("decompress")
    d.add_argument("artifact")
    d.add_argument("-o", "--out", required=True)
    d.add_argument("--full-atom", action="store_true", help="coordinates of the kept frames, with their residuals")
    d.add_argument("--smooth", action="store_true", help="coordinates by the flow decoder's modes")
    d.set_defaults(func=decompress)
    a = sub.add_parser("analyze")
    a.add_argument("artifact")
    for name, kind, default in (("lag", int, None), ("lags", str, None), ("k", int, 4), ("n-samples", int, 100), ("mfpt", int, None)):
        a.add_argument(f"--{name}", type=kind, default=default)
    for name, kind in (("bootstrap", int), ("cktest", int)):
        a.add_argument(f"--{name}", type=kind, default=0)
    for name in ("resolution", "bayes", "lag-scan"):
        a.add_argument(f"--{name}", action="store_true")
    a.set_defaults(func=analyze)
    b = sub.add_parser("bound")
    b.add_argument("artifact")
    b.add_argument("reference")
    b.add_argument("--lag", type=int)
    b.add_argument("-L", "--length", type=int)
    b.set_defaults(func=bound)
    i = sub.add_parser("inspect")
    i.add_argument("top")
    i.add_argument("frames")
    i.add_argument("--dt-ps", type=float)
    i.set_defaults(func=inspect)
    m = sub.add_parser("benchmark")
    m.add_argument("frames")
    m.add_argument("--top")
    m.add_argument("--methods", default="stored,shuffle,quantize")
    m.add_argument("--csv")
    m.add_argument("--ladders", action="store_true", help="also every setting of the built-in rate models, on a fixed ruler")
    for name, kind, default in (("stride", int, 10), ("cv-dim", int, 2), ("nstates", int, 50), ("lag-ns", float, 10.0), ("dt-ps", float, 100.0), ("seed", int, 0)):
        m.add_argument(f"--{name}", type=kind, default=default)
    m.set_defaults(func=benchmark)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.func(args)


if __name__ == "__main__":
    main(sys.argv[1:])
