"""The flow codec: slow modes, a flow over them, kept frames by coverage, coded latents, and a full-atom stage for the kept frames.

Passes over the frames: alignment and moments, slow modes (written once), cells, flow steps over packed
blocks, selection, and one read of the kept frames' coordinates.  The driver holds the kept
frames' latents (kept x modes numbers), models and states x states counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.functions import coders, kinetics
from lagfold.operators import counts, geometry, selection, stats
from lagfold.operators.flow import Flow
from lagfold.operators.sums import matrix, rows_of, vector_sum, with_column
from lagfold.operators.tables import dropped, written
from lagfold.plans.codec import draws
from lagfold.shipping import ship
from lagfold.sources.artifact import Artifact

#: Kept frames that are coded together.
BLOCK = 512
_ARRAY = T.ArrayType(T.DoubleType())


def modes(frames: DataFrame, ref: np.ndarray, features: str, lag: int, dim: int, feature_atoms: int = 64, separation: int = 2) -> tuple[DataFrame, geometry.Tica]:
    """``(run_id, t, cv)`` and the model that made it, from aligned coordinates or from contacts."""
    if features == "contacts":
        raw = geometry.contacts(frames.select("run_id", "t", "xyz"), feature_atoms, separation).select("run_id", "t", F.col("x").alias("f"))
    elif features == "cartesian":
        raw = geometry.kabsch(frames.select("run_id", "t", "xyz"), ref).select("run_id", "t", F.col("aligned").alias("f"))
    else:
        raise ValueError("features are cartesian or contacts")
    raw = written(raw)
    model = geometry.Tica(lag, dim).fit(raw, "f")
    cv = written(model.transform(raw, "f", "cv").select("run_id", "t", "cv"))
    dropped(raw)
    return cv, model


def levels_of(z: np.ndarray, zmax: float, bits: int) -> np.ndarray:
    n = 1 << bits
    return np.clip(np.floor((np.clip(z, -zmax, zmax) + zmax) / (2 * zmax) * n), 0, n - 1).astype(np.int64)


def values_of(q: np.ndarray, zmax: float, bits: int) -> np.ndarray:
    return (q + 0.5) * (2 * zmax / (1 << bits)) - zmax


def encode_kept(kept: DataFrame, zmax: float, bits: int) -> DataFrame:
    """``(block, n, stream)`` of ``(k, z)``: levels of the latents, range coded under a normal law."""
    cum = coders.gaussian_table(1 << bits, zmax)

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf.sort_values("k")["z"].to_list())
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [len(z)], "stream": [coders.encode_iid(levels_of(z, zmax, bits).ravel().tolist(), cum)]})

    return kept.select("k", "z", F.expr(f"k div {BLOCK}").alias("block")).groupBy("block").applyInPandas(code, "block long, n long, stream binary")


def decode_kept(streams: DataFrame, zmax: float, bits: int, dim: int) -> DataFrame:
    """``(k, z)`` of the coded latents."""
    cum = coders.gaussian_table(1 << bits, zmax)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q = np.array(coders.decode_iid(bytes(r.stream), int(r.n) * dim, cum)).reshape(-1, dim)
                yield pd.DataFrame({"k": r.block * BLOCK + np.arange(len(q)), "z": list(values_of(q, zmax, bits))})

    return streams.mapInPandas(decode, "k long, z array<double>")


def soft_modes(frames: DataFrame, ref: np.ndarray, lag: int, dim: int, steps: int, seed: int) -> DataFrame:
    """``(run_id, t, cv)``: soft states of the aligned coordinates, fitted by the VAMP-2 score (all but the last, as they sum to one)."""
    from lagfold.operators.softstates import SoftModel

    raw = written(geometry.kabsch(frames.select("run_id", "t", "xyz"), ref).select("run_id", "t", F.col("aligned").alias("f")))
    chi = SoftModel.fit(raw, lag, dim + 1, "f", steps=steps, seed=seed).assign(raw, "f", "chi")
    cv = written(chi.select("run_id", "t", F.slice("chi", 1, dim).alias("cv")))
    dropped(raw)
    return cv


def fit_encode(frames: DataFrame | None, lag: int = 10, dim: int = 6, states: int = 200, keep: float = 0.1, lat_bits: int = 14, n_bits: int = 4, features: str = "cartesian", flow: str = "coupling", steps: int = 200, rate: float = 5e-3, share: float = 1.0, seed: int = 0, flow_decoder: bool = False, cv: str = "tica", entropy: str = "gaussian", predictor: str = "recurrent", cvs: DataFrame | None = None, ref: np.ndarray | None = None, fetch=None, model: geometry.Tica | None = None, **shape) -> tuple[Artifact, dict]:
    """(artifact, report) of ``(run_id, t, xyz)``.

    ``cv``: slow modes (``tica``) or soft states (``soft``); ``cvs`` (``run_id, t, cv``) replaces them by others.  ``entropy``:
    ``temporal`` and ``predictive`` also fit a causal predictor of the latents, and report its rate beside the static one.
    ``fetch`` gives the coordinates of kept frames where ``frames`` isn't a table.  ``flow_decoder`` adds a flow of what the linear decoder
    leaves, under the slow modes, whose mode gives a smoother frame.
    """
    spark = (cvs if frames is None else frames).sparkSession
    ship(spark)
    if frames is not None:
        frames = frames.where("xyz is not null")
        ref = geometry.reference_frame(frames) if ref is None else ref
    if cvs is None and cv == "soft":
        cvs = soft_modes(frames, ref, lag, dim, steps, seed)
    elif cvs is None:
        cvs, model = modes(frames, ref, features, lag, dim)
    total = cvs.count()
    if total < 2:
        raise ValueError("at least two frames are needed")
    dim = len(cvs.first().cv)
    cells, centres = geometry.discretise(cvs, min(states, total), seed)
    states = len(centres)
    density = Flow.fit(cvs, "cv", kind=flow, steps=steps, rate=rate, share=share, seed=seed, **({"hidden": 64, "layers": 8} | shape if flow == "coupling" else {"hidden": 32, "layers": 4} | shape))
    latent = written(density.latents(cells, "cv", "z"))

    picks = selection.farthest(latent, max(2, int(keep * total)), seed=seed)
    z = np.array([v for _, _, v in picks])
    weights = selection.cell_shares(latent, z)
    zmax = max(6.0, float(np.abs(z).max()) * 1.02)
    order = sorted(range(len(picks)), key=lambda k: picks[k][:2])  # stored in the order of the frames
    chosen = spark.createDataFrame([(n, *picks[k][:2], float(weights[k])) for n, k in enumerate(order)], "k long, run_id long, t long, weight double")
    kept = written(chosen.join(latent, ["run_id", "t"]).select("k", "run_id", "t", "state", "weight", "cv", "z"))  # kept frames: bounded by what the driver holds
    streams = written(encode_kept(kept, zmax, lat_bits))
    decoded = written(density.restored(decode_kept(streams, zmax, lat_bits, dim), "z", "rec").select("k", "rec"))

    own = fetch(kept) if fetch else frames.join(kept.select("run_id", "t", "k", "state"), ["run_id", "t"]).select("run_id", "t", "xyz", "k", "state")
    coordinates = geometry.kabsch(own, ref)
    whole = written(coordinates.select("k", "run_id", "t", "state", "aligned").join(decoded, "k"))
    n, sc, sx, cc, cx, _ = geometry.moments(whole, "rec", "aligned", only=("xx", "xy"))
    cmean, xmean = sc / n, sx / n
    b = np.linalg.lstsq(cc - n * np.outer(cmean, cmean), cx - n * np.outer(cmean, xmean), rcond=None)[0]
    width = len(xmean)

    def left(batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch.column("aligned")) - ((matrix(batch.column("rec")) - cmean) @ b + xmean)

    def by_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("state"), rows_of(left(batch))], ["state", "r"])

    residuals = whole.select("state", "aligned", "rec").mapInArrow(by_state, "state int, r array<double>")
    mean_rows = residuals.select("state", F.posexplode("r").alias("i", "v")).groupBy("state", "i").agg(F.avg("v").alias("v")).collect()  # states x 3N numbers, of the kept frames' states
    state_mean = np.zeros((states, width))
    for r in mean_rows:
        state_mean[r.state, r.i] = r.v

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        s = np.zeros(3)
        for batch in batches:
            if batch.num_rows:
                x = left(batch) - state_mean[batch.column("state").to_numpy()]
                s += [x.size, x.sum(), (x * x).sum()]
        return s

    m = vector_sum(whole.select("state", "aligned", "rec"), spread)
    step = (max(m[2] / m[0] - (m[1] / m[0]) ** 2, 0.0) ** 0.5 + 1e-12) * 2.0 ** (1 - n_bits) * 3

    def quantise(batch: pa.RecordBatch) -> pa.Array:
        x = left(batch) - state_mean[batch.column("state").to_numpy()]
        q = np.rint(x / step + draws(seed, batch.column("run_id").to_numpy(), batch.column("t").to_numpy(), width)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * width), pa.array(q.ravel()))

    residual = written(with_column(whole, "q", T.ArrayType(T.IntegerType()), quantise).select("k", "q"))
    c = counts.transition_counts(cells, lag)
    rows = lambda x: [(k, v.tolist()) for k, v in enumerate(x)]
    config = {
        "lag": lag, "n_states": states, "n_bits": n_bits, "lat_bits": lat_bits, "seed": seed, "step": step, "width": width, "dim": dim, "zmax": zmax, "n_keep": len(picks), "frames": total, "features": features,
        "cv": "tica" if model else cv if cv == "soft" else "given", "entropy": entropy, "flow": density.config(), "reference": ref.ravel().tolist(), "flow_decoder": None,
    }
    tables = {
        "dtraj": cells.select("run_id", "t", "state"), "counts": c, "latents": streams, "kept": kept.select("k", "run_id", "t", "state", "weight"), "residual": residual,
        "flow": density.table(spark), "centres": spark.createDataFrame(rows(centres), "state int, c array<double>"), "state_mean": spark.createDataFrame(rows(state_mean), "state int, r array<double>"),
        "decoder": spark.createDataFrame([("cmean", cmean.tolist()), ("xmean", xmean.tolist()), *[(f"b{k}", v.tolist()) for k, v in enumerate(b)]], "name string, v array<double>"),
    }
    if model is not None:
        tables["modes"] = spark.createDataFrame([("mean", model.mean.tolist()), *[(f"p{k}", v.tolist()) for k, v in enumerate(model.projection.T)]], "name string, v array<double>")
        config["timescales"] = [None if np.isnan(v) else float(v) for v in model.timescales[:dim]]
    if flow_decoder:
        rest = with_column(whole, "left", _ARRAY, lambda batch: rows_of(left(batch)))
        smooth = Flow.fit(rest, "left", "rec", steps=max(10, steps // 4), rate=rate, seed=seed, hidden=32, layers=4)
        tables["flow_decoder"], config["flow_decoder"] = smooth.table(spark), smooth.config()
    rates = {}
    if entropy != "gaussian":
        from lagfold.operators.predict import Predictor, conditional_nll

        expects = Predictor.fit(latent, "z", "dilated" if entropy == "temporal" else predictor, steps=max(20, steps // 2), seed=seed, hidden=32)
        own, static = conditional_nll(latent, expects)
        bins = np.log2((1 << lat_bits) / (2 * zmax))  # bits of a bin's width
        rates = {"conditional_nll": own, "static_nll": static, "rate_conditional": own / np.log(2) + bins, "rate_static": static / np.log(2) + bins}
        tables["predictor"] = spark.createDataFrame([("theta", expects.theta.tolist()), ("mean", expects.mean.tolist()), ("std", expects.std.tolist())], "name string, v array<double>")
        config["predictor"] = {"kind": expects.kind, "hidden": 32, "dim": dim}
    art = Artifact(config, tables)
    report = described(art, cvs, density, whole, latent) | {k: float(v) for k, v in rates.items()}
    return art, report


def described(art: Artifact, cvs: DataFrame, density: Flow, whole: DataFrame, latent: DataFrame) -> dict:
    """What the encoding costs and keeps: errors, bytes, the ensemble's divergence on the first mode, timescales, clashes."""
    spark, cfg = cvs.sparkSession, art.config
    back = decode(art, full_atom=True).select("k", F.col("xyz").alias("got"))
    atoms = cfg["width"] // 3
    d2 = F.aggregate(F.zip_with("aligned", "got", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    both = written(whole.join(back, "k").select("k", "aligned", "got", d2.alias("d2")))
    cv_error = art.tables["kept"].join(latent.select("run_id", "t", "cv"), ["run_id", "t"]).join(decode(art).select("k", F.col("cv").alias("rec")), "k").agg(F.max(F.array_max(F.zip_with("cv", "rec", lambda a, b: F.abs(a - b))))).first()[0]
    lo, hi = stats.percentiles(cvs.select(F.col("cv")[0].alias("x")), "x", [0.005, 0.995])
    hist = lambda df: stats.histogram(df, F.col("x"), lo, hi, 40)
    drawn = density.samples(spark, 20_000, cfg["seed"]).select(F.col("x")[0].alias("x"))
    kl = stats.histogram_kl(hist(cvs.select(F.col("cv")[0].alias("x"))), hist(drawn)).first()[0] if hi > lo else 0.0
    above = lambda df: df.agg(F.avg((F.col("x") > (lo + hi) / 2).cast("double"))).first()[0]
    gap = abs(above(cvs.select(F.col("cv")[0].alias("x"))) - above(drawn))
    c = art.counts()
    act = kinetics.largest_connected_set(c)
    t, kind = kinetics.estimate(c[np.ix_(act, act)])
    shortest = lambda name: both.select(F.array_min(F.transform(F.sequence(F.lit(1), F.lit(atoms - 1)), lambda i: _gap(name, i))).alias("m")).agg(F.percentile("m", F.lit(0.01))).first()[0] if atoms > 1 else None
    return {
        "frames": cfg["frames"], "n_keep": cfg["n_keep"], "cv_error": cv_error, "fullatom_rmsd": float((both.agg(F.avg("d2")).first()[0] / atoms) ** 0.5), "kl_cv1_nats": kl, "pinsker_cv1": (max(kl, 0) / 2) ** 0.5,
        "bounded_gap": gap, "pinsker_ok": bool(gap <= (max(kl, 0) / 2) ** 0.5 + 1e-9), "coded_bytes": art.tables["latents"].agg(F.sum(F.length("stream"))).first()[0], "residual_bits": cfg["n_keep"] * cfg["width"] * cfg["n_bits"],
        "flow_bytes": 4 * density.model.size, "estimator": kind, "timescales": kinetics.implied_timescales(t, cfg["lag"], 5).tolist(), "neighbour_gap": (shortest("aligned"), shortest("got")),
    }


def _gap(name: str, i):
    """The distance of the atoms i - 1 and i."""
    at = lambda j, k: F.element_at(name, j * 3 + k)
    return F.sqrt(sum(((at(i, k) - at(i - 1, k)) * (at(i, k) - at(i - 1, k)) for k in (1, 2, 3)), F.lit(0.0)))


def flow_of(art: Artifact) -> Flow:
    """The density of the slow modes, from its stored parameters."""
    if not art.config.get("flow") or "flow" not in art.tables:
        raise ValueError("the artifact has no flow")
    return Flow.load(art.config["flow"], art.tables["flow"])


def decoder_of(art: Artifact) -> Flow:
    """The flow of what the linear decoder leaves."""
    if not art.config.get("flow_decoder") or "flow_decoder" not in art.tables:
        raise ValueError("the artifact has no flow decoder")
    return Flow.load(art.config["flow_decoder"], art.tables["flow_decoder"])


def predictor_of(art: Artifact):
    """The causal predictor of the latents, or None where the artifact was coded without one."""
    own = art.config.get("predictor")
    if not own or "predictor" not in art.tables:
        return None
    from lagfold.operators.predict import KINDS, Predictor

    v = {r.name: np.array(r.v) for r in art.tables["predictor"].collect()}  # three rows
    return Predictor(KINDS[own["kind"]](own["dim"], own["hidden"]), v["theta"], v["mean"], v["std"], own["kind"])


def decode(art: Artifact, full_atom: bool = False, smooth: bool = False) -> DataFrame:
    """Kept frames ``(k, run_id, t, state, weight, cv)``, or with ``xyz``: the linear decoder's frame and its coded residual.

    ``smooth`` takes the mode of the flow decoder for the residual instead.
    """
    cfg, spark = art.config, art.tables["kept"].sparkSession
    ship(spark)
    flow = flow_of(art)
    cv = flow.restored(decode_kept(art.tables["latents"], cfg["zmax"], cfg["lat_bits"], cfg["dim"]), "z", "cv").select("k", "cv")
    kept = art.tables["kept"].select("k", "run_id", "t", "state", "weight").join(cv, "k")
    if not full_atom:
        return kept
    v = {r.name: np.array(r.v) for r in art.tables["decoder"].collect()}  # modes + 2 rows
    b, seed, step, width = np.stack([v[f"b{k}"] for k in range(cfg["dim"])]), cfg["seed"], cfg["step"], cfg["width"]
    linear = lambda batch: (matrix(batch.column("cv")) - v["cmean"]) @ b + v["xmean"]
    if smooth:
        decoder = decoder_of(art)
        return with_column(decoder.modes(kept, "cv", "m"), "xyz", _ARRAY, lambda batch: rows_of(linear(batch) + matrix(batch.column("m")))).drop("m")
    means = np.zeros((cfg["n_states"], width))
    for r in art.tables["state_mean"].collect():  # states rows
        means[r.state] = r.r

    def rebuild(batch: pa.RecordBatch) -> pa.Array:
        u = draws(seed, batch.column("run_id").to_numpy(), batch.column("t").to_numpy(), width)
        return rows_of(linear(batch) + (matrix(batch.column("q")) - u) * step + means[batch.column("state").to_numpy()])

    return with_column(kept.join(art.tables["residual"].select("k", "q"), "k"), "xyz", _ARRAY, rebuild).drop("q")


def ensemble_average(kept: DataFrame, value) -> float:
    """The weighted average of a column over kept frames; kept frames alone over-represent the tails."""
    return kept.agg((F.sum(F.col("weight") * value) / F.sum("weight")).alias("v")).first().v
