"""Queries of long runs, coverage selection, flows and learned coders; the SQL is written on its own, from the definitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lagfold.operators import counts, frames
from lagfold.operators.tables import written
from lagfold.plans.registry import EV, Z, query
from lagfold.shipping import ship

LAGS = (1, 10, 100)


@query("long_run_counts", "WITH x AS (SELECT event_id AS t, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS state FROM events), p AS (" + " UNION ALL ".join(f"SELECT {n} AS lag, state AS i, lead(state, {n}) OVER (ORDER BY t) AS j, lead(t, {n}) OVER (ORDER BY t) AS h FROM x" for n in LAGS) + """)
SELECT CAST(lag AS INTEGER) AS lag, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS c FROM p WHERE h IS NOT NULL GROUP BY ALL""")
def long_run_counts(spark, d):
    """All events as one run: its ranges are ordered by many tasks, with halos between them."""
    ev = frames.table(spark, d, "events").select("event_id", frames.state_of(F.col("event_type"), frames.EVENT_STATES).alias("state"))
    return counts.counts_by_lag(frames.numbered_whole(ev, "event_id"), list(LAGS), span=1 << 12)


@query("rate_ladders")
def rate_ladders(spark, d):
    """Grid and principal-mode rates of the coordinates by setting, measured on a fixed ruler."""
    from lagfold.plans import benchmark

    x = written(frames.coordinates(spark, d).select("run_id", "t", "xyz"))  # read by every pass
    rows = benchmark.ladders(x, benchmark.Ruler(x, 1, 8), {"xtc": (50, 5), "pca": (4,)})
    return spark.createDataFrame([(r["method"], r["setting"], round(r["bits_per_frame"], 6), round(r["ratio"], 6), None if r["error"] != r["error"] else round(r["error"], 6)) for r in rows], "method string, setting double, bits_per_frame double, ratio double, error double")


POINTS = "v AS (SELECT vec_id AS t, list_transform(embedding[1:8], lambda x: floor(x::DOUBLE * 4096)) AS z FROM embeddings)"


@query("farthest_points", f"""WITH RECURSIVE {POINTS}, s AS (SELECT t, z FROM v ORDER BY t LIMIT 1),
r(n, t, z, d, pick) AS (SELECT 0, v.t, v.z, CASE WHEN v.t = s.t THEN -1 ELSE list_sum(list_transform(list_zip(v.z, s.z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) END, s.t FROM v, s
  UNION ALL SELECT n + 1, r.t, r.z, CASE WHEN r.t = b.t OR r.d < 0 THEN -1 ELSE least(r.d, list_sum(list_transform(list_zip(r.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) END, b.t
    FROM r, (SELECT t, z FROM r ORDER BY d DESC, t LIMIT 1) b WHERE n < 31)
SELECT DISTINCT CAST(n AS INTEGER) AS n, pick AS vec_id FROM r""")
def farthest_points(spark, d):
    """Coverage of the vectors' first eight integers: 32 farthest points from the smallest id on."""
    from lagfold.operators.selection import farthest

    z = F.transform(F.slice(F.col("embedding"), 1, 8), lambda x: F.floor(x.cast("double") * 4096).cast("double"))
    rows = frames.table(spark, d, "embeddings").select(F.lit(0).cast("long").alias("run_id"), F.col("vec_id").alias("t"), z.alias("z"))
    first = rows.agg(F.min("t")).first()[0]
    return spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(farthest(rows, 32, start=(0, first), pool=64))], "n int, vec_id long")


@query("predictive_stream_roundtrip", f"WITH {EV} SELECT run_id, count(*) AS n, true AS ok FROM ev GROUP BY 1")
def predictive_stream_roundtrip(spark, d):
    """Innovations under a fitted linear predictor, range coded in blocks and decoded from the streams alone."""
    from lagfold.operators import coding

    ship(spark)
    z = frames.events(spark, d).select("run_id", "t", F.array(F.expr(f"greatest(least({Z}, 3), -3)"), F.col("k") / 25 - 2).alias("z"))
    model = coding.LinearPredictor.fit(z)
    back = coding.decode_predictive(coding.encode_predictive(z, model, 10), model, 10).select("run_id", "t", F.col("z").alias("got"))
    most = 16 / 1024 * max(1.0, float(np.exp(model.log_s.max())))  # a step in units of the larger deviation
    ok = F.array_max(F.zip_with("z", "got", lambda a, b: F.abs(a - b))) <= most
    return z.join(back, ["run_id", "t"], "full").groupBy("run_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))


@query("flow_density", f"WITH {EV} SELECT count(*) AS n, true AS exact, true AS better FROM ev")
def flow_density(spark, d):
    """A coupling flow of (value, k): its inverse is exact, and its density beats the normal law of the same means and deviations."""
    from lagfold.operators.flow import Flow

    ship(spark)
    x = frames.events(spark, d).select("run_id", "t", F.array(F.expr(Z), F.col("k") / 25 - 2).alias("cv"))
    flow = Flow.fit(x, steps=25, rate=1e-2, hidden=16, layers=4)
    both = flow.densities(flow.restored(flow.latents(x), out="back"))
    gap = F.array_max(F.zip_with("cv", "back", lambda a, b: F.abs(a - b)))
    return both.agg(F.count("*").alias("n"), (F.max(gap) < 1e-6).alias("exact"), (F.avg("log_prob") > -flow.history[0]).alias("better"))


@query("flow_codec_roundtrip", "SELECT greatest(2, CAST(floor(0.1 * count(*)) AS BIGINT)) AS n_keep, true AS ok FROM embeddings")
def flow_codec_roundtrip(spark, d):
    """Embeddings as coordinates through the flow codec: kept frames come back to within their residuals' steps."""
    from lagfold.operators import geometry
    from lagfold.plans import flowcodec

    x = written(frames.coordinates(spark, d).select("run_id", "t", "xyz"))  # read by every pass
    art, _ = flowcodec.fit_encode(x, lag=1, dim=2, states=8, n_bits=8, steps=10, hidden=8, layers=2)
    ref = geometry.reference_frame(x)
    kept = flowcodec.decode(art, full_atom=True).select("run_id", "t", F.col("xyz").alias("got"))
    own = geometry.kabsch(x.join(kept.select("run_id", "t"), ["run_id", "t"], "left_semi"), ref).select("run_id", "t", "aligned")
    gap = F.array_max(F.zip_with("aligned", "got", lambda a, b: F.abs(a - b)))
    return own.join(kept, ["run_id", "t"]).agg(F.count("*").alias("n_keep"), (F.max(gap) <= art.config["step"] * 1.0001).alias("ok"))
