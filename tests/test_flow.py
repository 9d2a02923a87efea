"""Flows, farthest points and the flow codec against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfold.functions import nets
from lagfold.operators import selection
from lagfold.operators.flow import Flow


def table(spark, x, name="cv"):
    return spark.createDataFrame([(k % 3, k // 3, v.tolist()) for k, v in enumerate(x)], f"run_id long, t long, {name} array<double>")


def three_wells(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.stack([np.array([-2.0, 0.0, 2.0])[rng.integers(0, 3, n)] + 0.35 * rng.normal(size=n), 0.6 * rng.normal(size=n)], 1)


@pytest.mark.parametrize("model", [nets.Couplings(3, 8, 4), nets.Couplings(3, 8, 4, 2), nets.Splines(3, 8, 4, 5)])
def test_gradients_by_differences(model):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(20, 3)), rng.normal(size=(20, 2)) if getattr(model, "condition", 0) else None
    x[0] = [7, -8, 1]  # outside a spline's reach
    theta = model.start(1) + 0.1 * rng.normal(size=model.size)
    value, g = model.loss(theta, x, c)
    for k in rng.choice(model.size, 40, replace=False):
        step = 1e-6 * np.eye(1, model.size, k)[0]
        assert (model.loss(theta + step, x, c)[0] - model.loss(theta - step, x, c)[0]) / 2e-6 == pytest.approx(g[k], abs=1e-5)
    z, _ = model.forward(theta, x, c)
    assert np.abs(model.inverse(theta, z, c) - x).max() < 1e-9 and value == pytest.approx(-model.log_prob(theta, x, c).sum())


@pytest.mark.parametrize("kind,shape", [("coupling", {"hidden": 32, "layers": 6}), ("spline", {"hidden": 16, "layers": 2, "bins": 8})])
def test_density_of_three_wells(spark, kind, shape):
    x = three_wells(3000)
    df = table(spark, x)
    flow = Flow.fit(df, kind=kind, steps=90, rate=1e-2, share=0.5, **shape)
    assert flow.history[-1] < flow.history[0] - 0.1
    z = flow.latents(df)
    back = flow.restored(z, out="back")
    assert back.agg(F.max(F.array_max(F.zip_with("cv", "back", lambda a, b: F.abs(a - b))))).first()[0] < 1e-6
    inside = flow.densities(df).agg(F.avg("log_prob")).first()[0]
    rng = np.random.default_rng(1)
    assert inside > flow.log_prob(rng.uniform([-5, -3], [5, 3], (1000, 2))).mean() + 2
    gx, gy = np.linspace(-6, 6, 160), np.linspace(-4, 4, 100)
    grid = np.stack([a.ravel() for a in np.meshgrid(gx, gy)], 1)
    assert 0.9 < np.exp(flow.log_prob(grid)).sum() * (gx[1] - gx[0]) * (gy[1] - gy[0]) < 1.1
    again = Flow.load(flow.config(), flow.table(spark))
    assert np.array_equal(again.forward(x[:50]), flow.forward(x[:50]))
    s = flow.samples(spark, 400).agg(F.avg(F.col("x")[0] * F.col("x")[0])).first()[0]
    assert s == pytest.approx((x[:, 0] ** 2).mean(), rel=0.35)


def test_a_conditional_flow_finds_the_modes(spark):
    rng = np.random.default_rng(2)
    c = rng.integers(0, 2, 1200)
    x = np.stack([np.where(c == 0, -1.0, 2.0), np.where(c == 0, 0.5, -0.5)], 1) + 0.1 * rng.normal(size=(1200, 2))
    df = spark.createDataFrame([(v.tolist(), [float(k == 0), float(k == 1)]) for v, k in zip(x, c)], "x array<double>, c array<double>")
    flow = Flow.fit(df, "x", "c", steps=60, rate=2e-2, hidden=12, layers=4)
    modes = flow.modes(df.select("c").distinct(), "c").orderBy(F.col("c")[0].desc()).collect()
    assert np.abs(np.array(modes[0].mode) - [-1, 0.5]).max() < 0.15 and np.abs(np.array(modes[1].mode) - [2, -0.5]).max() < 0.15


def serial(x, ids, count, start):
    d, out = ((x - x[start]) ** 2).sum(1), [start]
    d[start] = -1
    for _ in range(min(count, len(x)) - 1):
        k = min(np.flatnonzero(d == d.max()), key=lambda j: ids[j])
        live = d >= 0
        d[live] = np.minimum(d[live], ((x[live] - x[k]) ** 2).sum(1))
        d[k] = -1
        out.append(k)
    return [ids[k] for k in out]


@pytest.mark.parametrize("pool,block,spread", [(4, 16, 100), (64, 50, 3), (512, 4096, 1000)])
def test_farthest_points_are_the_serial_ones(spark, pool, block, spread):
    rng = np.random.default_rng(pool)
    x = np.round(rng.normal(size=(300, 3)) * spread)  # with ties and repeated vectors
    ids = [(k % 3, k // 3) for k in range(300)]
    df = table(spark, x, "z").union(spark.createDataFrame([(9, 9, None)], "run_id long, t long, z array<double>"))
    got = selection.farthest(df, 40, start=(1, 5), pool=pool, block=block)
    assert [(r, t) for r, t, _ in got] == serial(x, ids, 40, ids.index((1, 5)))
    assert all(v == x[ids.index((r, t))].tolist() for r, t, v in got)
    some = df.where("run_id = 0 and t < 7")
    assert len(selection.farthest(some, 40)) == 7 and selection.farthest(some.limit(0), 3) == []


def test_weights_undo_the_bias(spark):
    z = np.random.default_rng(0).normal(size=(6000, 1))
    df = table(spark, z, "z")
    kept = np.array([v for _, _, v in selection.farthest(df, 200)])
    w = selection.cell_shares(df, kept)
    mean = (w * kept[:, 0]).sum()
    assert w.sum() == pytest.approx(1) and kept.var() > 1.5 and (w * (kept[:, 0] - mean) ** 2).sum() == pytest.approx(1, abs=0.15)
