"""Anchors with known values, exact round trips and invariants."""

import math

import numpy as np
import pandas as pd
import pytest

from lagfold.functions import coders, kinetics as K


def two_state(a, b=None):
    b = a if b is None else b
    return np.array([[1 - a, a], [b, 1 - b]])


def chain(t, n, seed=0):
    rng = np.random.default_rng(seed)
    s, u = [0], rng.random(n)
    cum = t.cumsum(1)
    for k in range(1, n):
        s.append(int(np.searchsorted(cum[s[-1]], u[k])))
    return np.array(s)


def count(s, n, lag=1):
    c = np.zeros((n, n))
    np.add.at(c, (s[:-lag], s[lag:]), 1)
    return c


@pytest.mark.parametrize("a,its", [(0.001, 499.4998), (0.01, 49.4983), (0.02, 24.4966), (0.05, 9.4912)])
def test_two_state_timescale(a, its):
    assert K.implied_timescales(two_state(a), 1, 1)[0] == pytest.approx(its, abs=1e-3)


def test_asymmetric_chain():
    assert K.implied_timescales(two_state(0.02, 0.06), 1, 1)[0] == pytest.approx(11.9931, abs=1e-3)
    assert K.stationary_distribution(two_state(0.002, 0.05))[0] == pytest.approx(0.961538, abs=1e-6)


def flows(c):
    mu = np.array([0.5, 0.3, 0.2])
    s = np.zeros((3, 3))
    s[0, 1] = s[1, 0] = 0.04
    s[0, 2] = s[2, 0] = 0.01
    s[1, 2] = s[2, 1] = 0.03
    p = c * s / mu[:, None]
    return p + np.diag(1 - p.sum(1))


def test_path_bound_anchors():
    p, q = flows(1.0), flows(0.3)
    r = K.fidelity(p, q, 1, 10_000, 2)
    assert r.transition == pytest.approx(0.0887067, abs=1e-6) and r.pair_bound == pytest.approx(0.210602, abs=1e-6)
    assert r.path == pytest.approx(886.97817, abs=1e-3) and abs(r.ensemble) < 1e-12
    assert r.timescales_p == pytest.approx([5.08665, 2.28162], abs=1e-4) and r.timescales_q == pytest.approx([18.17217, 8.88404], abs=1e-4)
    assert K.path_kl(p, flows(0.4), 10) == pytest.approx(0.509634, abs=1e-6)
    a, b = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.7, 0.3], [0.25, 0.75]])
    r = K.fidelity(a, b)
    assert (r.transition, r.ensemble, r.pair_bound) == (pytest.approx(0.0798819, abs=1e-6), pytest.approx(0.0911693, abs=1e-6), pytest.approx(0.292448, abs=1e-6))
    assert K.transition_kl_rate(two_state(0.1), two_state(0.2)) == pytest.approx(0.0366900, abs=1e-6)


def test_missing_support_makes_the_pair_bound_infinite():
    p = np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
    q = p.copy()
    q[0, 1], q[0, 0] = 0.0, 0.9
    r = K.fidelity(p, q, 1, 100)
    assert not r.support_ok and math.isinf(r.pair_bound) and math.isfinite(r.path) and r.transition_is_lower_bound
    assert K.fidelity(p, p).support_ok


def test_entropy_rate():
    for a, bits in ((0.02, 0.141441), (0.05, 0.286397)):
        t = two_state(a)
        assert K.entropy_rate(t, K.stationary_distribution(t)) == pytest.approx(bits, abs=1e-5)


def test_connected_sets_and_estimates():
    c = np.zeros((5, 5))
    c[0, 1] = c[1, 0] = 5
    c[2, 3] = c[3, 2] = 9
    c[4, 0] = 100
    assert K.largest_connected_set(c).tolist() == [2, 3]
    t, kind = K.estimate(c)
    assert kind == "likelihood" and t[4, 4] == 1 and np.allclose(t.sum(1), 1)
    assert K.estimate(np.zeros((2, 2)))[1] == "symmetric"
    with pytest.raises(ValueError):
        K.estimate(np.zeros((2, 2)), ("likelihood",))
    s = chain(np.array([[0.9, 0.1, 0], [0.05, 0.9, 0.05], [0, 0.2, 0.8]]), 20_000)
    t, act = K.reversible_mle(count(s, 3))
    pi = K.stationary_distribution(t)
    flow = pi[:, None] * t
    assert np.allclose(flow, flow.T, atol=1e-8) and len(act) == 3


def test_passage_and_metastability():
    t = two_state(0.02, 0.06)
    assert K.passage_times(t, [1])[0] == pytest.approx(50) and K.passage_times(t, [0])[1] == pytest.approx(1 / 0.06)
    block = np.array([[0.89, 0.1, 0.01, 0], [0.1, 0.89, 0, 0.01], [0.01, 0, 0.89, 0.1], [0, 0.01, 0.1, 0.89]])
    sets, pops, m = K.metastable_mfpt(block, np.full(4, 0.25), 2, 0.5)
    assert sets[0] == sets[1] != sets[2] == sets[3] and np.allclose(pops, 0.5) and np.isnan(m[0, 0]) and m[0, 1] == pytest.approx(50, rel=1e-6)
    by = {k: np.linalg.matrix_power(block, k) for k in (1, 2, 4)}
    assert max(K.ck_deviation(by, sets, np.full(4, 0.25), (1, 2, 4)).values()) < 1e-12


def test_resolution_gates():
    c = count(chain(two_state(0.02), 30_000), 2)
    (r,) = K.kinetic_resolution(K.posterior_timescales(c, 1, 1, 60), c.sum())
    assert r.resolved and r.low < 24.5 < r.high
    few = count(chain(two_state(0.02), 60), 2)
    (r,) = K.kinetic_resolution(K.posterior_timescales(few, 1, 1, 60), few.sum())
    assert not r.resolved
    (r,) = K.kinetic_resolution(np.full((3, 1), np.nan), 10)
    assert not r.resolved and r.events == 0
    (r,) = K.kinetic_resolution(np.full((4, 1), 5.0), 100, dt=2.0)
    assert (r.timescale, r.events, r.resolved) == (10.0, 20.0, True)


def test_effective_counts_widen_the_interval():
    s = chain(two_state(0.02), 20_000)
    narrow, wide = (K.posterior_timescales(count(s, 2, 20) * f, 20, 1, 80).std() for f in (20, 1))
    assert wide > 2.5 * narrow


def test_stationary_shares():
    t = np.array([[0.5, 0.5, 0, 0], [0.2, 0.8, 0, 0], [0.1, 0, 0.4, 0.5], [0, 0, 0, 0]])
    assert K.stationary_distribution(t) == pytest.approx([2 / 7, 5 / 7, 0, 0])
    assert K.stationary_distribution(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    rng = np.random.default_rng(0)
    r = rng.random((30, 30))
    r /= r.sum(1, keepdims=True)
    pi = K.stationary_distribution(r)
    assert np.allclose(pi @ r, pi) and np.allclose(K.spectrum(r)[0], 1)


def test_coders_round_trip_and_length():
    t = two_state(0.02)
    pi = K.stationary_distribution(t)
    s = chain(t, 20_000)
    data = coders.encode_markov(s, t, pi)
    assert coders.decode_markov(data, len(s), t, pi) == s.tolist()
    h = K.entropy_rate(t, pi)
    assert h * 0.97 <= 8 * len(data) / len(s) <= 1.15 * h + 0.05
    rng = np.random.default_rng(2)
    q = np.clip(np.floor((np.clip(rng.normal(size=15_000), -5, 5) + 5) / 10 * 256), 0, 255).astype(int)
    cum = coders.gaussian_table(256, 5.0)
    data = coders.encode_iid(q, cum)
    p = np.bincount(q) / len(q)
    p = p[p > 0]
    assert coders.decode_iid(data, len(q), cum) == q.tolist() and 8 * len(data) / len(q) < -(p * np.log2(p)).sum() + 0.5
    assert coders.decode_iid(coders.encode_iid([], cum), 0, cum) == []


def test_frequencies():
    for p in ([1.0], [0, 0, 1], np.zeros(4), np.full(3000, 1 / 3000), [1 - 1e-9, 1e-9]):
        f = np.diff(coders.frequencies(p))
        assert f.sum() == coders.TOTAL and f.min() >= 1
    with pytest.raises(ValueError):
        coders.frequencies(np.ones(coders.TOTAL + 1))


def test_tica_finds_the_slow_direction():
    rng = np.random.default_rng(3)
    slow = np.where(chain(two_state(0.01), 20_000) > 0, 1.0, -1.0)
    x = np.stack([rng.normal(size=20_000) * 3, slow + 0.1 * rng.normal(size=20_000), rng.normal(size=20_000)], 1)
    x -= x.mean(0)
    c0, ct = x.T @ x / len(x), x[:-10].T @ x[10:] / (len(x) - 10)
    proj, its = K.tica(x.mean(0), c0, ct, 10, 2)
    assert np.abs(proj[:, 0]).argmax() == 1 and proj[1, 0] > 0 and its[0] > 20 > its[1]
    w, back = K.whitening(np.cov(x.T))
    assert np.allclose(np.cov((x @ w).T), np.eye(3), atol=1e-6) and np.allclose(x @ w @ back, x)
    assert K.vamp_score(c0, ct, c0) >= K.vamp_score(c0[:1, :1], ct[:1, :1], c0[:1, :1])


def test_settled_bits_leave_at_once_and_blocks_together():
    """The streams are those of a coder that moves bit by bit; a symbol takes one step for all its bits, and decoded blocks leave in one table."""
    from types import SimpleNamespace

    from lagfold.operators import coding

    def slow(symbols, cum):
        low, high, waiting, bits, half, quarter = 0, (1 << 32) - 1, 0, [], 1 << 31, 1 << 30
        for s in symbols:
            width = high - low + 1
            low, high = low + width * int(cum[s]) // coders.TOTAL, low + width * int(cum[s + 1]) // coders.TOTAL - 1
            while True:
                if high < half or low >= half:
                    bits += [int(low >= half)] + [int(low < half)] * waiting
                    waiting, off = 0, half * (low >= half)
                elif low >= quarter and high < half + quarter:
                    waiting, off = waiting + 1, quarter
                else:
                    break
                low, high = 2 * (low - off), 2 * (high - off) + 1
        bits += [int(low >= quarter)] + [int(low < quarter)] * (waiting + 1)
        return np.packbits(np.array(bits, np.uint8)).tobytes()

    rng = np.random.default_rng(4)
    for cum, q in ((coders.gaussian_table(64, 5.0), rng.integers(0, 64, 200)), (np.array([0, 32767, 32769, 65536]), np.ones(50, int)), (coders.frequencies([1]), np.zeros(9, int)), (coders.gaussian_table(8, 3.0), np.zeros(0, int))):
        assert coders.encode_iid(q.tolist(), cum) == slow(q, cum) and coders.decode_iid(slow(q, cum), len(q), cum) == q.tolist()
    e = coders.Encoder()
    e.push(1, 2)
    assert len(e.bits) <= 1  # 16 bits in one piece

    model = coding.LinearPredictor(np.zeros((1, 1)), np.zeros(1), np.zeros(1))
    caught = {}
    plain = SimpleNamespace(select=lambda *c: SimpleNamespace(mapInPandas=lambda f, schema: caught.update(f=f)))
    coding.decode_predictive(plain, model, 4)
    rows = pd.DataFrame({"run_id": range(20), "n": 3, "t0": 0, "step": 1, "ts": [None] * 20, "stream": [coders.encode_iid([7] * 3, coders.gaussian_table(16, 8.0))] * 20})
    tables = list(caught["f"](iter([rows])))
    assert len(tables) == 1 and tables[0][["run_id", "t"]].values.tolist() == [[r, t] for r in range(20) for t in range(3)]
