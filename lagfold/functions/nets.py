"""Small networks with reverse-mode gradients in numpy: pure functions of a flat parameter vector, so that tasks make gradients and the driver adds them up."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class Mlp:
    """Dense layers with a nonlinearity between; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, sizes: tuple[int, ...], activation: str = "relu"):
        self.sizes, self.activation = tuple(sizes), activation
        self.size = sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))

    def start(self, rng: np.random.Generator, last: float = 1.0) -> np.ndarray:
        """Scaled normal weights, zero biases; the last layer's weights times ``last``."""
        parts, n = [], len(self.sizes) - 1
        for k, (a, b) in enumerate(zip(self.sizes, self.sizes[1:])):
            w = rng.normal(size=(a, b)) * (2.0 / a) ** 0.5
            parts += [(w * last if k + 1 == n else w).ravel(), np.zeros(b)]
        return np.concatenate(parts)

    def layers(self, theta: np.ndarray):
        at = 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            yield theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]
            at += a * b + b

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tape, n = [], len(self.sizes) - 1
        for k, (w, b) in enumerate(self.layers(theta)):
            tape.append(x)
            x = x @ w + b
            if k + 1 < n:
                x = np.maximum(x, 0) if self.activation == "relu" else np.tanh(x)
        return x, tape

    def backward(self, theta: np.ndarray, tape: list[np.ndarray], dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the input, gradient of the parameters)."""
        parts, layers = [], list(self.layers(theta))
        for k in range(len(layers) - 1, -1, -1):
            w, _ = layers[k]
            parts = [(tape[k].T @ dy).ravel(), dy.sum(0), *parts]
            dy = dy @ w.T
            if k:
                dy = dy * ((tape[k] > 0) if self.activation == "relu" else 1 - tape[k] ** 2)
        return dy, np.concatenate(parts)


@dataclass
class Adam:
    """Adam steps on a flat vector."""

    rate: float = 1e-3
    decay: tuple[float, float] = (0.9, 0.999)
    turn: int = 0
    mean: np.ndarray | None = field(default=None, repr=False)
    square: np.ndarray | None = field(default=None, repr=False)

    def step(self, theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if self.mean is None:
            self.mean, self.square = np.zeros_like(theta), np.zeros_like(theta)
        a, b = self.decay
        self.turn += 1
        self.mean = a * self.mean + (1 - a) * gradient
        self.square = b * self.square + (1 - b) * gradient**2
        return theta - self.rate * (self.mean / (1 - a**self.turn)) / (np.sqrt(self.square / (1 - b**self.turn)) + 1e-8)


class Couplings:
    """A chain of affine couplings between standardised data and a standard normal law, on request under a condition.

    Each layer leaves every other coordinate as it is; a network of those (and the condition)
    gives the others' log scales, bounded by 1, and shifts.  Maps, inverses and log volumes are exact.
    """

    def __init__(self, dim: int, hidden: int = 64, layers: int = 8, condition: int = 0):
        self.dim, self.hidden, self.count, self.condition = dim, hidden, layers, condition
        self.net = Mlp((dim + condition, hidden, hidden, 2 * dim))
        self.masks = [(np.arange(dim) % 2 == k % 2).astype(float) for k in range(layers)]
        self.size = layers * self.net.size

    def start(self, seed: int = 0) -> np.ndarray:
        """Parameters of the identity."""
        rng = np.random.default_rng(seed)
        return np.concatenate([self.net.start(rng, 0.0) for _ in range(self.count)])

    def _parts(self, theta: np.ndarray) -> np.ndarray:
        return theta.reshape(self.count, self.net.size)

    def _input(self, held: np.ndarray, c: np.ndarray | None) -> np.ndarray:
        return held if c is None else np.concatenate([held, c], 1)

    def forward(self, theta: np.ndarray, x: np.ndarray, c: np.ndarray | None = None, tapes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(z, log volume of the map at each row)."""
        volume = np.zeros(len(x))
        for own, mask in zip(self._parts(theta), self.masks):
            out, tape = self.net.forward(own, self._input(x * mask, c))
            s, t = np.tanh(out[:, : self.dim]) * (1 - mask), out[:, self.dim :] * (1 - mask)
            if tapes is not None:
                tapes.append((x, s, tape))
            x = x * mask + (1 - mask) * (x * np.exp(s) + t)
            volume += s.sum(1)
        return x, volume

    def inverse(self, theta: np.ndarray, z: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        for own, mask in zip(self._parts(theta)[::-1], self.masks[::-1]):
            out, _ = self.net.forward(own, self._input(z * mask, c))
            s, t = np.tanh(out[:, : self.dim]), out[:, self.dim :]
            z = z * mask + (1 - mask) * (z - t) * np.exp(-s * (1 - mask))
        return z

    def loss(self, theta: np.ndarray, x: np.ndarray, c: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """(negative log likelihood, its gradient), summed over the rows."""
        tapes: list = []
        z, volume = self.forward(theta, x, c, tapes)
        value = 0.5 * (z * z).sum() + 0.5 * z.size * np.log(2 * np.pi) - volume.sum()
        gradient, dz = [], z
        for own, mask, (x, s, tape) in zip(self._parts(theta)[::-1], self.masks[::-1], tapes[::-1]):
            live = 1 - mask
            ds = live * dz * x * np.exp(s) - live  # the volume counts each log scale once
            dout = np.concatenate([ds * (1 - s * s), live * dz], 1)
            din, g = self.net.backward(own, tape, dout)
            gradient.insert(0, g)
            dz = dz * mask + live * dz * np.exp(s) + din[:, : self.dim] * mask
        return value, np.concatenate(gradient)

    def log_prob(self, theta: np.ndarray, x: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        z, volume = self.forward(theta, x, c)
        return -0.5 * (z * z + np.log(2 * np.pi)).sum(1) + volume


class Splines:
    """Couplings by monotone rational-quadratic splines on [-reach, reach], the identity outside.

    Networks of the held coordinates give widths, heights and slopes of ``bins`` pieces; the map, its
    inverse (a root of a quadratic) and its slope are closed forms.
    """

    least = 1e-3

    def __init__(self, dim: int, hidden: int = 32, layers: int = 4, bins: int = 8, reach: float = 5.0):
        self.dim, self.count, self.bins, self.reach = dim, layers, bins, reach
        self.net = Mlp((dim, hidden, hidden, dim * (3 * bins - 1)))
        self.masks = [(np.arange(dim) % 2 == k % 2).astype(float) for k in range(layers)]
        self.size = layers * self.net.size

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([self.net.start(rng, 0.0) for _ in range(self.count)])

    def _knots(self, out: np.ndarray):
        """Softmax shares of widths and heights, and slopes at the knots, which are 1 at both ends."""
        b = self.bins
        raw = out.reshape(len(out), self.dim, 3 * b - 1)

        def shares(u):
            e = np.exp(u - u.max(2, keepdims=True))
            return e / e.sum(2, keepdims=True)

        w, h = shares(raw[..., :b]), shares(raw[..., b : 2 * b])
        u = raw[..., 2 * b :] + np.log(np.expm1(1 - self.least))
        inner = self.least + np.logaddexp(0, u)
        one = np.ones((*inner.shape[:2], 1))
        return w, h, np.concatenate([one, inner, one], 2), u

    def _piece(self, x: np.ndarray, w: np.ndarray, h: np.ndarray, d: np.ndarray, back: bool):
        wide = 2 * self.reach * (self.least + (1 - self.least * self.bins) * w)
        high = 2 * self.reach * (self.least + (1 - self.least * self.bins) * h)
        pad = lambda v: np.concatenate([np.zeros((*v.shape[:2], 1)), np.cumsum(v, 2)], 2) - self.reach
        xs, ys = pad(wide), pad(high)
        inside = np.abs(x) < self.reach
        k = np.clip(((ys if back else xs)[..., :-1] <= x[..., None]).sum(2) - 1, 0, self.bins - 1)
        at = lambda v, j=k: np.take_along_axis(v, j[..., None], 2)[..., 0]
        return k, inside, at(xs), at(ys), at(wide), at(high), at(d), at(d, k + 1)

    def _map(self, x, w, h, d):
        """(y, log slope, pieces)."""
        k, inside, x0, y0, dx, dy, d0, d1 = self._piece(x, w, h, d, False)
        s, t = dy / dx, np.clip((x - x0) / dx, 0, 1)
        q = s + (d1 + d0 - 2 * s) * t * (1 - t)
        y = y0 + dy * (s * t * t + d0 * t * (1 - t)) / q
        slope = s * s * (d1 * t * t + 2 * s * t * (1 - t) + d0 * (1 - t) ** 2) / (q * q)
        return np.where(inside, y, x), np.where(inside, np.log(slope), 0.0)

    def _unmap(self, y, w, h, d):
        k, inside, x0, y0, dx, dy, d0, d1 = self._piece(y, w, h, d, True)
        s, v = dy / dx, np.clip(y - y0, 0, dy)
        m = d1 + d0 - 2 * s
        a, b, c = dy * (s - d0) + v * m, dy * d0 - v * m, -s * v
        t = 2 * c / (-b - np.sqrt(np.maximum(b * b - 4 * a * c, 0)))
        return np.where(inside, x0 + t * dx, y)

    def forward(self, theta: np.ndarray, x: np.ndarray, c=None) -> tuple[np.ndarray, np.ndarray]:
        volume = np.zeros(len(x))
        for own, mask in zip(theta.reshape(self.count, -1), self.masks):
            w, h, d, _ = self._knots(self.net.forward(own, x * mask)[0])
            y, log_slope = self._map(x, w, h, d)
            x = np.where(mask > 0, x, y)
            volume += (log_slope * (1 - mask)).sum(1)
        return x, volume

    def inverse(self, theta: np.ndarray, z: np.ndarray, c=None) -> np.ndarray:
        for own, mask in zip(theta.reshape(self.count, -1)[::-1], self.masks[::-1]):
            w, h, d, _ = self._knots(self.net.forward(own, z * mask)[0])
            z = np.where(mask > 0, z, self._unmap(z, w, h, d))
        return z

    def log_prob(self, theta: np.ndarray, x: np.ndarray, c=None) -> np.ndarray:
        z, volume = self.forward(theta, x)
        return -0.5 * (z * z + np.log(2 * np.pi)).sum(1) + volume

    def loss(self, theta: np.ndarray, x: np.ndarray, c=None) -> tuple[float, np.ndarray]:
        """(negative log likelihood, its gradient), summed over the rows."""
        steps = []
        for own, mask in zip(theta.reshape(self.count, -1), self.masks):
            out, tape = self.net.forward(own, x * mask)
            w, h, d, u = self._knots(out)
            y, log_slope = self._map(x, w, h, d)
            steps.append((x, tape, w, h, d, u, log_slope))
            x = np.where(mask > 0, x, y)
        value = 0.5 * (x * x).sum() + 0.5 * x.size * np.log(2 * np.pi) - sum((s[6] * (1 - m)).sum() for s, m in zip(steps, self.masks))
        dz, gradient = x, []
        for own, mask, (x, tape, w, h, d, u, _) in zip(theta.reshape(self.count, -1)[::-1], self.masks[::-1], steps[::-1]):
            live = (1 - mask) * np.ones_like(x)
            dx, dw, dh, dd = self._pulled(x, w, h, d, dz * live, -live)
            soft = lambda p, g: p * (g - (g * p).sum(2, keepdims=True))
            dout = np.concatenate([soft(w, dw), soft(h, dh), dd[..., 1:-1] / (1 + np.exp(-u))], 2)
            din, g = self.net.backward(own, tape, dout.reshape(len(x), -1))
            gradient.insert(0, g)
            dz = dz * mask + dx + din * mask
        return value, np.concatenate(gradient)

    def _pulled(self, x, w, h, d, gy, gl):
        """Gradients of x, shares and slopes from those of the map (``gy``) and of its log slope (``gl``)."""
        k, inside, x0, y0, dx, dy, d0, d1 = self._piece(x, w, h, d, False)
        t, s = np.clip((x - x0) / dx, 0, 1), dy / dx
        r, m = 1 - t, d1 + d0 - 2 * s
        q = s + m * t * r
        p = s * t * t + d0 * t * r
        e = d1 * t * t + 2 * s * t * r + d0 * r * r
        outside, gy, gl = gy, np.where(inside, gy, 0.0), np.where(inside, gl, 0.0)
        gp, gq, gdy, gy0 = gy * dy / q, -gy * dy * p / (q * q) - 2 * gl / q, gy * p / q, gy
        ge = gl / e
        gs = gp * t * t + gq * (1 - 2 * t * r) + ge * 2 * t * r + 2 * gl / s
        gd0 = gp * t * r + gq * t * r + ge * r * r
        gd1 = gq * t * r + ge * t * t
        gt = gp * (2 * s * t + d0 * (1 - 2 * t)) + gq * m * (1 - 2 * t) + ge * (2 * d1 * t + 2 * s * (1 - 2 * t) - 2 * d0 * r)
        gdy = gdy + gs / dx
        gdx = -gs * s / dx - gt * t / dx
        gx, gx0 = gt / dx, -gt / dx
        b, scale = self.bins, 2 * self.reach * (1 - self.least * self.bins)
        before = (np.arange(b) < k[..., None]).astype(float)
        here = (np.arange(b) == k[..., None]).astype(float)
        gw = scale * (before * gx0[..., None] + here * gdx[..., None])
        gh = scale * (before * gy0[..., None] + here * gdy[..., None])
        gd = np.zeros_like(d)
        np.put_along_axis(gd, k[..., None], gd0[..., None], 2)
        np.put_along_axis(gd, k[..., None] + 1, gd1[..., None], 2)
        return np.where(inside, gx, outside), gw, gh, gd  # outside its reach a spline is the identity



def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Predictor:
    """What predictors of the next vector share: mean and log deviation from an output of twice the width, and the loss of sequences."""

    reach = 3.0

    def _told(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return out[..., : self.dim], np.tanh(out[..., self.dim :]) * self.reach

    def loss(self, theta: np.ndarray, z: np.ndarray, live: np.ndarray | None = None) -> tuple[float, np.ndarray, int]:
        """(negative log likelihood of each next vector, its gradient, predicted numbers) of sequences (batch, time, dim); ``live`` tells real frames from padding."""
        out, tape = self.run(theta, z)
        mean, log_s = self._told(out[:, :-1])
        real = np.ones(z.shape[:2], bool) if live is None else live
        w = (real[:, 1:] & real[:, :-1])[..., None].astype(float)
        r = (z[:, 1:] - mean) * np.exp(-log_s)
        value = (w * (0.5 * r * r + log_s + 0.5 * np.log(2 * np.pi))).sum()
        d = np.zeros_like(out)
        d[:, :-1, : self.dim] = -w * r * np.exp(-log_s)
        d[:, :-1, self.dim :] = w * (1 - r * r) * (self.reach - log_s**2 / self.reach)
        return value, self.back(theta, tape, d), int(w.sum()) * self.dim


class Recurrent(_Predictor):
    """A gated recurrent cell and a linear read-out, with gradients through time."""

    def __init__(self, dim: int, hidden: int = 32):
        self.dim, self.hidden = dim, hidden
        self.shapes = [(dim, 3 * hidden), (hidden, 2 * hidden), (hidden, hidden), (3 * hidden,), (hidden, 2 * dim), (2 * dim,)]
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        scale = [self.dim**-0.5, self.hidden**-0.5, self.hidden**-0.5, 0, 0, 0]
        return np.concatenate([(rng.normal(size=s) * k).ravel() for s, k in zip(self.shapes, scale)])

    def _parts(self, theta: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(theta[at : at + n].reshape(s))
            at += n
        return out

    def begin(self) -> np.ndarray:
        return np.zeros((1, self.hidden))

    def _cell(self, parts, x, h):
        wx, wg, wc, b = parts[:4]
        n = self.hidden
        pre = x @ wx + b
        gates = _sigmoid(pre[:, : 2 * n] + h @ wg)
        u, r = gates[:, :n], gates[:, n:]
        c = np.tanh(pre[:, 2 * n :] + (r * h) @ wc)
        return u * h + (1 - u) * c, u, r, c

    def advance(self, theta: np.ndarray, state: np.ndarray, z: np.ndarray):
        parts = self._parts(theta)
        h = self._cell(parts, z[None], state)[0]
        mean, log_s = self._told(h @ parts[4] + parts[5])
        return h, mean[0], log_s[0]

    def run(self, theta: np.ndarray, z: np.ndarray):
        parts, h, steps, hs = self._parts(theta), np.zeros((len(z), self.hidden)), [], []
        for t in range(z.shape[1]):
            new, u, r, c = self._cell(parts, z[:, t], h)
            steps.append((z[:, t], h, u, r, c))
            h = new
            hs.append(h)
        hs = np.stack(hs, 1)
        return hs @ parts[4] + parts[5], (steps, hs)

    def back(self, theta: np.ndarray, tape, d: np.ndarray) -> np.ndarray:
        steps, hs = tape
        wx, wg, wc, _, wo, _ = self._parts(theta)
        g = [np.zeros(s) for s in self.shapes]
        g[4] = np.einsum("bth,bto->ho", hs, d)
        g[5] = d.sum((0, 1))
        from_out, dh, n = d @ wo.T, np.zeros((len(d), self.hidden)), self.hidden
        for t in range(len(steps) - 1, -1, -1):
            x, h, u, r, c = steps[t]
            dh = dh + from_out[:, t]
            dc = dh * (1 - u) * (1 - c * c)
            drh = dc @ wc.T
            dgates = np.concatenate([dh * (h - c) * u * (1 - u), drh * h * r * (1 - r)], 1)
            dpre = np.concatenate([dgates, dc], 1)
            g[0] += x.T @ dpre
            g[1] += h.T @ dgates
            g[2] += (r * h).T @ dc
            g[3] += dpre.sum(0)
            dh = dh * u + drh * r + dgates @ wg.T
        return np.concatenate([v.ravel() for v in g])


class Dilated(_Predictor):
    """Causal convolutions whose taps lie 1, 2, 4, ... frames apart, and a linear read-out; a mean depends on the last ``seen`` frames."""

    def __init__(self, dim: int, hidden: int = 32, layers: int = 3, taps: int = 3):
        self.dim, self.hidden, self.taps = dim, hidden, taps
        self.widths = [dim, *[hidden] * layers]
        self.seen = 1 + (taps - 1) * (2**layers - 1)
        self.shapes = [s for a, b in zip(self.widths, self.widths[1:]) for s in ((taps, a, b), (b,))] + [(hidden, 2 * dim), (2 * dim,)]
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    _parts = Recurrent._parts

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(size=s) * ((2 / (s[0] * s[1])) ** 0.5 if len(s) == 3 else 0)).ravel() for s in self.shapes])

    def begin(self) -> np.ndarray:
        return np.zeros((0, self.dim))

    def advance(self, theta: np.ndarray, state: np.ndarray, z: np.ndarray):
        state = np.concatenate([state, z[None]])[-self.seen :]
        mean, log_s = self._told(self.run(theta, state[None])[0][0, -1])
        return state, mean, log_s

    def _shifted(self, x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by < x.shape[1]:
            out[:, by:] = x[:, : x.shape[1] - by]
        return out

    def run(self, theta: np.ndarray, z: np.ndarray):
        parts, x, inputs = self._parts(theta), z, []
        for k in range(len(self.widths) - 1):
            inputs.append(x)
            y = sum(self._shifted(x, j * 2**k) @ parts[2 * k][j] for j in range(self.taps)) + parts[2 * k + 1]
            x = np.maximum(y, 0)
        return x @ parts[-2] + parts[-1], (inputs, x)

    def back(self, theta: np.ndarray, tape, d: np.ndarray) -> np.ndarray:
        inputs, last = tape
        parts = self._parts(theta)
        g = [np.zeros(s) for s in self.shapes]
        g[-2], g[-1] = np.einsum("bth,bto->ho", last, d), d.sum((0, 1))
        dx, after = d @ parts[-2].T, last
        for k in range(len(inputs) - 1, -1, -1):
            dy, x = dx * (after > 0), inputs[k]
            g[2 * k + 1] = dy.sum((0, 1))
            dx = np.zeros_like(x)
            for j in range(self.taps):
                by = j * 2**k
                g[2 * k][j] = np.einsum("bti,bto->io", self._shifted(x, by), dy)
                if by < x.shape[1]:
                    dx[:, : x.shape[1] - by] += dy[:, by:] @ parts[2 * k][j].T
            after = x
        return np.concatenate([v.ravel() for v in g])


class SoftStates:
    """A network whose softmax assigns a row to states softly."""

    def __init__(self, dim: int, states: int, hidden: int = 32):
        self.dim, self.states = dim, states
        self.net = Mlp((dim, hidden, hidden, states), "tanh")
        self.size = self.net.size

    def start(self, seed: int = 0) -> np.ndarray:
        return self.net.start(np.random.default_rng(seed))

    def forward(self, theta: np.ndarray, x: np.ndarray):
        out, tape = self.net.forward(theta, x)
        e = np.exp(out - out.max(1, keepdims=True))
        chi = e / e.sum(1, keepdims=True)
        return chi, (tape, chi)

    def back(self, theta: np.ndarray, tape, d: np.ndarray) -> np.ndarray:
        tape, chi = tape
        return self.net.backward(theta, tape, chi * (d - (d * chi).sum(1, keepdims=True)))[1]
