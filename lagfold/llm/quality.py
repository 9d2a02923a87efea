"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting over histograms: each round visits the features in turn, fits a
two-split tree to the gradient over that feature's bins and adds it to the feature's
lookup table; then the strongest pairs of features get two-dimensional tables in the
same way.  A score is the sum of the looked-up bins of a text.

Features depend on the text alone.  Defined cases: null, empty and blank texts have
all-zero features and the score that these get; repeated rows are scored each; without
usable labels of both classes the score is the share of label 1 (1.0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.llm.text import Words, buffers, crc_rest, rolling

#: Most labelled rows that a fit uses, chosen by a hash of doc_id.
FIT_ROWS = 20_000

FEATURES = ("log_words", "symbols", "bars", "upper", "exclaim", "digits", "other_script", "word_length", "distinct", "repeat_next", "distinct_triples", "stops", "lines", "top_word")

_CLASS = np.zeros(256, np.uint8)
for _k, _s in enumerate((b"#$%&*+/<=>@[\\]^_`{}~", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"0123456789", b".?;:", b"\n"), 1):
    _CLASS[np.frombuffer(_s, np.uint8)] = _k
_CLASS[0xC0:] = 8  # one for each character outside ASCII
_CLASS[np.arange(ord("a"), ord("z") + 1)] = 9
_CLASSES = 10


def _by_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the offsets ``of``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[of[1:]] - total[of[:-1]]


def features(column) -> np.ndarray:
    """The feature matrix of a batch of texts."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    step = 2 << 20
    at = 0
    while at < n:  # a few MB at a time
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        out[at:end] = _features(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    words = Words(data, offsets)
    count = words.counts()
    h = words.hashes()
    text = np.repeat(np.arange(n), count)
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * _CLASSES, size) + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    some, letters = np.maximum(count, 1), np.maximum(kinds[:, 3] + kinds[:, 8] + kinds[:, 9], 1)

    def distinct(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different values and the most frequent one's count, by text."""
        key = np.sort((x >> np.uint64(24)) | (of.astype(np.uint64) << np.uint64(40)))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        owner = (key[new] >> np.uint64(40)).astype(np.int64)
        top = np.zeros(n)
        np.maximum.at(top, owner, np.diff(np.concatenate([new, [len(key)]])))
        return np.bincount(owner, minlength=n), top

    one, top = distinct(h, text)
    same = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) if len(h) else np.zeros(0, bool)
    inside = text[2:] == text[:-2] if len(h) > 2 else np.zeros(0, bool)
    three, _ = distinct(rolling(h, 3)[inside], text[:-2][inside]) if inside.any() else (np.zeros(n), None)
    triples = np.maximum(count - 2, 0)
    bytes_in = np.maximum(size, 1)
    some_words = (count > 0)[:, None]
    return some_words * np.stack([
        np.log1p(count), kinds[:, 1] / some, kinds[:, 2] / some, kinds[:, 3] / letters, kinds[:, 4] / some, kinds[:, 5] / some, kinds[:, 8] / bytes_in,
        _by_text(words.ends - words.starts, words.of) / some, one / some, np.bincount(text[1:][same], minlength=n) / some,
        np.where(triples > 0, three / np.maximum(triples, 1), 1.0), kinds[:, 6] / some, kinds[:, 7] / some, top / some,
    ], axis=1)


@dataclass
class Gam:
    """Lookup tables of single features and of pairs; plain arrays, a few kB."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, k], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            total += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _quantile_edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow(g: np.ndarray, w: np.ndarray, splits: int, smooth: float) -> np.ndarray:
    """Leaf values by bin of a tree with ``splits`` splits, grown greedily on gradient and weight sums."""
    cuts = [0, len(g)]
    sg, sw = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(w)])
    gain_of = lambda a, b: (sg[b] - sg[a]) ** 2 / (sw[b] - sw[a] + smooth)
    for _ in range(splits):
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = gain_of(a, c) + gain_of(c, b) - gain_of(a, b)
                if gain.max() > best:
                    best, where = gain.max(), int(c[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (sg[b] - sg[a]) / (sw[b] - sw[a] + smooth)
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.2, bins: int = 32, pairs: int = 4, pair_rounds: int = 60, smooth: float = 2.0) -> Gam:
    """Fit by cyclic boosting of the logistic loss (Newton steps)."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Gam(float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))
    d = x.shape[1]
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))), [_quantile_edges(x[:, k], bins) for k in range(d)], coarse=[_quantile_edges(x[:, k], 8) for k in range(d)])
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(d):
            g, w = residual()
            n = len(model.tables[k])
            step = rate * _shallow(np.bincount(at[k], g, n), np.bincount(at[k], w, n), 2, smooth)
            model.tables[k] += step
            total += step[at[k]]
    small = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.coarse)]
    g, w = residual()

    def strength(a: int, b: int) -> float:
        key, n = small[a] * (len(model.coarse[b]) + 1) + small[b], (len(model.coarse[a]) + 1) * (len(model.coarse[b]) + 1)
        return float((np.bincount(key, g, n) ** 2 / (np.bincount(key, w, n) + smooth)).sum())

    model.pairs = sorted(((a, b) for a in range(d) for b in range(a + 1, d)), key=lambda p: -strength(*p))[:pairs]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for r in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, w = residual()
            shape = model.pair_tables[k].shape
            key = small[a] * shape[1] + small[b]
            gs, ws = (np.bincount(key, v, shape[0] * shape[1]).reshape(shape) for v in (g, w))
            # a shallow tree: one split of the one feature, then of the other within either side
            first = _shallow(gs.sum(1 - r % 2), ws.sum(1 - r % 2), 1, smooth)
            side = first == first[0]
            step = np.zeros(shape)
            for part in (side, ~side):
                if part.any():
                    rows = (part, slice(None)) if r % 2 == 0 else (slice(None), part)
                    line = _shallow(gs[rows].sum(r % 2), ws[rows].sum(r % 2), 1, smooth)
                    step[rows] = line[None, :] if r % 2 == 0 else line[:, None]
            model.pair_tables[k] += rate * step
            total += rate * step[small[a], small[b]]
    return model


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _text, _y)`` of at most ``rows`` labelled documents outside the held-out part, chosen by a hash of the id; one row for each id (the smallest text)."""
    picked = labels.select(labels[id_col].alias("_id"), labels[target].cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (crc_rest("_id", modulus) != held))
    picked = picked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    met = texts.join(F.broadcast(picked), "_id")  # at most ``rows`` ids
    return met.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", modulus: int = 4, held: int = 2, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Learn from the labelled rows whose crc32(id) mod ``modulus`` is not ``held``."""
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches):
        for b in batches:
            x = features(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["y", "x"])

    got = labelled(docs, labels, target, modulus, held, rows, id_col, text_col).select("_text", "_y").mapInArrow(run, schema).toArrow()
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # the same model however the rows came
    return fit_gam(x[order], y[order])


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score`` and ``predicted`` of each row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            s = model.score(features(b.column("_text")))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
