"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learnt from labelled texts: whole words and word stems that occur
almost only in toxic texts.  One automaton reads a word's bytes and follows, in the
lexicon's trie, every node within one edit; its states are built when first met and
kept, so most words end after a few table look-ups.  Words of a stem's family are in the
trie for their misspellings only; terms of fewer than five letters are matched exactly, as
one edit of them is too often another word.  Each hit is weighed in a window of
words: quotation marks and reporting words near it turn it into a quoted hit.  A
logistic model over the hit counts gives the score.

Defined cases: null, empty and blank texts have no hit and get the score of clean
texts; repeated rows are scored each; without labels of both classes the score is the
share of label 1 (0.0 without labels).  Names are never inputs but for the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.llm.quality import labelled
from lagfold.llm.spark import cut, release
from lagfold.llm.text import Words, buffers

FIT_ROWS = 20_000
STEMS = range(3, 9)
WINDOW = 6
_QUOTES = np.zeros(256, bool)
_QUOTES[[0x22]] = True
#: Words that introduce somebody else's words.
REPORTING = ("said", "says", "called", "quote", "quoted", "wrote", "word", "term", "slur", "dit", "mot", "sagte", "wort", "dijo", "palabra")
INPUTS = ("exact", "stem", "near", "quoted", "density", "context")


class Lexicon:
    """A trie of terms (whole words) and stems, and the automaton of words within one edit of a term or of ``near``."""

    def __init__(self, words: list[bytes], stems: list[bytes], near: list[bytes] = (), fuzzy_from: int = 5):
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [0]  # 1: a term ends here; 2: a stem does; 4: a term long enough for an edit does
        for term, mark in [*((w, 1 | 4 * (len(w) >= fuzzy_from)) for w in words), *((s, 2) for s in stems), *((w, 4 * (len(w) >= fuzzy_from)) for w in near)]:
            node = 0
            for b in term:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.ends.append(0)
                node = self.next[node][b]
            self.ends[node] |= mark
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[int, int]] = []
        self.members: list[frozenset] = []
        self.kind: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The automaton's state for these (trie node, edits) pairs; a letter of the term may be left out for one edit."""
        full = set(pairs)
        for node, e in pairs:
            if e == 0:
                full |= {(child, 1) for child in self.next[node].values()}
        key = frozenset((n, e) for n, e in full if e == 0 or (n, 0) not in full)
        if (found := self.states.get(key)) is not None:
            return found
        self.states[key] = k = len(self.members)
        self.members.append(key)
        self.moves.append({})
        kind = 0
        for n, e in key:
            if e == 0 and self.ends[n] & 1:
                kind |= 1
            if e == 0 and self.ends[n] & 2:
                kind |= 2
            if e == 1 and self.ends[n] & 4:
                kind |= 4
        self.kind.append(kind)
        return k

    def _move(self, state: int, b: int) -> int:
        out = set()
        for node, e in self.members[state]:
            child = self.next[node].get(b)
            if child is not None:
                out.add((child, e))
            if e == 0:
                out.add((node, 1))  # a letter too many
                out |= {(c, 1) for c in self.next[node].values()}  # another letter
        k = self.moves[state][b] = self._state(out) if out else -1
        return k

    def match(self, word: bytes) -> int:
        """1: a term; 2: begins with a stem; 4: within one edit of a term; 0: none."""
        state, moves, stem = self.start, self.moves, 0
        for b in word:
            to = moves[state].get(b)
            state = self._move(state, b) if to is None else to
            if state < 0:
                return 2 if stem else 0
            stem |= self.kind[state] & 2
        kind = self.kind[state]
        return 1 if kind & 1 else 2 if stem else 4 if kind & 4 else 0


_EDGE = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def bare(word: bytes) -> bytes:
    """A word in lower case (Latin-1 capitals of UTF-8 too) without punctuation at its ends."""
    word = word.strip(_EDGE)
    if word.isascii():
        return word.lower()
    return word.decode("utf-8", "replace").lower().strip("«»“”„‘’…¡¿").encode()


class Scanner:
    """Counts the hits of texts; the class of a word is kept by its hash."""

    def __init__(self, lexicon: Lexicon, most: int = 500_000):
        self.lexicon, self.most = lexicon, most
        self.hash = np.zeros(0, np.uint64)
        self.kind = np.zeros(0, np.uint8)
        self.reporting = {w.encode() for w in REPORTING}

    def classes(self, words: Words) -> np.ndarray:
        """Of each word: as Lexicon.match; 8 for a reporting word."""
        h = words.hashes()
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        kind = np.zeros(len(own), np.uint8)
        at = np.searchsorted(self.hash, own)
        known = np.zeros(len(own), bool)
        ok = at < len(self.hash)
        known[ok] = self.hash[at[ok]] == own[ok]
        kind[known] = self.kind[at[known]]
        raw = words.data.tobytes() if not known.all() else b""
        for k in np.flatnonzero(~known):
            i = first[k]
            w = bare(raw[words.starts[i] : words.ends[i]])
            kind[k] = 8 if w in self.reporting else self.lexicon.match(w)
        if not known.all():
            if len(self.hash) > self.most:
                self.hash, self.kind = own, kind
            else:
                self.hash = np.concatenate([self.hash, own[~known]])
                self.kind = np.concatenate([self.kind, kind[~known]])
                order = np.argsort(self.hash)
                self.hash, self.kind = self.hash[order], self.kind[order]
        return kind[back]

    def inputs(self, column) -> np.ndarray:
        data, offsets = buffers(column)
        n = len(offsets) - 1
        out = np.zeros((n, len(INPUTS)))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), "right")) - 1)
            out[at:end] = self._inputs(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
        return out

    def _inputs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        words = Words(data, offsets)
        kind = self.classes(words)
        text = np.repeat(np.arange(n), words.counts())
        hit = np.flatnonzero((kind > 0) & (kind < 8))
        out = np.zeros((n, len(INPUTS)))
        if not len(hit):
            return out
        # context: quotation marks (also the typographic ones) and reporting words among the words around, within the text
        mark = _QUOTES[data].astype(np.int64)
        three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & ((data[2:] == 0x9C) | (data[2:] == 0x9D) | (data[2:] == 0x9E))) if len(data) > 2 else []
        two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))) if len(data) > 1 else []
        mark[three] += 1
        mark[two] += 1
        marks = np.concatenate([[0], np.cumsum(mark)])
        reports = np.concatenate([[0], np.cumsum(kind == 8)])
        hits = np.concatenate([[0], np.cumsum((kind > 0) & (kind < 8))])
        lo = np.maximum(hit - WINDOW, words.of[text[hit]])
        hi = np.minimum(hit + WINDOW + 1, words.of[text[hit] + 1])
        before = marks[words.ends[hit]] - marks[words.starts[lo]]
        after = marks[words.ends[hi - 1]] - marks[words.starts[hit]]
        told = reports[hi] - reports[lo]
        quoted = ((before > 0) & (after > 0)) | (told > 0) & (before + after > 0)
        crowd = hits[hi] - hits[lo] - 1
        own = text[hit]
        for k, v in ((0, (kind[hit] == 1) & ~quoted), (1, (kind[hit] == 2) & ~quoted), (2, (kind[hit] == 4) & ~quoted), (3, quoted), (5, np.where(quoted, 0, 1 + crowd))):
            out[:, k] = np.bincount(own, v, n)
        out[:, 4] = np.bincount(own, ~quoted, n) / np.maximum(words.counts(), 1)
        out[:, [0, 1, 2, 3, 5]] = np.log1p(out[:, [0, 1, 2, 3, 5]])
        return out


def _terms(sample: DataFrame) -> DataFrame:
    """``(term, stem, bad, good)``: in how many texts of either label each word, and each beginning of a word, occurs."""

    def run(batches):
        seen: dict[tuple[bytes, bool], list[int]] = {}

        def flush():
            keys = list(seen)
            counts = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(counts[:, 1]), pa.array(counts[:, 0])], ["term", "stem", "bad", "good"])

        for b in batches:
            for t, y in zip(b.column("_text"), b.column("_y").to_pylist()):
                own = {w for w in map(bare, {*(t.as_py() or "").encode().split()}) if len(w) > 2}
                stems = set()
                for w in own:
                    u = w.decode("utf-8", "ignore")
                    stems.update(u[:k].encode() for k in STEMS if len(u) > k)
                for terms, stem in ((own, False), (stems, True)):
                    for w in terms:
                        seen.setdefault((w, stem), [0, 0])[y] += 1
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    counted = sample.select("_text", "_y").mapInArrow(run, "term binary, stem boolean, bad long, good long")
    return counted.groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn_lexicon(sample: DataFrame, toxic: int, total: int, share: float = 0.9) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(words, stems, words under a stem) of whose texts at least ``share`` are toxic; counted by Spark, only the chosen ones come here.

    A word must be in so many toxic texts (three at least) that chance alone would give ten such words at most.  A stem
    replaces its words where it is as pure and occurs in more toxic texts than any of them.
    """
    terms = cut(_terms(sample))
    texts = F.col("bad") + F.col("good")
    words_in = {int(r.n): int(r["count"]) for r in terms.where(~F.col("stem") & (texts <= 20)).groupBy(texts.alias("n")).count().collect()}
    by_chance = lambda n: sum(words_in.get(m, 0) * (toxic / total) ** m for m in range(n, 21))  # noqa: E731  words in n or more texts, all toxic
    least = next((n for n in range(3, 20) if by_chance(n) <= 10), 20)
    pure = F.col("bad") >= share * (F.col("bad") + F.col("good"))
    strong = terms.where(~F.col("stem") & (F.col("bad") >= least) & pure & (F.ln("bad") > 0.4 * F.log1p("good")))
    bad = {bytes(r.term): int(r.bad) for r in strong.orderBy(F.desc("bad"), "term").collect()}  # bounded by the labelled rows, as each is in ``least`` of them or more
    many = max(15, int(0.01 * toxic))
    whole = terms.where(F.col("stem") & (F.col("bad") >= many) & pure & (F.col("good") <= 0.02 * F.col("bad")))
    found = sorted(((bytes(r.term), int(r.bad)) for r in whole.orderBy(F.desc("bad"), "term").collect()), key=lambda x: (len(x[0]), x[0]))
    release(terms)
    stems: list[bytes] = []
    for s, n in found:
        under = [c for w, c in bad.items() if w.startswith(s)]
        if len(under) >= 3 and n > 1.3 * max(under) and not any(s.startswith(o) for o in stems):
            stems.append(s)
    near = [w for w in bad if any(w.startswith(s) for s in stems)]
    return [w for w in bad if w not in set(near)], stems, near


@dataclass
class ToxicityModel:
    words: list[bytes]
    stems: list[bytes]
    near: list[bytes]
    weights: np.ndarray
    base: float

    def scanner(self) -> Scanner:
        return Scanner(Lexicon(self.words, self.stems, self.near))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.base, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps with a ridge penalty; the base isn't penalised."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", modulus: int = 3, held: int = 1, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from at most ``rows`` labelled rows whose crc32(id) mod ``modulus`` is not ``held``."""
    sample = cut(labelled(docs, labels, target, modulus, held, rows, id_col, text_col))
    count = {r._y: int(r["count"]) for r in sample.groupBy("_y").count().collect()}
    toxic, total = count.get(1, 0), sum(count.values())
    if toxic in (0, total):
        share = toxic / total if total else 0.0
        return ToxicityModel([], [], [], np.zeros(len(INPUTS)), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))
    model = ToxicityModel(*learn_lexicon(sample, toxic, total), np.zeros(len(INPUTS)), 0.0)

    def run(batches):
        scanner = model.scanner()
        for b in batches:
            x = scanner.inputs(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "x"])

    got = sample.select("_text", "_y").mapInArrow(run, "y int, x array<double>").toArrow()  # a few numbers for each of at most ``rows`` rows
    release(sample)
    x, y = np.array(got["x"].to_pylist()).reshape(-1, len(INPUTS)), got["y"].to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # the same model however the rows came
    model.weights, model.base = fit_logistic(x[order], y[order])
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score`` and ``predicted`` of each row."""
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        scanner = model.scanner()
        for b in batches:
            s = model.score(scanner.inputs(b.column("_text")))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return source.mapInArrow(run, schema)
