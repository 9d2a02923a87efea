import itertools

import numpy as np
import pyarrow as pa

from lagfold.llm import quality, toxicity
from lagfold.llm.text import Words, buffers


def test_words_and_hashes():
    texts = ["Ab  cd\n", None, "", " ab\x0bCD x", "é É"]
    w = Words(*buffers(pa.array(texts)))
    assert w.counts().tolist() == [2, 0, 0, 3, 2]
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[5] != h[6]
    sliced = pa.array(["zz", *texts])[1:]
    assert (Words(*buffers(sliced)).hashes() == h).all()
    big = "q" * 200_000
    long = Words(*buffers(pa.array([big + " a", "b " + big])))
    assert long.hashes()[0] == long.hashes()[3] and long.hashes()[0] != long.hashes()[1]


def test_features_by_brute_force():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["Aa", "bb!", "c|", "d#", "9"], n)) for n in range(0, 30)] + [None, "", "  "]
    x = quality.features(pa.array(texts))
    for t, row in zip(texts, x):
        ws = (t or "").lower().split()
        n = max(len(ws), 1)
        assert np.isclose(row[0], np.log1p(len(ws))) and np.isclose(row[8], len(set(ws)) / n)
        assert np.isclose(row[1], (t or "").count("#") / n) and np.isclose(row[9], sum(a == b for a, b in zip(ws, ws[1:])) / n)
        tri = list(zip(ws, ws[1:], ws[2:]))
        assert np.isclose(row[10], (len(set(tri)) / len(tri) if tri else 1.0) * (len(ws) > 0))


def test_all_features_by_brute_force():
    texts = ["Abc def! abc abc 12 #tag |x| Été.\nEnd? ok; no: {a}", "one", "a a a a", "Ü ü\n\nz", " \n ", "", None, "x1 y2 z3 x1 y2 z3"]
    x = quality.features(pa.array(texts))
    for t, row in zip(texts, x):
        raw = (t or "").encode()
        ws = (t or "").encode().lower().split()
        if not ws:
            assert not row.any()
            continue
        n = len(ws)
        share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / n
        upper, lower, high = (sum(f(b) for b in raw) for f in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: b >= 0xC0))
        tri = list(zip(ws, ws[1:], ws[2:]))
        want = [np.log1p(n), share(b"#$%&*+/<=>@[\\]^_`{}~"), share(b"|"), upper / max(upper + lower + high, 1), share(b"!"), share(b"0123456789"), high / len(raw), sum(map(len, ws)) / n, len(set(ws)) / n,
                sum(a == b for a, b in zip(ws, ws[1:])) / n, len(set(tri)) / len(tri) if tri else 1.0, share(b".?;:"), share(b"\n"), max(map(ws.count, ws)) / n]
        assert np.allclose(row, want, atol=1e-6), (t, row, want)


def test_scores_are_sums_of_bins():
    rng = np.random.default_rng(5)
    x = rng.random((500, 4)).astype(np.float32)
    m = quality.fit_gam(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=20, pair_rounds=10)
    for row, got in zip(x[:50], m.raw(x[:50])):
        total = m.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, m.edges, m.tables))
        total += sum(t[sum(row[a] >= e for e in m.coarse[a]), sum(row[b] >= e for e in m.coarse[b])] for (a, b), t in zip(m.pairs, m.pair_tables))
        assert np.isclose(total, got)


def test_windows_by_brute_force():
    lex = toxicity.Lexicon([b"idiot", b"scum"], [b"moro"], [b"moron"])
    rng = np.random.default_rng(6)
    pool = ["idiot", "idoit", "scum", "scam", "morons", "mron", '"hm', 'so"', "said", "fine", "«oui»", "day", "“no”", "word"]
    texts = [" ".join(rng.choice(pool, int(rng.integers(0, 40)))) for _ in range(80)]
    got = toxicity.Scanner(lex).inputs(pa.array(texts))
    marks = lambda ws: sum(w.count(c) for w in ws for c in '"«»“”„')
    for t, row in zip(texts, got):
        ws = t.split()
        own = [toxicity.bare(w.encode()) for w in ws]
        kind = [8 if w.decode() in toxicity.REPORTING else lex.match(w) for w in own]
        out = np.zeros(6)
        for i, k in enumerate(kind):
            if not 0 < k < 8:
                continue
            lo, hi = max(0, i - toxicity.WINDOW), min(len(ws), i + toxicity.WINDOW + 1)
            before, after, told = marks(ws[lo : i + 1]), marks(ws[i:hi]), 8 in kind[lo:hi]
            quoted = (before > 0 and after > 0) or (told and before + after > 0)
            out[3 if quoted else {1: 0, 2: 1, 4: 2}[k]] += 1
            out[4] += (not quoted) / len(ws)
            out[5] += 0 if quoted else sum(0 < x < 8 for x in kind[lo:hi])
        out[[0, 1, 2, 3, 5]] = np.log1p(out[[0, 1, 2, 3, 5]])
        assert np.allclose(row, out), t


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_gam(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9 and (0, 1) in m.pairs
    assert quality.fit_gam(x[:0], y[:0]).score(x)[0] > 0.99


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def test_automaton_by_brute_force():
    terms, stems = [b"abcab", b"bbaca", b"ab"], [b"ccc"]
    lex = toxicity.Lexicon(terms, stems)
    for n in range(1, 8):
        for w in itertools.product(b"abc", repeat=n):
            w = bytes(w)
            want = 1 if w in terms else 2 if w.startswith(b"ccc") else 4 if any(edits(w, t) <= 1 for t in terms if len(t) >= 5) else 0
            assert lex.match(w) == want, w


def test_quoted_hits_count_apart():
    s = toxicity.Scanner(toxicity.Lexicon([b"idiot"], []))
    x = s.inputs(pa.array(["you idiot go", 'he said "idiot" to me', "idoit iddiot", None, "", "fine words"]))
    assert x[0, 0] > 0 and x[0, 3] == 0 and x[1, 3] > 0 and x[1, 0] == 0 and x[2, 2] > 0 and not x[3:].any()


def corpus(spark):
    good = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 40)), 1, 0) for i in range(160)]
    bad = [(1000 + i, "SPAM!! " * 30 + f"x{i}", 0, 0) for i in range(60)]
    tox = [(2000 + i, " ".join(f"w{(i * k) % 97}" for k in range(1, 30)) + " you scumbag", 1, 1) for i in range(60)]
    rows = good + bad + tox
    docs = spark.createDataFrame([(a, b, "x") for a, b, *_ in rows] + [(5001, None, None), (5002, "", ""), (None, "w1 w2", ""), (1, good[1][1], "dup")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(a, q, t) for a, _, q, t in rows] + [(5001, None, None), (9999, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_frames(spark):
    docs, labels = corpus(spark)
    q = {(r.doc_id, r.score): r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(r.predicted == 0 for r in q.values() if r.doc_id and 1000 <= r.doc_id < 1060) and all(r.predicted == 1 for r in q.values() if r.doc_id and r.doc_id < 160)
    m = toxicity.fit(docs, labels)
    assert b"scumbag" in m.words
    t = toxicity.score(docs, m).collect()
    assert len(t) == docs.count() and all(r.predicted == (1 if r.doc_id and 2000 <= r.doc_id < 2060 else 0) for r in t)
    none = labels.limit(0)
    assert quality.score(docs, quality.fit(docs, none)).where("predicted = 0").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("predicted = 1").count() == 0
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0
