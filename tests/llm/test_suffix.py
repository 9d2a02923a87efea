from collections import defaultdict

import numpy as np
import pytest

from lagfold.llm import suffix


def test_minimisers_by_brute_force():
    rng = np.random.default_rng(0)
    for n in (3, 7, 40, 200):
        for w in (1, 2, 5, 7):
            x = rng.integers(0, 9, n).astype(np.uint64)
            want = {max(j for j in range(i, i + w) if x[j] == x[i : i + w].min()) for i in range(n - w + 1)}
            assert set(suffix.minimisers(x, w).tolist()) == want


def corpus():
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    passages = [word(n) for n in (50, 51, 80, 120, 49)]
    rows = []
    for i in range(60):
        t = word(int(rng.integers(0, 150)))
        for p in rng.choice(5, int(rng.integers(0, 3)), replace=False):
            t += passages[p] + word(int(rng.integers(0, 20)))
        rows.append((i, " ".join(t)))
    long = word(70)
    rows += [(100, " ".join(long + word(5) + long)), (101, "\n".join(rows[3][1].upper().split()) + "\n"), (102, None), (103, ""), (104, " ".join(["q"] * 90)), (3, rows[3][1])]
    return rows


def coverage(rows, within=False, least=50):
    """Word places under a run of ``least`` words that occurs at several places, or only in several different texts."""
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple((t or "").lower().split()), []).append(i)
    where = defaultdict(set)
    for ws in texts:
        for k in range(len(ws) - least + 1):
            where[ws[k : k + least]].add((ws, k))
    cover = defaultdict(set)
    for places in where.values():
        if len(places if within else {ws for ws, _ in places}) > 1:
            for ws, k in places:
                cover[ws].update(range(k, k + least))
    return texts, cover


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("rows_in_task", [60_000, 40])
def test_spans_by_brute_force(spark, monkeypatch, rows_in_task, within):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (True, rows_in_task))
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, d string, n_chars long")
    got = suffix.repeats(df, within=within).collect()
    texts, cover = coverage(rows, within)
    _, others = coverage(rows, False)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.id].append(r)
    for ws, ids in texts.items():
        if len(ids) > 1 and len(ws) >= 50:
            assert all(len(by_id[i]) and by_id[i][0].spans[0] == (0, len(ws)) for i in set(ids))
        elif cover[ws]:
            have = {k for s in by_id[ids[0]][0].spans for k in range(s.start, s.end)}
            assert have == cover[ws], (ids, sorted(have ^ cover[ws])[:5])
            assert by_id[ids[0]][0].shared == bool(others[ws])
        else:
            assert ids[0] not in by_id
    if rows_in_task > 40 or within:
        return
    left = suffix.without_repeats(df, length_col="n_chars").collect()
    assert all(r.n_chars in (0, len(r.text or '')) for r in left)
    rest = [(r.doc_id, r.text) for r in left]
    kept_words = [tuple((t or "").lower().split()) for _, t in rest]
    # every repeated 50-word run is still there, and in one place
    runs = defaultdict(int)
    for ws in kept_words:
        for k in range(len(ws) - 49):
            runs[ws[k : k + 50]] += 1
    assert max(n for run, n in runs.items() if len(set(run)) > 1) <= 2
    before = {ws[k : k + 50] for ws in texts for k in range(len(ws) - 49)}
    lost = before - set(runs)
    unique = {run for run in before if sum(run == ws[k : k + 50] for ws in texts for k in range(len(ws) - 49)) > 1}
    assert not (lost & unique)


def check_groups(spark, shared):
    """Documents of groups that share ``shared`` words (before, after) one frequent line of 40: spans and what is removable, by brute force."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 50_000, n)]
    line, rows = word(40), []
    for before, after in shared:
        a, b = word(before), word(after)
        rows += [" ".join(word(30) + a + line + b + word(30)) for _ in range(2)]
    rows = [(i, rows[k]) for i, k in enumerate(rng.permutation(len(rows)).tolist())]
    got = {r.id: r for r in suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts, cover = coverage(rows, True)
    words = lambda spans: {k for s in spans for k in range(s.start, s.end)}
    seen = set()
    for ws, ids in texts.items():
        runs = [ws[k : k + 50] for k in range(len(ws) - 49)]
        assert words(got[ids[0]].spans) == cover[ws]
        assert words(got[ids[0]].removable) == {j for k, run in enumerate(runs) if run in seen for j in range(k, k + 50)}
        seen.update(runs)


def test_groups_behind_one_line(spark):
    check_groups(spark, [(15, 0)] * 60 + [(0, 15)] * 30 + [(6, 6)] * 60)


def test_groups_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (True, 5))
    check_groups(spark, [(0, 10)] * 60)


@pytest.mark.parametrize("rows_in_task", [60_000, 7])
def test_what_one_text_repeats_is_left_alone(spark, monkeypatch, rows_in_task):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (True, rows_in_task))
    line = [f"l{k}" for k in range(60)]
    rows = [(1, " ".join(line * 3)), (2, " ".join(["q"] * 200)), (3, " ".join([*(f"a{k}" for k in range(60))] * 2)), (4, "x " + " ".join(f"a{k}" for k in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.id: (r.shared, [tuple(x) for x in r.spans], [tuple(x) for x in r.removable]) for r in suffix.repeats(df).collect()}
    assert whole == {1: (False, [(0, 180)], [(109, 180)]), 2: (False, [(0, 200)], [(50, 200)]), 3: (True, [(0, 120)], [(60, 120)]), 4: (True, [(1, 61)], [(1, 61)])}
    got = {r.id: r for r in suffix.repeats(df, within=False).collect()}
    assert sorted(got) == [3, 4] and [tuple(x) for x in got[4].removable] == [(1, 61)] and [tuple(x) for x in got[3].removable] == [(60, 120)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.repeats(df).count() == 0 and suffix.without_repeats(df).count() == 0
