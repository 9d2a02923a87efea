import random

from lagfold.llm.decontaminate import contained


def brute(docs, items, t=0.8):
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, it in items:
            v = (it or "").lower().split()
            n = min(5, len(v))
            g = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            x = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if g and d is not None and i is not None and len(g & x) >= t * len(g) - 1e-9:
                out.add((d, i, len(g & x)))
    return out


def corpus():
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.choice([1, 3, 5, 9, 20, 40, 70])))) for i in range(25)]
    docs = []
    for d in range(60):
        words = [f"v{r.randrange(400)}" for _ in range(r.choice([0, 4, 50, 900]))]
        for _, it in r.sample(items, 2):
            part = it.split()
            if len(part) > 8 and r.random() < 0.6:
                part[r.randrange(len(part))] = "zz"
            at = r.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, "\n ".join(words)))
    docs += [(70, None), (71, ""), (72, docs[0][1]), (0, docs[0][1]), (None, docs[1][1])]
    return docs, items + [(90, None), (91, " "), (92, items[3][1].upper()), (None, "x y")]


def test_by_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id long")
    for size in (1 << 20, 0):  # with and without broadcasts
        got = contained(d, i, broadcast_bytes=size).collect()
        assert {(r.doc_id, r.item_id, r.common) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items))
    assert contained(d.limit(0), i).count() == 0 and contained(d, i.limit(0)).count() == 0
