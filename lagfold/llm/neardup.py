"""MinHash near-dedup by BagMinHash.

A text is the multiset of its 5-word shingles.  Each unit of weight of a shingle has a
Poisson process of points in time; the weights (0,1], (1,2], (2,4], (4,8] ... form a
hierarchy in which a point's place within its interval is drawn by its own hash, so
texts with different counts of a shingle share the points of their common weight.  A
point falls to one of ``m`` components and the first of each is the signature; two
components are equal with the probability of the weighted Jaccard similarity.

Signatures are banded.  In each bucket the members are verified (exact multiset overlap)
against a leader, the member with the least share of shingles that no other text has.
Verified links make classes.  In a bucket that still holds several classes, two members of
different classes are a candidate pair unless an upper bound of their overlap (shingles
of their own, counts of the others in hash cells) excludes it or they have met in an
earlier band.  Members meet in blocks that hold their shingles; there candidates are
verified a few for each member at a time, those with the highest bound first, and go where
their classes have met: so no link between different classes is lost, few within one are
looked at, and only links that join classes leave a block.  Texts with equal word sequences
are one from the start.

Defined cases: a text without words (null, empty, blank) is a class of its own, under its
own id; repeated rows are copies of each other; a text of 1 to 4 words is one shingle; a
null id is no smallest id unless all ids of the class are null; columns other than the two
named ones are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.llm.spark import components, cut, fresh, release, sized
from lagfold.llm.text import Words, buffers, mix64, shingles, tidy

U = np.uint64
#: Cells of the histograms that bound overlaps; members of a bucket that meet as one block, and about how many shingles they have.
CELLS, BLOCK, CODES = 64, 2048, 1 << 19
_TWO_64 = float(1 << 64)


def _chunks(offsets: np.ndarray, step: int):
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        yield at, end
        at = end


def content_keys(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """128 bits of each word sequence, as an (n, 2) array; zero without words."""
    n = len(of) - 1
    out = np.zeros((n, 2), U)
    some = np.flatnonzero(np.diff(of) > 0)
    if len(some):
        place = np.arange(len(h), dtype=U) - np.repeat(of[:-1], np.diff(of)).astype(U)
        for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            out[some, k] = mix64(np.add.reduceat(mix64(h + place * U(salt)), of[some]))
    return out


def multiset(s: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, count) of the different shingles of each text."""
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])])) if len(s) else np.zeros(0, np.int64)
    return s[new], text[new], np.diff(np.concatenate([new, [len(s)]]))


def bagminhash(s: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) signatures of n multisets given as (shingle, text, weight); zero for empty ones."""
    sig = np.zeros((n, m), U)
    total = np.bincount(text, weight, n)
    extra = 3.0
    while len(s):
        bound = np.zeros(n)
        np.divide(m * (np.log(m) + extra), total, out=bound, where=total > 0)
        first = np.full(n * m, np.inf)
        keys, times, points = [], [], []
        # the process of interval j of a shingle: (0,1] for j=0, (2^(j-1), 2^j] after that
        j = 0
        owner = np.arange(len(s))
        while len(owner):
            rate = 1.0 if j == 0 else float(1 << (j - 1))
            own, clock = owner, np.zeros(len(owner))
            seed = mix64(s[owner] + U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
            nth = 0
            while len(own):
                seed = mix64(seed + U(0xD1B54A32D192ED03))
                clock = clock - np.log((seed.astype(np.float64) + 1.0) / _TWO_64) / rate
                live = clock <= bound[text[own]]
                own, clock, seed = own[live], clock[live], seed[live]
                draw = mix64(seed ^ U(0x2545F4914F6CDD1D))
                inside = slice(None)
                if j > 1:  # the cell of the interval that the point falls into
                    cell = (1 << (j - 1)) + ((draw >> U(40)) % U(1 << (j - 1))).astype(np.int64)
                    inside = cell < weight[own]
                key = text[own[inside]] * m + ((draw[inside] & U(0xFFFFFFFFFF)) % U(m)).astype(np.int64)
                keys.append(key)
                times.append(clock[inside])
                points.append(draw[inside])
                nth += 1
            j += 1
            owner = np.flatnonzero(weight > (1 << (j - 1)) - (j == 0)) if j else owner
        key, time, point = np.concatenate(keys), np.concatenate(times), np.concatenate(points)
        np.minimum.at(first, key, time)
        hit = time == first[key]
        sig.reshape(-1)[key[hit]] = point[hit]
        # a text of which a component has got no point yet is done again with a later bound
        open_ = (~np.isfinite(first.reshape(n, m))).any(1) & (total > 0)
        if not open_.any():
            break
        again = open_[text]
        s, text, weight = s[again], text[again], weight[again]
        total = np.where(open_, total, 0)
        extra += 4
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    n, m = sig.shape
    rows = m // bands
    out = np.tile(mix64(np.arange(1, bands + 1, dtype=U)), (n, 1))
    for r in range(rows):
        out = mix64(out * U(0xD6E8FEB86659FD93) + sig[:, r::rows][:, :bands])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, size: int) -> DataFrame:
    """``(id, k, n, bands)``: the content key (16 bytes), the number of shingles and the band keys."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("k", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("_text"))
            for at, end in _chunks(offsets, 1 << 20):
                w = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                h = w.hashes()
                s, text = shingles(h, w.of, size)
                sig = bagminhash(*multiset(s, text), end - at, bands * rows)
                keys = band_keys(sig, bands)
                yield pa.RecordBatch.from_arrays([
                    b.column("_id").slice(at, end - at), pa.array([x.tobytes() for x in content_keys(h, w.of)], pa.binary()),
                    pa.array(np.bincount(text, minlength=end - at)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64())),
                ], ["id", "k", "n", "bands"])
        tidy()

    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """``(k, codes)`` of the column ``_text``: the content key and a 64-bit code of each shingle and its occurrence number."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("_text"))
            for at, end in _chunks(offsets, 4 << 20):
                w = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                h = w.hashes()
                s, text = shingles(h, w.of, size)
                order = np.lexsort((s, text))
                s, text = s[order], text[order]
                new = np.concatenate([[True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])]) if len(s) else np.zeros(0, bool)
                start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
                codes = mix64(s + (np.arange(len(s)) - start).astype(U) * U(0xD1B54A32D192ED03)).view(np.int64)
                of = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=end - at))]).astype(np.int32)
                keys = pa.array([x.tobytes() for x in content_keys(h, w.of)], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(of), pa.array(codes))], ["k", "codes"])
        tidy()

    return texts.select("_text").mapInArrow(run, "k binary, codes array<bigint>")


def _profiles(sets: DataFrame) -> DataFrame:
    """``(t, n, x, codes)`` of ``(t, codes, own)``: shingles in all, and those that other texts have too (their number and codes)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, min(1024, b.num_rows - at))
                codes, own = part.column("codes"), part.column("own")
                n = np.diff(codes.offsets.to_numpy())
                row, value = np.repeat(np.arange(part.num_rows), n), codes.flatten().to_numpy()
                alone = np.sort(own.flatten().to_numpy())  # each is in one text only, so the value decides
                shared = np.ones(len(value), bool)
                if len(alone):
                    shared = alone[np.minimum(np.searchsorted(alone, value), len(alone) - 1)] != value
                x = np.bincount(row[shared], minlength=part.num_rows)
                of = np.concatenate([[0], np.cumsum(x)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("t"), pa.array(n.astype(np.int64)), pa.array(x.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(of), pa.array(value[shared])),
                ], ["t", "n", "x", "codes"])

    return sets.mapInArrow(run, "t long, n long, x long, codes array<bigint>")


def _verify(pairs: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose multisets' Jaccard similarity is at least ``threshold``."""
    x, y = (profiles.select(F.col("t").alias(c), F.col("codes").alias(f"c{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    common = F.size(F.array_intersect("ca", "cb"))
    return pairs.join(x, "a").join(y, "b").where(common / (F.col("na") + F.col("nb") - common) >= threshold).select("a", "b")


def _most(n, x, m, y):
    """The largest similarity of texts with n and m shingles of which x and y are others' too."""
    return F.least(x, y) / (n - x + m - y + F.greatest(x, y))


def _links(active: DataFrame, texts: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """``(ra, rb)``: roots that pairs of texts in a bucket link, of ``(bucket, band, t, n, x, root, main)``.

    Members outside the bucket's main class meet all others, block by block.  A meeting verifies its pairs
    on the spot and gives a forest of links, so it makes fewer rows than it has members.
    """
    cols = ("t", "n", "x", "root", "bands", "codes")
    side = F.col("root") == F.col("main")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("x") / CODES)).cast("int")
    many = cut(active.groupBy("bucket", side.alias("side")).agg(blocks.alias("blocks")))
    dealt = active.withColumn("side", side).join(sized(many), ["bucket", "side"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    dealt = dealt.join(texts.select("t", "bands"), "t").join(profiles.select("t", "codes"), "t")
    packed = cut(dealt.groupBy("bucket", "band", "side", "block").agg(*[F.collect_list(c).alias(c) for c in cols]))
    rest = many.where("not side").select("bucket", F.col("blocks").alias("rest"))
    left = packed.where("not side").select("bucket", F.col("block").alias("i"), *[F.col(c).alias(f"a_{c}") for c in cols])
    met = packed.join(sized(cut(rest)), "bucket").withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("side"), F.col("rest") - 1).otherwise(F.col("block")))))
    met = met.join(left, ["bucket", "i"]).select("band", *cols, *[f"a_{c}" for c in cols])

    def run(batches):
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names}
            for k in range(b.num_rows):
                u, v = (_Block(*(columns[p + c][k].values for c in cols)) for p in ("a_", ""))
                if len(links := _forest(u, v, columns["band"][k].as_py(), threshold)):
                    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["ra", "rb"])

    links = cut(met.mapInArrow(run, "ra long, rb long").distinct())
    release(many, packed)
    return links


class _Block:
    """Members of a bucket that meet together, from their Arrow lists."""

    def __init__(self, t, n, x, root, bands, codes):
        self.t, self.n, self.x, self.root = (c.to_numpy() for c in (t, n, x, root))
        self.bands = bands.flatten().to_numpy().reshape(len(t), -1)
        self.codes, self.of = codes.flatten().to_numpy(), np.concatenate([[0], np.cumsum(self.x)])
        cell = np.repeat(np.arange(len(t)) * CELLS, self.x) + (self.codes.view(U) & U(CELLS - 1)).astype(np.int64)
        self.cells = np.bincount(cell, minlength=len(t) * CELLS).astype(np.int32).reshape(-1, CELLS)

    def codes_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the members' codes, where each member's begin among them)."""
        size = self.x[some]
        at = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.of[some] - at, size), at


def _open(u: _Block, v: _Block, own: slice, band: int, ru: np.ndarray, rv: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound) of the pairs of ``u[own]`` and ``v`` in different classes that may reach the threshold and share no earlier band, those of an ``i`` by falling bound."""
    n, x = u.n[own, None], u.x[own, None]
    most = np.minimum(x, v.x) / (n - x + v.n - v.x + np.maximum(x, v.x))
    i, j = np.nonzero((most >= threshold - 1e-9) & (ru[own, None] != rv))
    i += own.start
    out = []
    for p in range(0, len(i), 1 << 16):
        a, b = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
        common = np.minimum(u.cells[a], v.cells[b]).sum(1)
        bound = common / (u.n[a] + v.n[b] - common)
        ok = (bound >= threshold - 1e-9) & ~(u.bands[a, :band] == v.bands[b, :band]).any(1)
        out.append((a[ok], b[ok], bound[ok]))
    i, j, bound = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    order = np.lexsort((-bound, i))
    return i[order], j[order], bound[order]


def _forest(u: _Block, v: _Block, band: int, threshold: float, first: int = 4) -> np.ndarray:
    """(links, 2): roots joined by pairs whose similarity is at least ``threshold``, each link between classes that no link before joins.

    A member's pairs are verified ``first`` (then 4 times as many) at a time, those with the highest bound first,
    until all that are left lie within its class.
    """
    names, place = np.unique(np.concatenate([u.root, v.root]), return_inverse=True)
    pu, pv = place[: len(u.t)], place[len(u.t) :]
    now = np.arange(len(names))  # the class of each root
    same, code, links = np.array_equal(u.t, v.t), None, []
    step = max(1, (1 << 20) // len(v.t))
    for at in range(0, len(u.t), step):
        i, j, _ = _open(u, v, slice(at, at + step), band, now[pu], now[pv], threshold)
        if same:
            i, j = i[j > i], j[j > i]
        if not len(i):
            continue
        if code is None:  # codes as small numbers
            code = np.unique(np.concatenate([u.codes, v.codes]), return_inverse=True)[1]
            mine, theirs, marked = code[: len(u.codes)], code[len(u.codes) :], np.zeros(code.max() + 1, bool)
        begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        for s, e in zip(begin, [*begin[1:], len(i)]):
            a, left, many = i[s], j[s:e], first
            own = mine[u.of[a] : u.of[a + 1]]
            marked[own] = True
            while len(left := left[now[pv[left]] != now[pu[a]]]):
                some, left = left[:many], left[many:]
                many *= 4
                codes, starts = v.codes_of(some)
                common = np.add.reduceat(marked[theirs[codes]].astype(np.int64), starts)
                for b in some[common / (u.n[a] + v.n[some] - common) >= threshold]:
                    if (old := now[pv[b]]) != now[pu[a]]:
                        links.append((u.root[a], v.root[b]))
                        now[now == old] = now[pu[a]]
            marked[own] = False
    return np.array(links, np.int64).reshape(-1, 2)


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, size: int) -> tuple[DataFrame, DataFrame]:
    """``(id, k, n)`` of each row, and ``(k, class_id, leads)`` of each text with words; one text of each class leads."""
    base = cut(signatures(docs, id_col, text_col, bands, rows, size))
    number = F.monotonically_increasing_id()
    texts = cut(base.where("n > 0").groupBy("k").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")).withColumn("t", number))
    placed = texts.select("t", F.posexplode("bands").alias("band", "bucket"))
    several = cut(placed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"))
    placed = cut(placed.join(sized(several), "bucket"))
    wanted = cut(texts.join(sized(cut(placed.select("t").distinct())), "t", "left_semi").select("t", "k", "rep"))

    # the texts themselves, by an id that they have and then by content
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    reps = cut(wanted.select(F.col("rep").alias("_rep")).distinct())
    found = shingle_sets(source.join(sized(reps), F.expr("_id <=> _rep"), "left_semi"), size)
    sets = cut(found.join(sized(cut(wanted.select("k", "t"))), "k").select("t", "codes").dropDuplicates(["t"]))
    codes = sets.select("t", F.explode("codes").alias("code"))
    own = codes.groupBy("code").agg(F.count("*").alias("c"), F.min("t").alias("t")).where("c = 1").groupBy("t").agg(F.collect_list("code").alias("own"))
    profiles = cut(_profiles(sets.join(own, "t", "left")))
    release(several, reps, sets)

    # of a text with fewer than threshold * n shared shingles no other is near
    small = profiles.select("t", "n", "x").where(F.col("x") >= F.col("n") * (threshold - 1e-9))
    members = cut(placed.join(sized(cut(small)), "t"))
    mine = F.struct(((F.col("n") - F.col("x")) / F.col("n")).alias("share"), "t", "n", "x")
    heads = cut(members.groupBy("bucket").agg(F.min(mine).alias("h"), F.count("*").alias("c")).where("c > 1").select("bucket", "c", F.col("h.t").alias("ht"), F.col("h.n").alias("hn"), F.col("h.x").alias("hx")))
    led = members.join(sized(heads), "bucket").where("t != ht")
    asked = led.where(_most(F.col("n"), F.col("x"), F.col("hn"), F.col("hx")) >= threshold - 1e-9)
    first_links = cut(_verify(cut(asked.select(F.col("t").alias("a"), F.col("ht").alias("b")).distinct()), profiles, threshold))
    found = components(first_links).select(F.col("node").alias("t"), "root")
    roots = cut(small.select("t").join(sized(cut(found)), "t", "left").select("t", F.coalesce("root", "t").alias("root")))

    # the pairs of a leader are settled; of the others, those in buckets of several classes meet
    rooted = members.join(sized(roots), "t")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
    open_ = mixed.join(heads.where("c > 2").select("bucket", "ht"), "bucket")
    main = open_.join(roots.select(F.col("t").alias("ht"), F.col("root").alias("main")), "ht")
    active = rooted.join(sized(cut(main)), "bucket").where("t != ht")
    links = _links(active, texts, profiles, threshold)
    met = components(links, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("to"))
    joined = cut(roots.join(sized(cut(met)), "root", "left").select("t", F.coalesce("to", "root").alias("root")))
    release(placed, members, heads, first_links, links, profiles, roots)
    roots = joined

    named = texts.select("t", "k", "rep").join(sized(roots), "t", "left").withColumn("root", F.coalesce("root", "t"))
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "k"))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"), first.alias("first"))
    of_k = cut(named.join(least, "root").select("k", "class_id", (F.col("k") == F.col("first.k")).alias("leads")))
    release(texts, wanted, roots)
    return base, of_k


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24, rows: int = 4, size: int = 5) -> DataFrame:
    """``(id, k, n, class_id)`` of each row: the smallest id of its class.

    The chance that a pair at 0.8 shares no band is (1 - 0.8^4)^24 = 3e-6 with the defaults.
    """
    base, of_k = _classified(docs, id_col, text_col, threshold, bands, rows, size)
    return base.select("id", "k", "n").join(sized(of_k), "k", "left").select("id", "k", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24, rows: int = 4, size: int = 5) -> DataFrame:
    """``docs`` with one row of each class (that with the smallest id); rows without words all stay."""
    base, of_k = _classified(docs, id_col, text_col, threshold, bands, rows, size)
    found = base.where("n > 0").select("id", "k").join(sized(of_k), "k")
    own = F.col("leads") & F.col("id").eqNullSafe(F.col("class_id"))
    tag_col, drop_id, drop_tag = fresh(docs.columns, "_k", "_id", "_drop")
    drops = cut(found.where(~own).select(F.col("id").alias(drop_id), F.col("k").alias(drop_tag)).distinct())
    again = cut(found.where(own).groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select(F.col("k").alias(drop_tag)))
    at = docs.columns.index(text_col)

    def tag(batches):
        for b in batches:
            data, offsets = buffers(b.column(at))
            for i, e in _chunks(offsets, 2 << 20):
                w = Words(data[offsets[i] : offsets[e]], offsets[i : e + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, e - i) for c in b.columns], pa.array([x.tobytes() for x in content_keys(w.hashes(), w.of)], pa.binary())], [*b.schema.names, tag_col])
        tidy()

    tagged = docs.mapInArrow(tag, T.StructType([*docs.schema.fields, T.StructField(tag_col, T.BinaryType())]))
    left = tagged.join(sized(drops), (F.col(tag_col) == F.col(drop_tag)) & F.col(id_col).eqNullSafe(F.col(drop_id)), "left_anti")
    if again.limit(1).count():  # rows equal in id and words that lead a class: one of them
        hit = sized(again)
        once = left.join(hit, F.col(tag_col) == F.col(drop_tag), "left_semi").dropDuplicates([tag_col])
        left = left.join(hit, F.col(tag_col) == F.col(drop_tag), "left_anti").union(once)
    return left.drop(tag_col)
