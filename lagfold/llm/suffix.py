"""Repeated passages by sparse suffix arrays.

Suffixes are kept where the hash of the next ``anchor`` words is the smallest of
``least - anchor + 1`` neighbouring ones (minimisers), so every passage of ``least`` words
holds at least one kept suffix, chosen by its content alone: both copies of a passage keep
the same ones.  Suffixes whose anchor occurs at one place only are dropped.  Every start of
a window of ``least`` words belongs to the window's minimiser; where that is left, the
window is kept under the hash of all its words, so equal windows have equal keys whatever
surrounds a frequent line.  Windows are sorted by (hash, id, text, place) in range
partitions: the first of a hash stays and the later ones are removable.  Hashes that cross
partitions are settled by the first row that each partition has of them.

Anchors and windows are compared by 64-bit hashes (n windows have a wrong match with a
chance of n^2 / 2^65).  Documents with equal word sequences count
as one text; every copy but the first is removable as a whole if it has ``least`` words.

A passage is repeated if it occurs at two places, be it in two different texts or within one; ``shared``
tells texts that share one with another text.  With ``within`` off, what only one text says again
and again is its own affair and is left alone.

Defined cases: texts of fewer than ``least`` words, null and empty ones have no passage;
rows equal in text are copies, but for rows equal in id too, which count as the same row
twice; other columns are carried untouched; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lagfold.llm.neardup import _chunks, content_keys
from lagfold.llm.spark import cut, fresh, release, sized
from lagfold.llm.text import Words, buffers, rolling, tidy

U = np.uint64


def _minimisers_of_texts(h: np.ndarray, of: np.ndarray, anchor: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text, word place) of the kept suffixes of a chunk of texts."""
    keys = rolling(h, anchor)
    count = np.diff(of) - anchor + 1
    keep = np.flatnonzero(count >= window)
    key, text, place = [], [], []
    for t in keep.tolist():
        own = keys[of[t] : of[t] + count[t]]
        at = minimisers(own, window)
        key.append(own[at])
        text.append(np.full(len(at), t))
        place.append(at)
    z = np.zeros(0, np.int64)
    return (np.concatenate(key), np.concatenate(text), np.concatenate(place)) if key else (np.zeros(0, U), z, z)


def minimisers(x: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the smallest (the last of equals) of some ``window`` consecutive values."""
    return np.unique(_smallest(x, window))


def _smallest(x: np.ndarray, window: int) -> np.ndarray:
    """The position of the smallest (the last of equals) of each ``window`` consecutive values: sliding minima by doubling."""
    n = len(x)
    if n < window:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    span = 1
    while span * 2 <= window:
        a, b = best[: n - 2 * span + 1], best[span : n - span + 1]
        best = np.where(x[b] <= x[a], b, a)
        span *= 2
    if span < window:
        a, b = best[: n - window + 1], best[window - span : n - span + 1]
        best = np.where(x[b] <= x[a], b, a)
    return best[: n - window + 1]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, d, n)``: the 64-bit content key and the number of words of each row."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("_text"))
            for at, end in _chunks(offsets, 2 << 20):
                w = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(at, end - at), pa.array(content_keys(w.hashes(), w.of)[:, 0].view(np.int64)), pa.array(w.counts())], ["id", "d", "n"])

    return docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, "id long, d long, n long")


def _suffixes(docs: DataFrame, id_col: str, text_col: str, least: int, anchor: int) -> DataFrame:
    """``(key, d, pos)`` of the kept suffixes."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("_text"))
            for at, end in _chunks(offsets, 2 << 20):
                w = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                h = w.hashes()
                key, text, place = _minimisers_of_texts(h, w.of, anchor, least - anchor + 1)
                if len(key):
                    d = content_keys(h, w.of)[:, 0].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(d[text]), pa.array(place.astype(np.int32))], ["key", "d", "pos"])
        tidy()

    return docs.select(docs[text_col].cast("string").alias("_text")).mapInArrow(run, "key long, d long, pos int")


def _windows(texts: DataFrame, least: int, anchor: int) -> DataFrame:
    """``(w, id, d, pos)`` of ``(id, d, _text, places)``: hash and start of each window of ``least`` words whose minimiser is at one of the places."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                data, offsets = buffers(b.column("_text").slice(row, 1))
                h = Words(data, offsets).hashes()
                places = np.array(b.column("places")[row].as_py(), np.int64)
                pos = np.flatnonzero(np.isin(_smallest(rolling(h, anchor), least - anchor + 1), places))
                n = len(pos)
                same = lambda c: pa.array([b.column(c)[row].as_py()] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rolling(h, least)[pos].view(np.int64)), same("id"), same("d"), pa.array(pos.astype(np.int32))], ["w", "id", "d", "pos"])

    return texts.mapInArrow(run, "w long, id long, d long, pos int")


def _settled(w: np.ndarray, d: np.ndarray, pos: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows sorted by (w, id, d, pos): the settled rows, where the first of each one's hash is and whether several texts have it; and the open rows with their counts and the last text of each one's hash.

    The first is told by its place if it is in the same text, else by -1.  Open are, of the first and the last hash,
    the first row, and every row if there is one text only.
    """
    own = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (pos[1:] != pos[:-1])]))  # rows equal in id and text
    new = np.flatnonzero(np.concatenate([[True], w[own][1:] != w[own][:-1]]))
    count = np.diff(np.append(new, len(own)))
    last = d[own[new + count - 1]]
    several = d[own[new]] != last  # texts
    edge = np.zeros(len(new), bool)
    edge[[0, -1]] = True
    head = own[np.repeat(new, count)]
    inside = np.repeat(several | (within & (count > 1)), count)
    open_ = np.repeat(edge & ~several, count)
    open_[new[edge]] = True
    inside &= ~open_
    first = np.where(d[own] == d[head], pos[head], -1)
    held = np.ones(len(own), np.int64)
    held[new[several]] = count[several]
    return own[inside], first[inside], np.repeat(several, count)[inside], own[open_], held[open_], np.repeat(last, count)[open_]


def _covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` words are within ``length`` words of one of the starts."""
    return np.cumsum(np.bincount(starts, minlength=size + 1) - np.bincount(starts + length, minlength=size + 1))[:size] > 0


def _intervals(mask: np.ndarray) -> list[dict]:
    at = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
    return [{"start": a, "end": e} for a, e in zip(at[::2], at[1::2])]


def _spans_of(pos: np.ndarray, first: np.ndarray, least: int) -> tuple[list[dict], list[dict]]:
    """Repeated and removable spans of a text, of its repeated windows in order and the places of their firsts (-1: in another text)."""
    at = np.minimum(np.searchsorted(pos, first), len(pos) - 1)
    first = np.where((first >= 0) & (pos[at] == first), first[at], first)  # the first of a partition may be a later one itself
    size = int(pos[-1]) + least
    run = lambda x: _covered(x, least, size)
    again = (first >= 0) & (first != pos)
    # where a text overlaps itself, the earlier occurrence stays whole
    return _intervals(run(pos)), _intervals(run(pos[first < 0]) | (run(pos[again]) & ~run(np.unique(first[again]))))


_SPANS = "array<struct<start:int,end:int>>"


def repeated_spans(docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str, least: int, anchor: int, within: bool = True, rows: int = 200_000) -> DataFrame:
    """``(d, spans, removable, shared)`` of each text that shares a passage with another place; spans in words."""
    suffixes = cut(_suffixes(docs, id_col, text_col, least, anchor))
    where = F.struct("d", "pos") if within else F.struct("d")
    often = suffixes.groupBy("key").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo != hi").select("key")
    kept = suffixes.join(sized(cut(often)), "key", "left_semi").select("d", "pos").distinct()
    first = keyed.where(F.col("n") >= least).groupBy("d").agg(F.min("id").alias("id"))
    places = cut(kept.groupBy("d").agg(F.collect_set("pos").alias("places")).join(first, "d"))

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("_text"))
    wanted = sized(places.select("id").distinct())

    def tag(batches):  # the content key of each row, so that rows with equal ids stay apart
        for b in batches:
            data, offsets = buffers(b.column("_text"))
            for at, end in _chunks(offsets, 2 << 20):
                w = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                yield pa.RecordBatch.from_arrays([*[c.slice(at, end - at) for c in b.columns], pa.array(content_keys(w.hashes(), w.of)[:, 0].view(np.int64))], ["id", "_text", "d"])

    # null ids are kept apart by eqNullSafe
    picked = source.join(wanted.withColumnRenamed("id", "_w"), F.expr("id <=> _w"), "left_semi").mapInArrow(tag, "id long, _text string, d long")
    texts = picked.join(places.select("d", F.col("id").alias("_i"), "places"), "d").where(F.expr("id <=> _i")).select("id", "d", "_text", "places")
    windows = cut(_windows(texts, least, anchor))
    release(suffixes, places)
    parts = max(1, -(-windows.count() // rows))

    def scan(batches):
        whole = [b for b in batches if b.num_rows]
        if whole:
            t = pa.Table.from_batches(whole)
            rows, first, several, open_, count, last = _settled(*(t.column(c).to_numpy() for c in ("w", "d", "pos")), within)
            z = np.zeros(len(rows), np.int64)
            for at, f, c, e, s in ((rows, first, z, z, several), (open_, np.full(len(open_), -1), count, last, np.zeros(len(open_), bool))):
                out = t.take(pa.array(at)).append_column("first", pa.array(f.astype(np.int32))).append_column("c", pa.array(c)).append_column("e", pa.array(e)).append_column("shared", pa.array(s))
                yield from out.combine_chunks().to_batches()
        tidy()

    order = ["w", "id", "d", "pos"]
    ranged = windows.repartitionByRange(parts, *order) if parts > 1 else windows.coalesce(1)
    found = cut(ranged.sortWithinPartitions(*order).mapInArrow(scan, "w long, id long, d long, pos int, first int, c long, e long, shared boolean"))
    of_w = W.partitionBy("w")
    firsts = of_w.orderBy("id", "d", "pos")
    texts_of = {"lo": F.min(F.least("d", "e")).over(of_w), "hi": F.max(F.greatest("d", "e")).over(of_w), "n": F.sum("c").over(of_w)}
    edges = found.where("c > 0").withColumns({**texts_of, "_d": F.first("d").over(firsts), "_pos": F.first("pos").over(firsts)})  # two rows a partition, but for what one text repeats
    again = F.col("n") > 1 if within else F.col("lo") != F.col("hi")
    across = edges.where(again).select("d", "pos", F.when(F.col("d") == F.col("_d"), F.col("_pos")).otherwise(-1).alias("first"), (F.col("lo") != F.col("hi")).alias("shared"))

    def unite(batches):
        for b in batches:
            s = b.column("s")
            offsets, values = s.offsets.to_numpy(), s.values.to_numpy()
            got = []
            for a, e in zip(offsets, offsets[1:]):
                x = np.sort(values[a:e])
                got.append(_spans_of(x >> 32, (x & 0xFFFFFFFF) - 1, least))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], kind), b.column("shared")], ["d", "spans", "removable", "shared"])

    packed = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("first").cast("long") + 1)
    each = found.where("c = 0").select("d", "pos", "first", "shared").union(across).groupBy("d").agg(F.collect_list(packed).alias("s"), F.max("shared").alias("shared"))
    return each.mapInArrow(unite, f"d long, spans {_SPANS}, removable {_SPANS}, shared boolean")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, anchor: int = 25, within: bool = True) -> DataFrame:
    """``(id, d, n, copy, shared, spans, removable)`` of each row with a passage of at least ``least`` words that occurs again, ``within`` the text or in another.

    ``copy``: an equal text has a smaller id, so the whole row is removable; ``shared``: another text or row has a passage of it.
    """
    keyed = cut(_keyed(docs, id_col, text_col))
    spans = cut(repeated_spans(docs, keyed, id_col, text_col, least, anchor, within))
    groups = keyed.where(F.col("n") >= least).groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    many = cut(groups.where("c > 1"))
    whole = lambda: F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))).cast(_SPANS)
    rows = keyed.where(F.col("n") >= least).join(sized(many), "d", "left").join(sized(spans), "d", "left")
    copy = F.col("c").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select("id", "d", "n", F.coalesce(copy, F.lit(False)).alias("copy"), (F.col("c").isNotNull() | F.coalesce("shared", F.lit(False))).alias("shared"), F.when(F.col("c").isNotNull(), whole()).otherwise(F.col("spans")).alias("spans"), F.when(copy, whole()).otherwise(F.coalesce("removable", F.array().cast(_SPANS))).alias("removable"))
    return rows.where(F.col("spans").isNotNull())


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, anchor: int = 25, length_col: str | None = None) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut out; rows of which nothing is left go.

    What only one text repeats stays.  ``length_col``: a column to set to the new number of characters where the text changes.
    """
    found = repeats(docs, id_col, text_col, least, anchor, within=False).where(F.size("removable") > 0)
    tag_col, cut_id, cut_tag, cut_spans = fresh(docs.columns, "_tag", "_id", "_d", "removable")
    cuts = cut(found.select(F.col("id").alias(cut_id), F.col("d").alias(cut_tag), F.col("removable").alias(cut_spans)).dropDuplicates([cut_id, cut_tag]))
    at = docs.columns.index(text_col)
    tagged_schema = T.StructType([*docs.schema.fields, T.StructField(tag_col, T.LongType())])

    def tag(batches):
        for b in batches:
            data, offsets = buffers(b.column(at))
            for a, e in _chunks(offsets, 2 << 20):
                w = Words(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, e - a) for c in b.columns], pa.array(content_keys(w.hashes(), w.of)[:, 0].view(np.int64))], [*b.schema.names, tag_col])
        tidy()

    tagged = docs.mapInArrow(tag, tagged_schema)
    joined = tagged.join(sized(cuts), (F.col(tag_col) == F.col(cut_tag)) & F.col(id_col).cast("long").eqNullSafe(F.col(cut_id)), "left").drop(tag_col, cut_tag, cut_id)
    size_at = docs.columns.index(length_col) if length_col else None

    def trim(batches):
        for b in batches:
            spans = b.column(b.num_columns - 1)
            change = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            columns = list(b.columns[:-1])
            keep = np.ones(b.num_rows, bool)
            if len(change):
                texts = columns[at].to_pylist()
                sizes = columns[size_at].to_pylist() if size_at is not None else None
                for k in change:
                    raw = texts[k].encode()
                    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    out, done = [], 0
                    for s in spans[int(k)].as_py():
                        a = int(w.starts[s["start"]])
                        out.append(raw[done:a])
                        done = int(w.starts[s["end"]]) if s["end"] < len(w.starts) else len(raw)
                    texts[k] = b"".join([*out, raw[done:]]).decode()
                    keep[k] = bool(texts[k].strip())
                    if sizes is not None:
                        sizes[k] = len(texts[k])
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(pa.array(keep))

    return joined.mapInArrow(trim, docs.schema)
