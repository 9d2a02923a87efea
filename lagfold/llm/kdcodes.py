"""Vector code compression: product codes by filtering Lloyd iterations over kd-trees.

Vectors become integers and are cut into equal consecutive parts, each with a codebook of
its own.  Every task builds, for blocks of its vectors, one kd-tree for each part; nodes
keep their bounding box, count and sum.  The trees are written once.  A round sends
the codebooks down the trees: at a node an entry is dropped when no point of the box can be
nearer to it than to the entry nearest to the box's middle; a node with one entry left is
assigned whole, by its kept sum and count, and only leaves with several look at points.
All arithmetic is on integers, so sums don't depend on how the vectors are spread.

Bounded by: a block of ``block`` vectors in a task, codebooks of ``entries`` x dimensions
integers on the driver.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
vectors whose length isn't that of the kept vector with the smallest id or no positive multiple of
``parts``; integers beyond 2^24 count as 2^24 (components beyond 4,096), so that
distances stay exact.  Seeds are ordered by id, then by the vector; rows without an id come
last.  Repeated rows each count; with fewer rows than entries there are so many entries;
null labels are one label, and so is a table without labels; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.llm.spark import cut, release, sized
from lagfold.llm.text import tidy

MOST = 1 << 24
LEAF = 24


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, all their integers) of a list column of numbers."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    end = np.cumsum(size)
    keep = (size > 0) & (bad[end] == bad[end - size])
    with np.errstate(invalid="ignore"):
        whole = np.clip(np.floor(x[np.repeat(keep, size)] * scale), -MOST, MOST).astype(np.int64)
    return np.flatnonzero(keep), size[keep], whole


class Tree:
    """A balanced kd-tree over the rows of an integer matrix; nodes level by level, as ranges of the ordered points."""

    def __init__(self, points: np.ndarray, boxes: np.ndarray, sums: np.ndarray):
        self.points, self.boxes, self.sums = points, boxes, sums

    @staticmethod
    def depth(n: int) -> int:
        return max(0, int(n // LEAF).bit_length() - 1)

    @staticmethod
    def bounds(n: int) -> list[np.ndarray]:
        """The ranges of the nodes of each level."""
        out = [np.array([0, n])]
        for _ in range(Tree.depth(n)):
            b = out[-1]
            out.append(np.sort(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
        return out

    @staticmethod
    def build(x: np.ndarray) -> tuple["Tree", np.ndarray]:
        """(tree, the rows in its order): each node is halved along the widest side of its box."""
        n = len(x)
        order, boxes, sums = np.arange(n), [], []
        levels = Tree.bounds(n)
        for k, b in enumerate(levels):
            y = x[order]
            lo, hi = np.minimum.reduceat(y, b[:-1]), np.maximum.reduceat(y, b[:-1])
            boxes.append(np.stack([lo, hi], 1))
            sums.append(np.add.reduceat(y, b[:-1]))
            if k + 1 < len(levels):
                node = np.repeat(np.arange(len(b) - 1), np.diff(b))
                key = y[np.arange(n), (hi - lo).argmax(1)[node]]
                order = order[np.lexsort((key, node))]
        return Tree(x[order], np.concatenate(boxes), np.concatenate(sums)), order

    def filter(self, c: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the points nearest to each entry of ``c``, ties to the lower one; ``chosen`` gets each point's entry."""
        k = len(c)
        sums, counts = np.zeros_like(c), np.zeros(k, np.int64)
        levels = Tree.bounds(len(self.points))
        node, left = np.array([0]), np.ones((1, k), bool)
        at = 0
        for level, b in enumerate(levels):
            lo, hi = self.boxes[at + node, 0], self.boxes[at + node, 1]
            d = (((lo + hi)[:, None] - 2 * c) ** 2).sum(2)
            d[~left] = np.iinfo(np.int64).max
            best = d.argmin(1)
            near = c[best][:, None]
            corner = np.where(c > near, hi[:, None], lo[:, None])  # the point of the box that favours the entry most
            more = ((c - corner) ** 2).sum(2) - ((near - corner) ** 2).sum(2)
            left = left & ~((more > 0) | ((more == 0) & (np.arange(k) > best[:, None])))
            one = left.sum(1) == 1
            whole, entry = node[one], left[one].argmax(1)
            np.add.at(sums, entry, self.sums[at + whole])
            np.add.at(counts, entry, b[whole + 1] - b[whole])
            if chosen is not None:
                for n, e in zip(whole.tolist(), entry.tolist()):
                    chosen[b[n] : b[n + 1]] = e
            node, left = node[~one], left[~one]
            if not len(node):
                return sums, counts
            if level + 1 < len(levels):
                at += len(b) - 1
                node, left = np.repeat(2 * node, 2), np.repeat(left, 2, 0)
                node[1::2] += 1
        size = b[node + 1] - b[node]
        rows = np.repeat(b[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
        d = ((self.points[rows][:, None] - c) ** 2).sum(2)
        d[~np.repeat(left, size, 0)] = np.iinfo(np.int64).max
        entry = d.argmin(1)
        np.add.at(sums, entry, self.points[rows])
        np.add.at(counts, entry, 1)
        if chosen is not None:
            chosen[rows] = entry
        return sums, counts


def _first(rank: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """The rows of the ``most`` smallest (rank, vector)."""
    last = np.partition(rank, most - 1)[most - 1] if len(rank) > most else rank.max()
    rows = np.flatnonzero(rank <= last)
    return rows[np.lexsort((*x[rows].T[::-1], rank[rows]))[:most]]


def forest(vectors: DataFrame, parts: int, entries: int, scale: float, block: int) -> DataFrame:
    """Blocks of vectors of one length: their trees, ids, labels, and the ``entries`` first rows of each, as a written table."""
    fields = vectors.schema
    seed = T.StructType([T.StructField("vec", fields["vec"].dataType), T.StructField("q", T.ArrayType(T.LongType()))])
    binary = ("points", "boxes", "sums", "order")
    schema = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("n", T.IntegerType()), *[T.StructField(b, T.BinaryType()) for b in binary],
        T.StructField("ids", T.ArrayType(fields["vec"].dataType)), T.StructField("labels", T.ArrayType(fields["label"].dataType)), T.StructField("seeds", T.ArrayType(seed)),
    ])

    def made(dim: int, ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        trees = [Tree.build(np.ascontiguousarray(y)) for y in np.split(x, parts, 1)]
        raw = [b"".join(t.points.astype("<i4").tobytes() for t, _ in trees)]  # integers fit by the bound on them
        raw += [b"".join(t.boxes.astype("<i4").tobytes() for t, _ in trees), b"".join(t.sums.astype("<i8").tobytes() for t, _ in trees), b"".join(o.astype("<i4").tobytes() for _, o in trees)]
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        first = _first(rank, x, entries)
        lists = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        q = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * dim, pa.int32()), pa.array(x[first].ravel()))
        seeds = pa.StructArray.from_arrays([ids.take(pa.array(first)), q], ["vec", "q"])
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(x)], pa.int32()), *[pa.array([b], pa.binary()) for b in raw], lists(ids), lists(labels), lists(seeds)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}
        for batch in batches:
            rows, size, whole = integers(batch.column("v"), scale)
            begin = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                if dim % parts:
                    continue
                mine = np.flatnonzero(size == dim)
                x = whole[(begin[mine][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                take = pa.array(rows[mine])
                own = held.setdefault(dim, [])
                own.append((batch.column("vec").take(take), batch.column("label").take(take), x))
                if sum(len(o[2]) for o in own) >= block:
                    yield from emit(dim, held.pop(dim), False, held)
        for dim in [*held]:
            yield from emit(dim, held.pop(dim), True, held)
        tidy()

    def emit(dim, own, last, held):
        ids, labels, x = pa.concat_arrays([o[0] for o in own]), pa.concat_arrays([o[1] for o in own]), np.concatenate([o[2] for o in own])
        at = 0
        while len(x) - at >= block or (last and at < len(x)):
            end = min(len(x), at + block)
            yield made(dim, ids[at:end], labels[at:end], x[at:end])
            at = end
        if at < len(x):
            held[dim] = [(ids[at:], labels[at:], x[at:])]

    return cut(vectors.mapInArrow(run, schema))


def _trees(batch: pa.RecordBatch, row: int, parts: int) -> list[Tree]:
    n, w = batch.column("n")[row].as_py(), batch.column("dim")[row].as_py() // parts
    get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind).astype(np.int64).reshape(parts, -1)
    points, boxes, sums = get("points", "<i4"), get("boxes", "<i4"), get("sums", "<i8")
    return [Tree(p.reshape(n, w), b.reshape(-1, 2, w), s.reshape(-1, w)) for p, b, s in zip(points, boxes, sums)]


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round: each entry the floor of its points' mean; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, tree in enumerate(_trees(batch, row, parts)):
                    s, c = tree.filter(books[p])
                    total[p, :, :width] += s
                    total[p, :, width] += c
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, total.size], pa.int32()), pa.array(total.ravel()))], ["s"])

    sums = trees.select("dim", "n", "points", "boxes", "sums").mapInArrow(run, "s array<long>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    for r in sums.collect():  # entries x (dimensions + parts) numbers
        flat[r.k] = r.v
    got = flat.reshape(parts, entries, width + 1)
    count = got[:, :, width:]
    return np.where(count > 0, got[:, :, :width] // np.maximum(count, 1), books)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 4096) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of every vector that takes part.

    ``code`` has two hex digits for each part; ``error`` is the squared distance to the code's vector,
    ``label_error`` its sum over the vectors of the label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    frame = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).alias("v"), label.alias("label"))
    trees = forest(frame, parts, entries, scale, block)
    schema = T.StructType([T.StructField(id_col, frame.schema["vec"].dataType), T.StructField("_label", frame.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    out = [id_col, "code", "error", "label_error", "codebooks_sha256"]
    head = trees.select("dim", F.explode("seeds").alias("s")).select("dim", "s.vec", "s.q")
    one = head.orderBy(F.col("vec").asc_nulls_last(), "q").limit(1).first()
    if one is None:
        return vectors.sparkSession.createDataFrame([], schema).select(id_col, "code", "error", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    own = trees.where(F.col("dim") == one.dim)
    seeds = head.where(F.col("dim") == one.dim).orderBy(F.col("vec").asc_nulls_last(), "q").limit(entries).collect()
    books = np.array([r.q for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = lloyd_round(own, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.frombuffer(b"".join(b"%02x" % k for k in range(256)), np.uint8).reshape(256, 2)
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("n")[row].as_py()
                order = np.frombuffer(batch.column("order")[row].as_buffer(), "<i4").reshape(parts, n)
                code, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                for p, tree in enumerate(_trees(batch, row, parts)):
                    chosen = np.zeros(n, np.int64)
                    tree.filter(books[p], chosen)
                    code[order[p], p] = chosen
                    error[order[p]] += ((tree.points - books[p][chosen]) ** 2).sum(1)
                text = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 2 * parts), pa.py_buffer(hexes[code].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, batch.column("labels")[row].values, text, pa.array(error)], schema.names)
        tidy()

    coded = cut(own.select("dim", "n", "points", "boxes", "sums", "order", "ids", "labels").mapInArrow(assign, schema))
    release(trees)
    by_label = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("_label", "_of")
    return coded.join(sized(by_label), F.col("_label").eqNullSafe(F.col("_of"))).withColumn("codebooks_sha256", F.lit(digest)).select(*out)


def compress_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in DuckDB's SQL, rounds written out."""
    apart = "list_sum(list_transform(list_zip(p.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = f"""
WITH h AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  k AS (SELECT * FROM h WHERE len(e) = (SELECT len(e) FROM h WHERE len(e) % {parts} = 0 ORDER BY vec_id NULLS LAST, e LIMIT 1)),
  v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS n, * FROM k),
  p AS (SELECT n, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS e FROM v, (SELECT unnest(range({parts})) AS part)),
  c0 AS (SELECT part, n - 1 AS entry, e FROM p WHERE n <= {entries})"""
    for k in range(rounds + 1):
        sql += f""",
  a{k} AS MATERIALIZED (SELECT p.n, p.part, min({apart} * {entries} + c.entry) AS m FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.n, p.part)"""
        if k < rounds:
            sql += f""",
  s{k} AS (SELECT part, m % {entries} AS entry, i, sum(p.e[i]) AS s, count(*) AS n FROM p JOIN a{k} USING (n, part), (SELECT unnest(range(1, (SELECT max(len(e)) FROM p) + 1)) AS i) GROUP BY ALL),
  c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(t.e, c.e) AS e FROM c{k} c LEFT JOIN (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS e FROM s{k} GROUP BY part, entry) t ON t.part = c.part AND t.entry = c.entry)"""
    return (
        sql
        + f""",
  book AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds}),
  coded AS (SELECT n, string_agg(printf('%02x', CAST(m % {entries} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN coded USING (n), book"""
    )
