"""Token ids in Parquet list columns: written in document order, read selectively.

Encoding: a text is cut where white space begins, and between ASCII letters, digits and other signs; such a
chunk (white space and what follows it) has the same ids alone as within its text, so every worker
keeps the ids of chunks it has met in a table and asks the tokenizer's own library for new ones only, many
in one string with line ends between them.

File format: a row for each document with its id, the file's part number, the place of its first token
within the part, its number of tokens, and the ids as a list column.  Parts are ranges
of the order (id, text), sorted within.  Ids are dictionary coded (codes of as many bits as the
ids in use need) or delta coded, as asked; the scalar columns ascend and are delta coded.
Row groups and pages are small enough that page indexes let a reader fetch a few
documents' tokens, and columns are read alone, so that places and counts cost no token
page.  The place of a document in the whole is its part's offset, a sum over parts, plus its
place within.

Bounded by: about ``PIECE`` bytes of text and ``KNOWN`` known chunks in a worker; a row a part on the driver.

Defined cases: a null text is an empty one and has the end id alone; special tokens written out in a
text become their ids; documents without an id come last; documents of an equal id are ordered by a
hash of the text, equal rows in any order; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.llm.bpe import Pieces
from lagfold.llm.spark import cut, sized
from lagfold.llm.text import WHITE, Words, mix64, tidy, buffers

#: Bytes of text that are encoded at a time.
PIECE = 1_000_000
#: Most chunks whose ids a worker keeps (about 50 bytes each); then it starts anew.
KNOWN = 1_500_000
#: Longer chunks are encoded anew in each piece, in bytes.
LONG = 16


#: Bytes by what a tokenizer sees in them: 1 letters, 2 digits, 3 other signs, 0 what isn't cut (white space, control characters, apostrophes, all outside ASCII).
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
for _a, _b, _k in ((48, 58, 2), (65, 91, 1), (97, 123, 1), (39, 40, 0)):
    _KIND[_a:_b] = _k


class Chunks(Words):
    """White space with what follows it, cut between kinds of signs; places are bytes of the text, as they are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, whole: list[bytes] = []):
        self.data, self.offsets = data, offsets
        padded = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
        padded[: len(data)] = data
        self._aligned = padded.view("<u8")
        white, kind = WHITE[data], _KIND[data]
        begins = white.copy()
        begins[1:] &= ~white[:-1]
        self.odd = _other_space(data)
        begins[1:] &= ~self.odd[:-1]  # white space of all sorts is one run
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        if whole:  # texts of special tokens aren't cut
            raw = data.tobytes()
            for token in whole:
                at = raw.find(token)
                while at >= 0:
                    begins[at + 1 : at + len(token)] = False
                    at = raw.find(token, at + 1)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.append(self.starts[1:], len(data))
        self.of = np.searchsorted(self.starts, offsets)


def _other_space(data: np.ndarray) -> np.ndarray:
    """The last bytes of white space outside ASCII, and separators (1C to 1F)."""
    out = (data >= 0x1C) & (data <= 0x1F)
    if len(data) < 2:
        return out
    a, b = data[1:], data[:-1]
    out[1:] |= (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    lead = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else np.zeros(0, np.int64)
    c, b, a = data[lead], data[lead + 1], data[lead + 2]
    found = (c == 0xE1) & (b == 0x9A) & (a == 0x80)
    found |= (c == 0xE2) & (b == 0x80) & (((a >= 0x80) & (a <= 0x8A)) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    found |= (c == 0xE2) & (b == 0x81) & (a == 0x9F)
    found |= (c == 0xE3) & (b == 0x80) & (a == 0x80)
    out[lead[found] + 2] = True
    return out


class Growing:
    """Many short arrays laid out as one, in room that doubles as it fills."""

    def __init__(self):
        self.values, self.offsets, self.n = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), 0

    def put(self, ids: Pieces) -> int:
        """Lay the arrays behind the others; the first one's number.  They stay if ``n`` is raised."""
        begin, more = int(self.offsets[self.n]), len(ids.offsets) - 1
        self.values = room(self.values, begin + len(ids.values))
        self.offsets = room(self.offsets, self.n + more + 1)
        self.values[begin : begin + len(ids.values)] = ids.values
        self.offsets[self.n : self.n + more + 1] = begin + ids.offsets
        return self.n

    def take(self, rows: np.ndarray) -> Pieces:
        count = self.offsets[rows + 1] - self.offsets[rows]
        end = np.cumsum(count)
        place = np.repeat(self.offsets[rows] - end + count, count) + np.arange(int(end[-1]) if len(end) else 0)
        return Pieces(self.values[place], count)


def room(x: np.ndarray, size: int) -> np.ndarray:
    """``x`` with room for ``size`` along its last axis."""
    while x.shape[-1] < size:
        x = np.concatenate([x, np.zeros_like(x)], -1)
    return x


class Known:
    """Ids of chunks, found by open addressing over all chunks at once; a chunk is told by its length and bytes."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.row = np.full(1 << bits, -1, np.int32)
        self.lanes, self.size, self.n = np.zeros((2, 1 << 10), np.uint64), np.zeros(1 << 10, np.uint8), 0
        self.ids = Growing()

    @staticmethod
    def hash(lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = mix64(lanes[0] ^ mix64(size.astype(np.uint64)))
        more = np.flatnonzero(size > 8)
        h[more] = mix64(h[more] * np.uint64(0x9E3779B97F4A7C15) + lanes[1][more])
        return h

    def find(self, lanes: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The row of each chunk, -1 if it isn't known."""
        slot = h & self.mask
        out = self.row[slot]
        if not self.n:
            return out
        open_ = self._other(out, lanes, size, np.arange(len(out)))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            out[open_] = self.row[slot[open_]]
            open_ = self._other(out, lanes, size, open_)
        return out

    def _other(self, out: np.ndarray, lanes: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the places whose row is another chunk's."""
        row = out[at]
        wrong = (self.size[row] != size[at]) | (self.lanes[0][row] != lanes[0][at])
        more = np.flatnonzero((size[at] > 8) & ~wrong & (row >= 0))
        if len(more):
            r, k = row[more], at[more]
            wrong[more] = self.lanes[1][r] != lanes[1][k]
        return at[wrong & (row >= 0)]

    def add(self, lanes: np.ndarray, size: np.ndarray, h: np.ndarray, ids: Pieces) -> None:
        """Different chunks that aren't known."""
        row = np.arange(self.n, self.n + len(size), dtype=np.int32)
        upto = self.n + len(size)
        self.lanes, self.size = room(self.lanes, upto), room(self.size, upto)
        self.lanes[:, self.n : upto], self.size[self.n : upto] = lanes, size
        self.ids.put(ids)
        self.n = self.ids.n = upto
        slot = h & self.mask
        while len(row):
            free = self.row[slot] < 0
            self.row[slot[free]] = row[free]
            lost = self.row[slot] != row
            row, slot = row[lost], (slot[lost] + np.uint64(1)) & self.mask


class Encoder:
    """The ids of many texts at once, equal to those of the library's tokenizer with the given file."""

    def __init__(self, spec: str, end: int = 0, most: int = KNOWN):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.end, self.most = end, most
        self.whole = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known = Known(max(4, (4 * self.most).bit_length()))

    def _ask(self, raw: list[bytes]) -> Pieces:
        got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch([x.decode() for x in raw], add_special_tokens=False)]
        return Pieces(np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64))

    def _ask_together(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, group: int = 200) -> Pieces:
        """The ids of chunks without white space but for a space in front: each follows a line end, which is a token of its own."""
        end = np.cumsum(size + 1)
        laid = data[np.repeat(starts - (end - size), size + 1) + np.arange(end[-1])]
        laid[end - size - 1] = 10
        cuts = [0, *end[group - 1 : -1 : group].tolist(), int(end[-1])]
        raw = laid.tobytes()
        ids = self._ask([raw[a:b] for a, b in zip(cuts, cuts[1:])]).values
        line = np.flatnonzero(ids == self.line[0])
        return Pieces(np.delete(ids, line), np.diff(np.append(line, len(ids))) - 1)

    def _new(self, data: np.ndarray, chunks: Chunks, rows: np.ndarray) -> Pieces:
        """The ids of different chunks."""
        starts, size = chunks.starts[rows], chunks.ends[rows] - chunks.starts[rows]
        strange = np.concatenate([[0], np.cumsum(chunks.odd | (WHITE[data] & (data != 32)) | (data == 60))])  # 60 opens special tokens
        spaces = np.concatenate([[0], np.cumsum(data == 32)])
        plain = (strange[starts + size] == strange[starts]) & (spaces[starts + size] - spaces[starts] == (data[starts] == 32)) & ((size > 1) | (data[starts] != 32)) & (len(self.line) == 1)
        ids = [Pieces(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * 2
        some, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        if len(some):
            ids[0] = self._ask_together(data, starts[some], size[some])
        if len(rest):
            ids[1] = self._ask([data[a : a + n].tobytes() for a, n in zip(starts[rest], size[rest])])
        order = np.empty(len(rows), np.int64)
        order[np.concatenate([some, rest])] = np.arange(len(rows))
        return Pieces.joined(ids).take(order)

    def encode(self, column) -> Pieces:
        """The ids of each text of a string column, each followed by the end id."""
        data, offsets = buffers(column)
        chunks = Chunks(data, offsets, self.whole)
        n = len(chunks.starts)
        size = chunks.ends - chunks.starts
        lanes = np.zeros((2, n), np.uint64)
        every = np.arange(n)
        lanes[0] = chunks.lanes(every, 0)
        every = np.flatnonzero(size > 8)
        lanes[1][every] = chunks.lanes(every, 8)
        h = Known.hash(lanes, size)
        if self.known.n > self.most:
            self.forget()
        row = self.known.find(lanes, size, h)
        long = np.flatnonzero(size > LONG)
        row[long] = -1
        new = np.flatnonzero((row < 0) & (size <= LONG))
        spelt = lambda k: data[chunks.starts[k] : chunks.ends[k]].tobytes()
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            fresh = new[first]
            self.known.add(lanes[:, fresh], size[fresh], h[fresh], self._new(data, chunks, fresh))
            row[new] = self.known.find(lanes[:, new], size[new], h[new])
        # long chunks, and those whose hash is another's, are this batch's own
        alone = np.flatnonzero(row < 0)
        extra: dict[bytes, int] = {}
        row[alone] = [self.known.n + 1 + extra.setdefault(spelt(k), len(extra)) for k in alone]
        _, first = np.unique(row[alone], return_index=True)
        own = [self._new(data, chunks, alone[first])] if len(alone) else []
        self.known.ids.put(Pieces.joined([Pieces(np.array([self.end], np.uint32), np.array([1])), *own]))
        row = np.insert(row, chunks.of[1:], self.known.n)
        each = self.known.ids.take(row)
        return Pieces(each.values, np.diff(each.offsets[chunks.of + np.arange(len(offsets))]))


_LOADED: dict[str, Encoder] = {}


def encoder(spec: str, end: int) -> Encoder:
    """The encoder of a tokenizer file's text; kept by this Python worker."""
    key = f"{hashlib.sha256(spec.encode()).hexdigest()}-{end}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(spec, end)
    return _LOADED[key]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of a string column."""
    for whole in batches:
        sizes = pc.binary_length(whole.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
            yield whole.slice(at, end - at)
            at = end


def write(docs: DataFrame, folder: str, spec: str, end: int = 0, coding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``(id, part, at, n_tokens, ids)`` of every document in ascending order of the id."""
    if coding not in ("dictionary", "delta"):
        raise ValueError("coding is dictionary or delta")
    frame = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    placed = frame.withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_last(), F.col("h"), F.col("r")]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
    schema = T.StructType([T.StructField("id", frame.schema["id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, own = TaskContext.get().partitionId(), 0, encoder(spec, end)
        for batch in pieces(batches, "t"):
            got = own.encode(batch.column("t"))
            ids = pa.ListArray.from_arrays(pa.array(got.offsets.astype(np.int32)), pa.array(got.values.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(before + got.offsets[:-1]), pa.array(np.diff(got.offsets)), ids], schema.names)
            before += int(got.offsets[-1])
        tidy()

    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(coding == "dictionary").lower(), "parquet.dictionary.page.size": 4 << 20}
    ordered.mapInArrow(run, schema).write.options(**options).parquet(folder)


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    """``(part, offset)``: the tokens of all parts before each; no token page is read."""
    ends = spark.read.parquet(folder).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut(ends.select("part", before.cast("long").alias("offset")))  # a row a part


def places(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, part, at, start, n_tokens)`` of every document; no token page is read."""
    rows = spark.read.parquet(folder).select("id", "part", "at", "n_tokens")
    return rows.join(sized(offsets(spark, folder)), "part").select("id", "part", "at", (F.col("offset") + F.col("at")).alias("start"), "n_tokens")


def tokens(spark: SparkSession, folder: str, low, high) -> DataFrame:
    """``(id, n_tokens, ids)`` of the documents with ids from ``low`` to ``high``: other row groups and pages are skipped by their statistics."""
    return spark.read.parquet(folder).where((F.col("id") >= low) & (F.col("id") <= high)).select("id", "n_tokens", "ids")


def span(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """``(start, ids)``: the tokens at the places ``begin`` to ``end`` - 1 of the whole, by document."""
    hit = cut(places(spark, folder).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin)).select("part", "at", "start", "n_tokens"))
    edge = hit.groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    rows = spark.read.parquet(folder).select("part", "at", "ids")
    wanted = F.lit(False)
    for r in edge.collect():  # a row a part that the places meet
        wanted = wanted | ((F.col("part") == r.part) & F.col("at").between(r.low, r.high))
    first = F.greatest(F.lit(begin) - F.col("start"), F.lit(0))
    upto = F.least(F.lit(end) - F.col("start"), F.col("n_tokens"))
    return rows.where(wanted).join(sized(hit), ["part", "at"]).select((F.col("start") + first).alias("start"), F.slice("ids", first.cast("int") + 1, (upto - first).cast("int")).alias("ids"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the stored ids (as little-endian unsigned 32-bit integers for the checksum)."""
    stored = spark.read.parquet(folder).select("id", "part", "at", "ids")
    schema = T.StructType([stored.schema["id"], T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            places = ids.offsets.to_numpy().astype(np.int64)
            raw, of = ids.values.to_numpy().astype("<u4").tobytes(), (4 * places).tolist()
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(of, of[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("at"), pa.array(np.diff(places)), crc], schema.names)

    rows = stored.mapInArrow(run, schema)
    return rows.join(sized(offsets(spark, folder)), "part").select("id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
