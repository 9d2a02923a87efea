"""WARC archives: writing, and reading by boundary-chain verification.

Writing is native: one WARC/1.1 record per row (a response with its HTTP block, or a
revisit of the record with the same payload), written by Spark's text sink as a plain
``.warc`` stream of bytes, so any file system that Spark reaches will do.

Reading: tasks take byte ranges of the archive files and look for the record magic
anywhere in them; for every magic they emit the bytes up to the next one and, if a header
follows it, where its successor would start.  Sums of the bytes turn these into a graph of
offsets.  Pointer jumping (doubling the chain's step each round) follows the chains within
each range and then, over the places where chains enter ranges, from the start of each
file; only candidates that it reaches are records, and a magic inside a payload never is.
Records that hold one are put together from their pieces.  A chain that breaks off (a
truncated file) keeps the whole records before the break.

Defined cases: a null payload is empty; rows with equal ids and payloads are each
written as the first of them is; a null id is written as an empty id and read as null, and revisits a record with an id;
white space and control characters of an URL are written as ``%20``; an empty table
gives no records; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lagfold.llm.spark import cut, sized
from lagfold.shipping import ship

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(binary: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 5 hex digits are 4 base32 digits."""
    h = F.sha1(binary)
    four = [F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(id, uri, payload, digest, bytes, refers_to)``: which rows revisit which."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    keys = rows.where(F.col("bytes") >= least_bytes).select("id", "digest", "bytes")
    first = cut(keys.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first"))
    return rows.join(sized(first), ["digest", "bytes"], "left").select("id", "uri", "payload", "digest", "bytes", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record_text(date: str) -> Column:
    """A record but for its last line feed, which the sink adds."""
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC.decode()), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), rid(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace("uri", "[\\x00-\\x20\\x7f]", "%20"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), rid(F.col("refers_to")), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, body, F.lit("\r\n\r"))


def write(planned: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", records_per_file: int = 2000) -> None:
    """Write the rows of ``plan`` as archive files of at most ``records_per_file`` records."""
    planned.select(record_text(date).alias("value")).write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(folder)


_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_RECORD = "ends long, whole boolean, type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, intact boolean"
_OUT = ("file", "offset", "next", "size", "type", "record_id", "refers_to", "uri", "payload_bytes", "payload_digest", "intact")


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, size, block, nth, value)``: what lies between two magics, by byte ranges of the files; ``nth`` rises within a range."""
    rows = spark.read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(folder)
    meta = {"file": "file_path", "size": "file_size", "block": "file_block_start"}
    return rows.select(*[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()], F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("value"))


def _scan(raw: bytes) -> tuple | None:
    """The fields of _RECORD and the payload of a record whose header begins the bytes; digest and payload only if it ends in them."""
    fields, pos = {}, 0
    while (f := _FIELD.match(raw, pos)) is not None:
        fields[f[1].lower()] = f[2].decode("utf-8", "replace")
        pos = f.end()
    length = fields.get(b"content-length", "")
    if raw[pos : pos + 2] != b"\r\n" or not (length.isascii() and length.isdigit() and len(length) < 19):
        return None  # no header, so no record
    begin = pos + 2
    end = begin + int(length)
    kind, digest = fields.get(b"warc-type"), (fields.get(b"warc-payload-digest") or "").removeprefix("sha1:") or None
    named = (kind, fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), fields.get(b"warc-target-uri"))
    if end + 4 > len(raw):  # it goes on behind a magic of its payload, or the file breaks off
        return (end + 4, False, *named, None, None, None, None)
    if raw[end : end + 4] != b"\r\n\r\n":
        return None
    gap = raw.find(b"\r\n\r\n", begin, end)
    start = begin if gap < 0 else gap + 4
    told = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)").search(raw, begin, start)
    own = base64.b32encode(hashlib.sha1(memoryview(raw)[start:end]).digest()).decode()
    n = int(told[1]) if kind == "revisit" and told else end - start
    return (end + 4, True, *named, n, digest if kind == "revisit" else own, kind == "revisit" or digest in (None, own), raw[start:end])


def _scanned(rows: DataFrame, carried: list[str], payloads: bool) -> DataFrame:
    """The carried columns, ``bytes`` and the fields of the record that begins each ``value``."""
    names = [c.split()[0] for c in _RECORD.split(", ")] + ["payload"] * payloads
    schema = T.StructType([*(rows.schema[c] for c in carried), T.StructField("bytes", T.LongType()), *T.StructType.fromDDL(_RECORD).fields, *[T.StructField("payload", T.BinaryType())] * payloads])
    kinds = [pa.int64(), pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches):
        for b in batches:
            got = [_scan(v.as_buffer().to_pybytes()) or (None,) * 10 for v in b.column("value")]
            found = [pa.array([g[k] for g in got], kinds[k]) for k in range(len(names))]
            size = pc.binary_length(b.column("value")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], size, *found], [*carried, "bytes", *names])

    return rows.mapInArrow(run, schema)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (file, block, nth, bytes, ...) with ``start``, the place of each piece in its file: sums by range, then within each."""
    whole = F.col("bytes") + len(MAGIC)
    before = F.coalesce(F.sum("held").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("file", "block").agg(F.sum(whole).alias("held")).select("file", "block", before.alias("before"))  # a row for each byte range
    inner = F.coalesce(F.sum(whole).over(W.partitionBy("file", "block").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inner", inner).join(ranges, ["file", "block"]).withColumn("start", F.col("before") + F.col("inner")).drop("before", "inner")


def _hops(offset: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The index of each candidate's successor among the candidates (ascending); their number where there is none."""
    n = len(offset)
    hop = np.searchsorted(offset, after)
    return np.append(np.where((hop < n) & (offset[np.minimum(hop, max(n - 1, 0))] == after), hop, n) if n else hop, n)


def reachable(offset: np.ndarray, after: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Of candidate offsets (ascending) and their successors', those on a chain from offset 0 (or from the marked ones), by pointer jumping."""
    n = len(offset)
    hop, on = _hops(offset, after), np.zeros(n + 1, bool)
    on[:n] = offset == 0 if start is None else start
    for _ in range(max(1, int(n).bit_length())):  # after round r the first 2^r records of each chain are marked
        on[hop[np.flatnonzero(on)]] = True
        hop = hop[hop]
    return on[:n]


def exits(offset: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the chain of each candidate leaves the candidates, by pointer jumping."""
    n = len(offset)
    hop = _hops(offset, after)
    last = np.where(hop[:n] < n, hop[:n], np.arange(n))  # itself, if its successor isn't among them
    for _ in range(max(1, int(n).bit_length())):
        last = last[last]
    return after[last]


def verified(edges: DataFrame) -> DataFrame:
    """``(file, offset)`` of the candidates ``(file, block, offset, next)`` that the chain from their file's start reaches.

    Chains are first followed within each byte range; what is left to a file is one pointer for each place
    where a chain enters a range, and these are followed from the file's start.
    """
    kind = "file string, block long, offset long, next long"

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        return pdf.assign(exit=exits(pdf["offset"].to_numpy(), pdf["next"].to_numpy()))

    left = cut(edges.select("file", "block", "offset", "next").groupBy("file", "block").applyInPandas(leave, kind + ", exit long"))
    doors = left.select("file", F.col("exit").alias("offset")).union(left.select("file", F.lit(0).cast("long"))).distinct()
    inner = left.join(doors, ["file", "offset"]).select("file", "offset", F.col("exit").alias("next"))

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        return pdf[reachable(pdf["offset"].to_numpy(), pdf["next"].to_numpy())][["file", "offset"]]

    entered = inner.groupBy("file").applyInPandas(enter, "file string, offset long").withColumn("on", F.lit(True))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        return pdf[reachable(pdf["offset"].to_numpy(), pdf["next"].to_numpy(), pdf["on"].to_numpy(bool))][["file", "offset"]]

    marked = left.drop("exit").join(entered, ["file", "offset"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    return marked.groupBy("file", "block").applyInPandas(follow, "file string, offset long")


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The verified records of all archive files in a folder."""
    ship(spark)
    names = [*_OUT, *["payload"] * payloads]
    seen = cut(_scanned(pieces(spark, folder), ["file", "size", "block", "nth"], payloads))
    at = _placed(seen)
    edges = cut(at.where(F.col("ends").isNotNull() & (F.col("start") > 0)).withColumns({"offset": F.col("start") - len(MAGIC), "next": F.col("start") + F.col("ends")}).where("next <= size"))
    kept = cut(edges.join(verified(edges), ["file", "offset"], "left_semi"))
    whole = kept.where("whole").select(*names)
    broken = kept.where("not whole").select("file", "offset", "next")
    if not broken.limit(1).count():
        return whole
    # records with a magic in their payload: their pieces are read again, placed and joined
    files = sized(cut(broken.select("file").distinct()))
    again = cut(pieces(spark, folder).join(files, "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long")))
    narrow = _placed(again.drop("value"))
    run = W.partitionBy("file").orderBy("start")
    heads = broken.select("file", (F.col("offset") + len(MAGIC)).alias("start"), "offset", "next")
    owned = narrow.join(heads, ["file", "start"], "left").select("file", "size", "block", "nth", "start", *[F.last(c, True).over(run).alias(c) for c in ("offset", "next")]).where("start < next")
    parts = owned.join(again.select("file", "block", "nth", "value"), ["file", "block", "nth"]).groupBy("file", "size", "offset", "next")
    rows = parts.agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p")).select("file", "size", "offset", "next", F.col("p.value").alias("parts"))
    return whole.union(_scanned(_joined(rows), ["file", "size", "offset", "next"], payloads).where("whole").select(*names))


def _joined(rows: DataFrame) -> DataFrame:
    """``value``: the parts with the magic between them."""

    def run(batches):
        for b in batches:
            value = [MAGIC.join(p) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(value, pa.binary())], [*b.schema.names[:-1], "value"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("value", T.BinaryType())]))


def id_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
