"""Trajectory files: DCD frames as a Spark data source, PDB topologies, NPY arrays.

The DCD source plans one partition per range of frames; a reader seeks to its range, and
keeps only the strided frames and the chosen atoms.
"""

from __future__ import annotations

import glob
import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "run_id long, t long, xyz array<double>"


class DcdHeader:
    """Counts and offsets of a DCD file (fixed atoms aren't supported)."""

    def __init__(self, f):
        first = f.read(4)
        self.order = "<" if struct.unpack("<i", first)[0] == 84 else ">"
        body = f.read(84)
        if body[:4] != b"CORD":
            raise ValueError("no DCD file")
        numbers = struct.unpack(f"{self.order}20i", body[4:])
        self.cell = bool(numbers[10])
        f.read(4)
        (title,) = struct.unpack(f"{self.order}i", f.read(4))
        f.seek(title + 4, 1)
        _, self.atoms, _ = struct.unpack(f"{self.order}3i", f.read(12))
        self.start = f.tell()
        self.frame_bytes = (56 if self.cell else 0) + 3 * (4 * self.atoms + 8)
        f.seek(0, 2)
        self.frames = (f.tell() - self.start) // self.frame_bytes

    def read(self, f, n: int) -> np.ndarray:
        """Coordinates (atoms, 3) of frame n, in the file's unit."""
        f.seek(self.start + n * self.frame_bytes + (56 if self.cell else 0))
        raw = np.frombuffer(f.read(3 * (4 * self.atoms + 8)), np.uint8).reshape(3, -1)[:, 4:-4]
        return np.ascontiguousarray(raw).view(f"{self.order}f4").T.astype(float)


class RawHeader:
    """Frames of float32 coordinates and nothing else."""

    def __init__(self, f, atoms: int):
        self.atoms, self.frame_bytes = atoms, 12 * atoms
        f.seek(0, 2)
        self.frames = f.tell() // self.frame_bytes

    def read(self, f, n: int) -> np.ndarray:
        f.seek(n * self.frame_bytes)
        return np.frombuffer(f.read(self.frame_bytes), "<f4").reshape(-1, 3).astype(float)


def open_file(path: str):
    """A file to seek in: by a URI, on the file system that it names; else a local path."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def write_dcd(path: str, frames: np.ndarray) -> None:
    """Write frames (n, atoms, 3) as a little-endian DCD without a cell."""
    n, atoms, _ = frames.shape
    block = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    head = [n, 0, 1, n, 0, 0, 0, 0, 0]
    with open(path, "wb") as f:
        f.write(block(b"CORD" + struct.pack("<9i", *head) + struct.pack("<f", 1.0) + struct.pack("<10i", *[0] * 9, 24)))
        f.write(block(struct.pack("<i", 1) + b"frames".ljust(80)))
        f.write(block(struct.pack("<i", atoms)))
        for x in frames.astype("<f4"):
            for k in range(3):
                f.write(block(x[:, k].tobytes()))


class FrameRange(InputPartition):
    """Frames ``begin`` to ``end`` of a file; ``before``: frames of the run in earlier files."""

    def __init__(self, path: str, run: int, begin: int, end: int, before: int):
        self.path, self.run, self.begin, self.end, self.before = path, run, begin, end, before


class DcdReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.runs = json.loads(options["runs"]) if options.get("runs") else [[p] for p in options["path"].split(",") if p]
        self.stride = int(options.get("stride", 1))
        self.chunk = int(options.get("chunk", 2000))
        self.raw = int(options["rawatoms"]) if options.get("rawatoms") else None
        self.scale = float(options.get("scale", 0.1 if self.raw is None else 1.0))  # Angstrom to nm
        self.pick = [int(a) for a in options["atoms"].split(",")] if options.get("atoms") else None

    def head(self, f):
        return DcdHeader(f) if self.raw is None else RawHeader(f, self.raw)

    def partitions(self) -> list[FrameRange]:
        out = []
        for run, paths in enumerate(self.runs):
            before = 0
            for path in paths:
                with open_file(path) as f:
                    n = self.head(f).frames
                out += [FrameRange(path, run, a, min(a + self.chunk, n), before) for a in range(0, n, self.chunk)]
                before += n
        return out

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        with open_file(part.path) as f:
            head = self.head(f)
            first = part.begin + -(part.begin + part.before) % self.stride  # strides go on from file to file
            wanted = list(range(first, part.end, self.stride))
            for at in range(0, len(wanted), 500):
                own = wanted[at : at + 500]
                x = [head.read(f, n) * self.scale for n in own]
                x = [v if self.pick is None else v[self.pick] for v in x]
                yield pa.RecordBatch.from_arrays([pa.array([part.run] * len(own), pa.int64()), pa.array([(n + part.before) // self.stride for n in own], pa.int64()), pa.array([v.ravel().tolist() for v in x], pa.list_(pa.float64()))], ["run_id", "t", "xyz"])


class DcdSource(DataSource):
    """``spark.read.format("dcd").option("stride", 10).option("atoms", "0,4,8").load("a.dcd,b.dcd")``: a run per file."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DcdReader:
        return DcdReader(dict(self.options))


def read_dcd(spark: SparkSession, paths: list[str | list[str]], stride: int = 1, atoms: list[int] | None = None, chunk: int = 2000, raw_atoms: int | None = None) -> DataFrame:
    """``(run_id, t, xyz)``: a run for each path (``*`` gives one for each file that it matches), or for each list of paths, whose files follow one another.

    ``raw_atoms``: the files hold float32 coordinates of so many atoms instead.
    """
    from lagfold.shipping import ship

    ship(spark)
    spark.dataSource.register(DcdSource)
    runs = [[f] for p in paths if isinstance(p, str) for f in (sorted(glob.glob(p)) if "*" in p else [p])] if all(isinstance(p, str) for p in paths) else [[p] if isinstance(p, str) else list(p) for p in paths]
    r = spark.read.format("dcd").option("stride", stride).option("chunk", chunk).option("runs", json.dumps(runs))
    r = r.option("rawatoms", raw_atoms) if raw_atoms else r
    return (r.option("atoms", ",".join(map(str, atoms))) if atoms else r).load()


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """``(atom_index, name, resname, chain, res_id, element, x, y, z)`` of a PDB file's first model, by its fixed columns."""
    lines = spark.read.text(path).select(F.col("value").alias("l"), F.monotonically_increasing_id().alias("n"))
    cut = lambda a, n: F.trim(F.substring("l", a, n))
    atoms = lines.where(F.substring("l", 1, 6).isin("ATOM  ", "HETATM"))
    element = F.nullif(F.initcap(cut(77, 2)), F.lit(""))
    return atoms.select(
        (cut(7, 5).cast("int") - 1).alias("atom_index"), cut(13, 4).alias("name"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("res_id"), element.alias("element"),
        *[cut(31 + 8 * k, 8).cast("double").alias(c) for k, c in enumerate("xyz")],
    )


def read_matrix(path: str) -> np.ndarray:
    """A counts or transition matrix from .npy or .npz (counts, C, T_msm or T, else the first array)."""
    with open_file(path) as f:
        got = np.load(io.BytesIO(f.read()))
    if isinstance(got, np.ndarray):
        return got
    return got[next((k for k in ("counts", "C", "T_msm", "T") if k in got.files), got.files[0])]
