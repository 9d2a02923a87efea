"""Runs of ordered rows: views, run-aware order, strides and row predicates.

A frame table has ``run_id`` and ``t`` (0, 1, ... within a run) and whatever describes a
frame: ``state``, feature columns, ``xyz`` (coordinates as one array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Residue names by class.
PROTEIN = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "HIE", "HID", "HIP", "HSD", "HSE", "HSP", "CYX", "CYM", "ASH", "GLH", "LYN", "ARN")
WATER = ("HOH", "WAT", "SOL", "TIP3", "TIP", "T3P", "H2O", "TIP4", "SPC")
IONS = ("NA", "CL", "K", "MG", "ZN", "CA", "FE", "NA+", "CL-", "SOD", "CLA", "POT", "MG2", "CAL", "ZN2")

EVENT_STATES = ("click", "error", "purchase", "signup", "view")


def run_window():
    return W.partitionBy("run_id").orderBy("t")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, run: str | Column, *order: str | Column) -> DataFrame:
    """Add ``run_id`` and ``t``, the row's number within its run; ``order`` must tell rows apart."""
    keyed = df.withColumn("run_id", F.col(run) if isinstance(run, str) else run)
    return keyed.withColumn("t", (F.row_number().over(W.partitionBy("run_id").orderBy(*order)) - 1).cast("long"))


def ranged(df: DataFrame, key: str, parts: int = 64) -> Column:
    """The range, 0 to ``parts`` - 1, that a key (a number, or a string in byte order) falls into; ranges of about as many rows each."""
    value = F.col(key)
    if df.schema[key].dataType.typeName() in ("string", "binary"):  # by its first bytes, which sort as it does
        value = F.conv(F.hex(F.rpad(F.substring(value.cast("binary"), 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double")
        df = df.select(value.alias(key))
    edges = sorted({*df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.25 / parts)})
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e <= value)).alias("range")


def offsets(df: DataFrame, key: str, size: str, out: str, parts: int = 64) -> DataFrame:
    """``df`` with ``out``, the sum of ``size`` over the rows with smaller keys: sums by range of the key, then within each."""
    placed = df.withColumn("_range", ranged(df, key, parts))
    sums = placed.groupBy("_range").agg(F.sum(size).alias("_n"))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = F.broadcast(sums.select("_range", ahead(W.partitionBy(F.lit(0)).orderBy("_range"), "_n").alias("_before")))  # ``parts`` rows
    rows = placed.withColumn("_inner", ahead(W.partitionBy("_range").orderBy(key), size)).join(begins, "_range")
    return rows.withColumn(out, (F.col("_before") + F.col("_inner")).cast("long")).drop("_range", "_inner", "_before")


def numbered_whole(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """Add ``run_id`` 0 and ``t``, the row's number by ``key`` in the whole table."""
    return offsets(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", "t", parts).withColumn("run_id", F.lit(0).cast("long")).drop("_one")


def state_of(name: Column, names: tuple[str, ...]) -> Column:
    """Index of a name in a fixed list; null for others."""
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(at > 0, (at - 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs by user: five states, ``value`` and the number ``k`` of the properties."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int")
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state_of(F.col("event_type"), EVENT_STATES).alias("state"), "value", k.alias("k"))
    return numbered(ev, "user_id", "ts", "event_id").select("run_id", "t", "ts", "event_id", "state", "value", "k")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two halves by time; runs don't cross the cut."""
    ev = events(spark, sf_dir).drop("t")
    half = F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'"), 0).otherwise(1)
    return ev.withColumn("half", half).withColumn("t", (F.row_number().over(W.partitionBy("run_id", "half").orderBy("ts", "event_id")) - 1).cast("long"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs by customer, three states."""
    od = table(spark, sf_dir, "orders")
    return numbered(od, "o_custkey", "o_orderdate", "o_orderkey").select("run_id", "t", state_of(F.col("o_orderstatus"), ("F", "O", "P")).alias("state"), F.col("o_totalprice").alias("value"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations")
    return numbered(cv, "conv_id", "turn").select("run_id", "t", "role", F.length("text").alias("n_chars"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs by supplier; six states (return flag and line status)."""
    li = table(spark, sf_dir, "lineitem")
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return numbered(li, "l_suppkey", *order).select("run_id", "t", F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


def coordinates(spark: SparkSession, sf_dir: str, atoms: int = 21) -> DataFrame:
    """Embeddings as one run of frames: the first 3 * atoms numbers are coordinates, the label is the state."""
    em = table(spark, sf_dir, "embeddings")
    xyz = F.slice(F.col("embedding").cast("array<double>"), 1, 3 * atoms)
    return numbered_whole(em, "vec_id").select("run_id", "t", "vec_id", F.col("label").alias("state"), xyz.alias("xyz"))


def atoms(frames: DataFrame, first: int | None = None) -> DataFrame:
    """One row per frame and atom: ``run_id, t, state, atom, x, y, z``."""
    n = F.size("xyz") / 3 if first is None else F.lit(first)
    long = frames.select("run_id", "t", "state", "xyz", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("atom"))
    at = lambda k: F.element_at("xyz", F.col("atom") * 3 + k)
    return long.select("run_id", "t", "state", "atom", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


def stride(frames: DataFrame, n: int, number: bool = True) -> DataFrame:
    """Every ``n``-th frame of each run, numbered anew; without ``number`` frames keep the ``t`` that they had."""
    every = frames.where(F.col("t") % n == 0)
    return every.withColumn("t", F.expr(f"t div {int(n)}")) if number else every


def renumbered(frames: DataFrame, span: int = 1 << 16) -> DataFrame:
    """``t`` without gaps, in the old order of ``t``: ranks within ranges of a run, and the counts of the ranges before."""
    placed = frames.withColumn("_range", F.floor(F.col("t") / span))
    counts = placed.groupBy("run_id", "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("run_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select(F.col("run_id").alias("_run"), F.col("_range").alias("_at"), before.alias("_before"))  # a row for each range
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("run_id", "_range").orderBy("t")) - 1)
    joined = ranked.join(begins, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("t", (F.col("_before") + F.col("_rank")).cast("long")).select(*frames.columns)


def evenly_spaced(n: int, most: int) -> list[int]:
    """At most ``most`` of the indices 0 to n-1, evenly spaced."""
    m = min(most, n)
    return sorted({int(k * (n - 1) / (m - 1)) if m > 1 else 0 for k in range(m)})


def classify(name: Column) -> Column:
    """protein, water, ion or other."""
    n = F.upper(name)
    return F.when(n.isin(*PROTEIN), "protein").when(n.isin(*WATER), "water").when(n.isin(*IONS), "ion").otherwise("other")


def heavy(topology: DataFrame, residues: list[str] | None = None) -> DataFrame:
    """Atoms that are known and no hydrogen, of the given residues."""
    rows = topology.where(F.col("element").isNotNull() & (F.col("element") != "H"))
    return rows if residues is None else rows.where(F.upper("resname").isin([r.upper() for r in residues]))


def uniform_dt(frames: DataFrame, time_col: str) -> DataFrame:
    """``(median_dt, uniform)`` of the differences of a time column within runs, by numpy's allclose rule."""
    diff = frames.select((F.col(time_col) - F.lag(time_col).over(run_window())).alias("dt")).where("dt is not null")
    mid = diff.agg(F.median("dt").alias("median_dt"))
    slack = F.max(F.abs(F.col("dt") - F.col("median_dt")) - (1e-6 + 1e-5 * F.abs("median_dt")))
    return diff.join(F.broadcast(mid)).groupBy("median_dt").agg((slack <= 0).alias("uniform"))  # one row


def units_guess(nn: Column) -> Column:
    return F.when((nn > 0.05) & (nn < 0.3), "nm").when((nn > 0.5) & (nn < 3), "angstrom").otherwise("unclear")
