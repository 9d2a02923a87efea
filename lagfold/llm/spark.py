"""Shared Spark helpers: written tables in the cluster's folder, joins by checked size, free names, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.shipping import ship

#: Bytes of values that a broadcast side may hold; beyond it a join shuffles.
BROADCAST_BYTES = 32 << 20


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared checkpoint folder and read it again.

    A written table outlives lost executors and, unlike a checkpointed plan, carries no
    inferred constraints from round to round of a loop.
    """
    ship(df.sparkSession)
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and that no result still reads."""
    for df in tables:
        if path := getattr(df, "_cut", None):
            remove(df.sparkSession, path)


def shared_folder(spark, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode without that setting, below a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(folder)
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _width(field: T.StructField) -> Column:
    """Bytes of a value, about."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = 8 * (1 + len(kind.elementType.fields)) if isinstance(kind.elementType, T.StructType) else 8
        return F.greatest(F.size(c), F.lit(0)) * inner + 16
    return F.lit(8)


def sized(small: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` (a written table) with a broadcast hint if its values are at most ``most`` bytes; else as it is, so that the join shuffles."""
    width = sum((_width(f).cast("long") for f in small.schema.fields), F.lit(8).cast("long"))
    held = small.agg(F.sum(width).alias("b")).first().b or 0
    return F.broadcast(small) if held <= most else small


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """The names, each lengthened until no column has it (names differ by more than case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return tuple(out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node of the edges; the root is the component's smallest node.

    Labels fall to the neighbours' minimum and then jump to their label's label, until none changes.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x != y").distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("_m")).select(F.col("x").alias("node"), F.least("x", "_m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("_m"))
        met = labels.join(near, labels.node == near.x, "left").select("node", F.col("root").alias("_old"), F.least("root", "_m").alias("_new"))
        up = labels.select(F.col("node").alias("_p"), F.col("root").alias("_pr"))
        new = cut(met.join(up, met["_new"] == up["_p"], "left").select("node", "_old", F.least("_new", "_pr").alias("root")))
        release(labels)
        if not new.where("root != _old").limit(1).count():
            release(both)
            return new.select("node", "root")
        labels = new.select("node", "root")
        labels._cut = new._cut
