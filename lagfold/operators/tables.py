"""Tables written between the passes of an iterative plan, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lagfold.shipping import shared_base, ship


def written(df: DataFrame) -> DataFrame:
    """``df``, written and read again: later passes neither repeat its plan nor lose it with an executor."""
    spark = df.sparkSession
    ship(spark)
    if not hasattr(written, "base"):
        written.base = {}
    base = written.base.setdefault(spark.sparkContext.applicationId, None) or shared_base(spark)
    written.base[spark.sparkContext.applicationId] = base
    path = f"{base}/pass-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
