"""Artifacts: a folder of Parquet tables and a configuration row, on any file system Spark reaches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a configuration has when it doesn't say.
DEFAULTS = {"lag": 1, "stride": 1, "dt_ps": 100.0, "n_states": 0, "lat_bits": 14, "n_bits": 4, "seed": 0, "entropy": "gaussian", "cv": "tica"}


@dataclass
class Artifact:
    config: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def counts(self) -> np.ndarray:
        n = self.config["n_states"]
        out = np.zeros((n, n))
        for r in self.tables["counts"].collect():  # states^2 rows at most
            out[r.i, r.j] = r.c
        return out


def residual_type(levels: DataFrame, column: str = "q") -> str:
    """smallint, or int where a level's size needs it."""
    most = levels.agg(F.max(F.array_max(F.transform(column, F.abs)))).first()[0]
    return "smallint" if most is None or most <= 32000 else "int"


def save(spark: SparkSession, artifact: Artifact, folder: str) -> None:
    for name, df in artifact.tables.items():
        if name == "residual":
            df = df.withColumn("q", F.col("q").cast(f"array<{residual_type(df)}>"))
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    row = json.dumps(artifact.config | {"tables": sorted(artifact.tables)}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")


def load(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> Artifact:
    """Tables are read lazily; ``only`` leaves the others (such as model weights) untouched."""
    config = DEFAULTS | json.loads(spark.read.text(f"{folder}/config").first().value)
    names = config.pop("tables", [])
    return Artifact(config, {n: spark.read.parquet(f"{folder}/{n}") for n in names if only is None or n in only})


def is_artifact(spark: SparkSession, folder: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/config")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
