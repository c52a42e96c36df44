"""Writing results: report folders, one plan per assignee, snapshots, results kept by their parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.operators.instantane import filled

FORMATS = ("csv", "json", "parquet")


def safe_name(c: Column) -> Column:
    """A name fit for a path: letters, digits, dash and underscore; anything else becomes an underscore."""
    return F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_-]+", "_")


def write_report(sections: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Each section as a folder of its name; written in parallel by partition, header row in CSV."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    for name, df in sections.items():
        arrays = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        flat = df.withColumns({c: F.to_json(c) for c in arrays}) if kind == "csv" and arrays else df
        writer = flat.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{folder}/{name}")


def write_plans(tickets: DataFrame, folder: str, kind: str = "json", per_file: int = 100_000) -> None:
    """Live tickets in one folder per assignee (``technicien=<name>``); a hot assignee's rows spread over several files.

    Rows are salted before the shuffle, so no task writes all of one assignee.
    """
    live = tickets.where(F.col("est_vivant") & filled(F.col("technicien_principal"))).withColumn("technicien", safe_name(F.col("technicien_principal")))
    salted = live.withColumn("_sel", F.pmod(F.xxhash64("id"), F.lit(16))).repartition("technicien", "_sel").drop("_sel")
    salted.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("technicien").format(kind).save(folder)


def kept(spark: SparkSession, folder: str, key: dict[str, str | int | float], build: Callable[[], DataFrame]) -> DataFrame:
    """A result (profiles, clusters) kept under ``folder`` by its parameters: read if it was written before, else built and written."""
    path = f"{folder}/{hashlib.sha256(repr(sorted(key.items())).encode()).hexdigest()[:32]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_snapshot(tickets: DataFrame, folder: str) -> None:
    """The stored tickets as Parquet, one folder per import; only the imports at hand are replaced."""
    tickets.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(folder)
