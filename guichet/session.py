"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("guichet")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder. A scan: filters and columns reach Parquet."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. The session's ``spark.checkpoint.dir`` holds;
    only where it is unset (tests, local runs) a temporary one is made."""
    at = spark.conf.get(FOLDER_KEY, None) or spark.sparkContext.getConf().get(FOLDER_KEY, None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{FOLDER_KEY} must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="guichet-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set(FOLDER_KEY, at)
    return at.rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark reads; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Delete the tables ``cut`` has written for this application so far; the number of them.

    To be called when no result that reads them is needed any more: between jobs of a long session.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        remove(spark, p)
    return len(paths)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages start from replicated files, not from one executor's memory, so a lost
    executor costs its own tasks only. Parquet keeps column pruning for the readers.
    Column names must be unique (all callers select them). ``release`` deletes the tables.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
