"""Roll-up of path-like columns to every ancestor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guichet.operators.instantane import filled


def rolled_up(df: DataFrame, path: str, depth: int = 3, separator: str = " > ") -> DataFrame:
    """``chemin, niveau, n, incidents, part``: counts of every prefix of the path up to ``depth``; deeper paths count in the last level.

    Null and empty paths are left out. Paths are pre-aggregated before they are exploded.
    """
    paths = df.where(filled(F.col(path))).groupBy(F.col(path).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("type_ticket") == "Incident").alias("_i"))
    paths = paths.withColumns({"_t": F.sum("_n").over(Window.partitionBy(F.lit(1))), "_x": F.split("_p", separator)})  # one row per path
    levels = paths.withColumn("niveau", F.explode(F.sequence(F.lit(1), F.least(F.size("_x"), F.lit(depth)))))
    by = levels.groupBy(F.array_join(F.slice("_x", F.lit(1), F.col("niveau")), separator).alias("chemin"), F.col("niveau").cast("long").alias("niveau"))
    return by.agg(F.sum("_n").alias("n"), F.sum("_i").alias("incidents"), F.first("_t").alias("_t")).withColumn("part", F.round(F.col("n") * 100.0 / F.col("_t"), 1)).drop("_t")
