"""Order over whole tables: running sums, positions and exact percentiles of groups, however large a group is.

All go the same way: rows are range-sorted over all partitions (a hot group spreads over many), the sorted
table is written so that a lost executor can't move a row, sums per partition give each partition's offset,
and only rows within one partition are ever ordered by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guichet.session import cut


def _parts(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal; the right keys are dropped. Without keys each side counts as one group."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys}) if keys else right.withColumn("_r_", F.lit(1))
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] or [F.col("_l_") == F.col("_r_")]
    joined = (left if keys else left.withColumn("_l_", F.lit(1))).join(other, reduce(Column.__and__, same), how)
    return joined.drop(*[f"_r_{k}" for k in keys], "_l_", "_r_")


def running(df: DataFrame, by: list[str], order: list[str], value: str | None = None, out: str = "cumul", total: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``out``, the running sum of ``value`` (None: of 1, the position) within ``by`` in ``order``, and the group's ``total``.

    ``order`` must be total within a group, else ties fall as they come. Null keys form a group of their
    own; no keys, one group. Empty input gives no rows. Columns named ``_p``, ``_i``, ``_avant`` are taken.
    """
    amount = F.col(value) if value else F.lit(1).cast("long")
    placed = cut(df.repartitionByRange(_parts(df, partitions), *by, *order).withColumn("_p", F.spark_partition_id()), "ordre")
    sums = placed.groupBy(*by, "_p").agg(F.sum(amount).alias("_s"))  # at most groups + partitions rows
    group = Window.partitionBy(*(by or [F.lit(1)]))
    offsets = sums.withColumns({"_avant": F.sum("_s").over(group.orderBy("_p")) - F.col("_s")} | ({total: F.sum("_s").over(group)} if total else {})).drop("_s")
    inner = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _beside(placed.withColumn("_i", F.sum(amount).over(inner)), offsets, [*by, "_p"]).withColumn(out, F.col("_avant") + F.col("_i")).drop("_p", "_i", "_avant")


def frequencies(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value, n``: how often each value occurs; nulls are left out. Tables of parts add up."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def percentiles(table: DataFrame, by: list[str], value: str, ranks: list[float], partitions: int | None = None) -> DataFrame:
    """``by, n, rang (0..1), valeur (double)`` of a frequency table; linear interpolation at rank * (n - 1), no error.

    Only the order statistics at the wanted positions are located. An empty table gives no rows.
    """
    ranged = table.repartitionByRange(_parts(table, partitions), *by, value).sortWithinPartitions(*by, value).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged.select(*by, F.col(value).alias("valeur"), "n", "_p"), "tri")
    counts = ranged.groupBy(*by, "_p").agg(F.sum("n").alias("_c"))  # at most groups + partitions rows
    group = Window.partitionBy(*(by or [F.lit(1)]))
    offsets = counts.withColumns({"_avant": F.sum("_c").over(group.orderBy("_p")) - F.col("_c"), "n_total": F.sum("_c").over(group)})
    wanted = offsets.select("*", F.explode(F.array(*[F.lit(float(r)) for r in ranks])).alias("rang")).withColumn("_pos", F.col("rang") * (F.col("n_total") - 1))
    sides = wanted.select(*by, "_p", "_c", "_avant", "n_total", "rang", "_pos", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_k")).distinct()
    here = sides.where((F.col("_k") >= F.col("_avant")) & (F.col("_k") < F.col("_avant") + F.col("_c")))
    targets = here.groupBy(*by, "_p", "_avant", "n_total").agg(F.collect_list(F.struct("rang", "_pos", "_k")).alias("_t"))  # at most 2 * len(ranks) each
    joined = _beside(ranged, targets, [*by, "_p"])
    run = Window.partitionBy(*by, "_p").orderBy("valeur").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumn("_fin", F.col("_avant") + F.sum("n").over(run)).withColumn("_debut", F.col("_fin") - F.col("n"))
    hit = placed.select(*by, "n_total", "valeur", F.explode(F.filter("_t", lambda t: (t["_k"] >= F.col("_debut")) & (t["_k"] < F.col("_fin")))).alias("t"))
    low, high = F.min("valeur"), F.max("valeur")
    return hit.groupBy(*by, F.col("n_total").alias("n"), F.col("t.rang").alias("rang")).agg((low + (high - low) * (F.first("t._pos") - F.floor(F.first("t._pos")))).cast("double").alias("valeur"))


def with_percentiles(base: DataFrame, df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``base`` (one row per group) with a column per wanted percentile of ``df``'s values; null where a group has none."""
    found = percentiles(frequencies(df, by, value), by, value, sorted(set(wanted.values())))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("rang") == F.lit(float(r)), F.col("valeur"))).alias(name) for name, r in wanted.items()])
    return _beside(base, wide, by, "left")
