"""Exact percentiles per group by one distributed sort.

Durations become a frequency table (group, value, count): partial counts merge by addition, so
tables of days, imports or partitions combine without loss. The table is range-sorted by group and
value over all partitions, so a hot group spreads over many; counts per partition and group give each
partition's offset; only the order statistics at the wanted positions are located and interpolated.
The error bound is zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.operators import ordre


def newest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the state that is largest by ``order`` (nulls smallest, ties by the kept values).

    A map-side combinable ``max`` of a struct, so repeated deliveries of one key never meet in a window.
    """
    state = F.struct(*order, *[F.col(k) for k in keep if k not in order])
    return df.groupBy(key).agg(F.max(state).alias("_s")).select(key, *[F.col(f"_s.{k}").alias(k) for k in keep])


def duration_us(begin: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return micros(end) - micros(begin)


def frequencies(df: DataFrame, dimensions: list[str], value: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """``dimension, groupe, [extra], valeur, n``: how often each value occurs in each group of each dimension.

    Null values are left out; a null or blank group (space separators of Unicode only, not tabs) counts
    as the group null. This is the partial result to store per day or import.
    """
    base = df.select(*[F.when(F.col(d).rlike(r"\P{Zs}"), F.col(d)).alias(d) for d in dimensions], *extra, value.cast("long").alias("valeur")).where(F.col("valeur").isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("groupe")) for d in dimensions]))
    return base.select(pairs.alias("_d"), *extra, "valeur").select("_d.dimension", "_d.groupe", *extra, "valeur").groupBy("dimension", "groupe", *extra, "valeur").agg(F.count(F.lit(1)).alias("n"))


def merge(*tables: DataFrame) -> DataFrame:
    """One frequency table of several; exact, in any order and grouping."""
    every = reduce(DataFrame.unionByName, [t.select("dimension", "groupe", "valeur", "n") for t in tables])
    return every.groupBy("dimension", "groupe", "valeur").agg(F.sum("n").alias("n"))


def percentiles(table: DataFrame, ranks: list[float], partitions: int | None = None) -> DataFrame:
    """``dimension, groupe, n, rang (0..1), valeur (double)``; linear interpolation at rank * (n - 1).

    An empty table gives no rows; equal values share one row of the table. The sort and its offsets are
    those of ``operators.ordre``.
    """
    return ordre.percentiles(table, ["dimension", "groupe"], "valeur", ranks, partitions)
