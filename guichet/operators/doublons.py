"""Near-equal titles within groups, without comparing all pairs of a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.functions.mots import jaro_winkler_column
from guichet.operators.ordre import running
from guichet.session import cut

SMALL, REACH = 500, 30


def ranked(df: DataFrame, by: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``pos`` (from 1) within ``by`` and ``taille``, without bringing a group into one task."""
    return running(df, [by], order, out="pos", total="taille", partitions=partitions)


def similar_titles(df: DataFrame, threshold: float, small: int = SMALL, reach: int = REACH, exact: bool = False) -> DataFrame:
    """``id_a, id_b, similarite`` (id_a < id_b) of ``id, titre, groupe``: Jaro-Winkler above the threshold.

    The window mode is the known feature: groups of at most ``small`` rows are compared in full; in larger
    ones each title with the ``reach`` - 1 that follow it in order. Equi-joins on group and block of
    positions only. ``exact`` finds every pair of any group: different titles meet only where their lengths
    allow the similarity, in blocks of positions that are tasks of their own, and copies of a title share
    one comparison. Null titles are empty ones, null groups a group of their own.
    """
    if exact:
        return _all_similar(df, threshold)
    r = ranked(df, "groupe", ["titre", "id"])
    block = F.when(F.col("taille") <= small, F.lit(-1)).otherwise(F.floor(F.col("pos") / reach)).cast("long")
    a = r.select("groupe", block.alias("_b"), F.col("id").alias("_ia"), F.col("titre").alias("_ta"), F.col("pos").alias("_pa"))
    neighbours = F.when(F.col("taille") <= small, F.array(F.lit(-1).cast("long"))).otherwise(F.array(block, block - 1))
    b = r.select("groupe", F.explode(neighbours).alias("_b"), F.col("id").alias("_ib"), F.col("titre").alias("_tb"), F.col("pos").alias("_pb"))
    pairs = a.join(b, ["groupe", "_b"]).where((F.col("_pa") < F.col("_pb")) & ((F.col("_b") == -1) | (F.col("_pb") < F.col("_pa") + reach)))
    scored = pairs.withColumn("similarite", jaro_winkler_column(F.col("_ta"), F.col("_tb"), threshold)).where(F.col("similarite") > threshold)
    return scored.select(F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b"), "similarite")


def _all_similar(df: DataFrame, threshold: float, block: int = 1_000) -> DataFrame:
    """All pairs by length: with a common prefix of 4, Jaro-Winkler is at most 1 - 0.6 * (1 - (2 + shorter / longer) / 3),
    so both lengths are within a factor; titles are placed by length, and blocks of positions meet whose lengths may."""
    rows = df.select("id", F.coalesce("titre", F.lit("")).alias("titre"), F.coalesce("groupe", F.lit("Inconnu")).alias("groupe"))
    titles = rows.select("groupe", "titre").distinct().withColumn("_l", F.length("titre"))
    placed = cut(ranked(titles, "groupe", ["_l", "titre"]).withColumn("_b", F.floor((F.col("pos") - 1) / block)), "titres")
    # The least ratio shorter / longer at which the bound still exceeds the threshold.
    ratio = max(0.0, 1 - 3 * (1 - threshold) / 0.6)
    spans = placed.groupBy("groupe", "_b").agg(F.min("_l").alias("_de"), F.max("_l").alias("_a"))
    low, high = spans.select("groupe", F.col("_b").alias("_x"), F.col("_a").alias("_xa")), spans.select("groupe", F.col("_b").alias("_y"), F.col("_de").alias("_yd"))
    meets = low.join(high, "groupe").where((F.col("_x") <= F.col("_y")) & (F.col("_xa") >= F.col("_yd") * ratio))  # one row per pair of blocks
    a = placed.select("groupe", F.col("_b").alias("_x"), F.col("pos").alias("_pa"), F.col("titre").alias("_ta"), F.col("_l").alias("_la"))
    b = placed.select("groupe", F.col("_b").alias("_y"), F.col("pos").alias("_pb"), F.col("titre").alias("_tb"), F.col("_l").alias("_lb"))
    pairs = meets.join(a, ["groupe", "_x"]).join(b, ["groupe", "_y"]).where((F.col("_pa") < F.col("_pb")) & (F.col("_la") >= F.col("_lb") * ratio))
    scored = pairs.withColumn("similarite", jaro_winkler_column(F.col("_ta"), F.col("_tb"), threshold)).where(F.col("similarite") > threshold).select("groupe", "_ta", "_tb", "similarite")
    same = rows.groupBy("groupe", "titre").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("groupe", F.col("titre").alias("_ta"), F.col("titre").alias("_tb"), F.lit(1.0).alias("similarite"))
    one, two = rows.select("groupe", F.col("titre").alias("_ta"), F.col("id").alias("_ia")), rows.select("groupe", F.col("titre").alias("_tb"), F.col("id").alias("_ib"))
    found = scored.unionByName(same).join(one, ["groupe", "_ta"]).join(two, ["groupe", "_tb"]).where((F.col("_ta") != F.col("_tb")) | (F.col("_ia") < F.col("_ib")))
    return found.select(F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b"), "similarite")
