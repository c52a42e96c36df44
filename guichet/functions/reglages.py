"""Settings: typed values read from a two-column table, defaults where a value is missing or unreadable."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Stop words that fit an expression.
MOST = 10_000


@dataclass(frozen=True)
class Reglages:
    seuil_doublons: float = 0.92
    seuil_z: float = 2.5
    seuil_tickets: int = 20
    jours_profil: int = 90
    horizon: int = 30


def read_settings(df: DataFrame) -> Reglages:
    """Of ``cle, valeur`` (text); only known keys are read, the last of equal keys by value counts."""
    known = {f.name: type(f.default) for f in fields(Reglages)}
    rows = df.where(F.col("cle").isin(*known)).groupBy("cle").agg(F.max("valeur").alias("valeur")).collect()  # at most one row per setting
    found = {}
    for r in rows:
        try:
            found[r.cle] = known[r.cle](r.valeur)
        except (TypeError, ValueError):
            continue
    return Reglages(**found)


def stop_table(spark: SparkSession, base: list[str], added: DataFrame | None = None, removed: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """``mot`` (distinct): the base list with users' own words (column ``mot``, trimmed, lower case) and the parts of
    persons' names (column ``nom``), without the removed ones. A table for an anti join; nothing reaches the driver."""
    word = lambda c: F.lower(F.trim(c)).alias("mot")
    out = spark.createDataFrame([(w,) for w in base], "mot string")
    if added is not None:
        out = out.unionByName(added.select(word("mot")))
    if names is not None:
        out = out.unionByName(names.select(F.explode(F.split(F.lower("nom"), r"[^\p{L}\p{N}]+")).alias("mot")).where(F.octet_length("mot") >= 2))
    if removed is not None:
        out = out.join(removed.select(word("mot")), "mot", "left_anti")
    return out.where(F.coalesce("mot", F.lit("")) != "").distinct()


def stop_words(base: list[str], added: DataFrame, removed: DataFrame | None = None) -> list[str]:
    """The same as a list for expressions; a vocabulary beyond ``MOST`` is an error, not a cut."""
    rows = stop_table(added.sparkSession, base, added, removed).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} stop words: join ``stop_table`` instead")
    return sorted(r.mot for r in rows)
