"""Snapshots of tickets: newest state per id (upsert), registry of imports, filters, profile of an import."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.session import load

ORDER = ("import_id", "derniere_modification", "date_resolution", "nombre_suivis", "statut")


def newest(df: DataFrame, columns: list[str], key: str = "id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per key, the last written: a combinable ``max_by``, so hot keys never meet in a window.

    Only the named columns are read and shuffled. Nulls in the order count as smallest; rows equal in
    the whole order are taken to be repeats.
    """
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])


def snapshot(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The merged stock of all imports: each ticket once, in its newest state."""
    return newest(load(spark, d, "tickets"), [c for c in columns if c != "id"])


def merge(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with their key; of one key's rows in ``new`` the last by ``import_id``."""
    tagged = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in tagged.columns if c not in (key, "_src")]
    return newest(tagged, columns, key, ("_src", *ORDER))


def active_import(imports: DataFrame) -> int:
    """Id of the active import; an error if there is none."""
    row = imports.where("is_active").agg(F.max("id").alias("i")).first()
    if row is None or row["i"] is None:
        raise ValueError("no active import")
    return row["i"]


def import_history(imports: DataFrame) -> DataFrame:
    return imports.orderBy(F.desc("import_date"), F.desc("id"))


def activate(imports: DataFrame, chosen: int) -> DataFrame:
    """The registry with exactly one active import."""
    return imports.withColumn("is_active", F.col("id") == F.lit(chosen))


def active_snapshot(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The tickets of the active import, each once. The import is a filter of the scan (a partition of ``sorties.write_snapshot``)."""
    chosen = load(spark, d, "tickets").where(F.col("import_id") == F.lit(active_import(load(spark, d, "imports"))))
    return newest(chosen, [c for c in columns if c != "id"])


def replaced(tickets: DataFrame, imports: DataFrame, new: DataFrame, name: str, day: str) -> tuple[DataFrame, DataFrame]:
    """(tickets, imports) after ``new`` came in as a snapshot of its own, the only active one; nothing old is changed."""
    number = (imports.agg(F.max("id")).first()[0] or 0) + 1
    entry = imports.sparkSession.range(1).select(F.lit(number).cast("long").alias("id"), F.lit(name).alias("filename"), F.lit(day).cast("timestamp_ntz").alias("import_date"), F.lit(True).alias("is_active"))
    return tickets.unionByName(new.withColumn("import_id", F.lit(number).cast("long")), allowMissingColumns=True), activate(imports, number).unionByName(entry)


def deleted(tickets: DataFrame, imports: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(tickets, imports) without an import and all its tickets."""
    return tickets.where(F.col("import_id") != F.lit(number)), imports.where(F.col("id") != F.lit(number))


def known_file(imports: DataFrame, name: str) -> DataFrame:
    """Imports that already read a file of this name: a warning, not an error."""
    return imports.where(F.col("filename") == F.lit(name)).select("id", "filename", "import_date")


def metadata(tickets: DataFrame) -> DataFrame:
    """What the registry keeps of a stock: counts of all, live and closed tickets, first and last opening."""
    return tickets.agg(F.count(F.lit(1)).alias("lignes"), F.count_if("est_vivant").alias("vivants"), F.count_if(~F.col("est_vivant")).alias("termines"), F.min("date_ouverture").alias("premiere"), F.max("date_ouverture").alias("derniere"))


def filled(c: Column) -> Column:
    """Not null and not empty."""
    return c.isNotNull() & (c != "")


def between_days(c: Column, begin: date | str | None, end: date | str | None) -> Column:
    """Half-open day range: from the first instant of ``begin`` to the last of ``end``; each bound optional.

    Bounds are dates, or texts of a day with or without a time part, the year or the day first.
    """
    out = F.lit(True)
    if begin is not None:
        out = out & (c >= F.lit(day_bound(begin)))
    if end is not None:
        out = out & (c < F.date_add(F.lit(day_bound(end)), 1))
    return out


def day_bound(value: date | str) -> date:
    """The day of a request's bound; an unreadable one is an error."""
    if isinstance(value, date):
        return value.date() if isinstance(value, datetime) else value
    day = re.split(r"[ T]", value.strip())[0]
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y"):
        try:
            return datetime.strptime(day, form).date()
        except ValueError:
            continue
    raise ValueError(f"not a day: {value}")


def filtered(df: DataFrame, statut: str | None = None, type_ticket: str | None = None, groupe: str | None = None, age_min: int | None = None, age_max: int | None = None, vivants: bool | None = None) -> DataFrame:
    """AND of the filters given; age bounds included; ``groupe`` is the first group level."""
    for column, value in (("statut", statut), ("type_ticket", type_ticket), ("groupe_niveau1", groupe), ("est_vivant", vivants)):
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    if age_min is not None:
        df = df.where(F.col("anciennete_jours") >= age_min)
    if age_max is not None:
        df = df.where(F.col("anciennete_jours") <= age_max)
    return df


def import_profile(df: DataFrame) -> DataFrame:
    """Per import: rows, ids, live and closed, first and last opening, numbers of statuses, types, groups."""
    return df.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("lignes"), F.count_distinct("id").alias("ids"), F.count_if("est_vivant").alias("vivants"), F.count_if(~F.col("est_vivant")).alias("termines"),
        F.min("date_ouverture").alias("premiere"), F.max("date_ouverture").alias("derniere"),
        F.count_distinct("statut").alias("statuts"), F.count_distinct("type_ticket").alias("types"), F.count_distinct("groupe_principal").alias("groupes"),
    )
