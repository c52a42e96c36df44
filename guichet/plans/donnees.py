"""Queries of the general data problems: packed values, timestamps, damaged records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.operators.instants import normalise_times
from guichet.operators.valeurs import split_values
from guichet.session import load
from guichet.sources.enregistrements import judged, load_records

TIMES = ["date_ouverture", "date_resolution", "derniere_modification"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value packed in ``technicien`` or ``groupe``, with its position."""
    return split_values(load(spark, d, "glpi_ticket_raw"), ["rec_id"], ["technicien", "groupe"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each time field that names a real day and time, as UTC microseconds."""
    found = normalise_times(load(spark, d, "glpi_ticket_raw"), ["rec_id"], TIMES)
    return found.where(F.col("instant_us").isNotNull()).select("rec_id", "champ", "instant_us")


def p5_etats(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field are exact, shifted by their zone, ambiguous, nonexistent or unreadable."""
    found = normalise_times(load(spark, d, "glpi_ticket_raw"), ["rec_id"], TIMES)
    return found.groupBy("champ", "etat").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that can't be loaded, with their first reason."""
    every = judged(load(spark, d, "glpi_ticket_raw"), load(spark, d, "glpi_lignes"))
    return every.where(F.col("motif").isNotNull()).select("rec_id", "motif")


def p6_valides(spark: SparkSession, d: str) -> DataFrame:
    """The valid records of both tables, typed."""
    return load_records(load(spark, d, "glpi_ticket_raw"), load(spark, d, "glpi_lignes"))[0]


QUERIES = {q.__name__: q for q in (p4_found, p5_found, p5_etats, p6_found, p6_valides)}
