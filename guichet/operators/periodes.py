"""Periods: keys, calendars, gap filling, running stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRANULARITIES = ("jour", "semaine", "mois", "trimestre", "annee")
_STEP = {"jour": "1 day", "semaine": "7 days", "mois": "1 month", "trimestre": "3 months", "annee": "1 year"}
_TRUNC = {"jour": "day", "semaine": "week", "mois": "month", "trimestre": "quarter", "annee": "year"}


def period_key(c: Column, granularity: str, week: str = "iso") -> Column:
    """Day, ISO week (or Monday-first week of the year, ``week='lundi'``), month, quarter or year as text. Unknown: month."""
    if granularity == "jour":
        return F.date_format(c, "yyyy-MM-dd")
    if granularity == "semaine":
        if week == "iso":
            return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
        number = F.floor((F.dayofyear(c) - 1 + 7 - F.weekday(c)) / 7)
        return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))
    if granularity == "trimestre":
        return F.concat(F.date_format(c, "yyyy"), F.lit("-Q"), F.quarter(c).cast("string"))
    return F.date_format(c, "yyyy" if granularity == "annee" else "yyyy-MM")


def auto_granularity(days: int) -> str:
    for limit, name in ((14, "jour"), (30, "semaine"), (365, "mois"), (730, "trimestre")):
        if days < limit or (name == "jour" and days == limit):
            return name
    return "annee"


def calendar(spark: SparkSession, begin: str, end: str, granularity: str) -> DataFrame:
    """``periode, debut`` of every period that touches the days begin..end; one row per period."""
    first = F.to_date(F.date_trunc(_TRUNC[granularity], F.to_date(F.lit(begin)).cast("timestamp_ntz")))
    days = F.sequence(first, F.to_date(F.lit(end)), F.expr(f"interval {_STEP[granularity]}"))
    return spark.range(1).select(F.explode(days).alias("debut")).select(period_key(F.col("debut"), granularity).alias("periode"), "debut")


# French month names of labels.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def labelled(periods: DataFrame, granularity: str) -> DataFrame:
    """Adds ``fin`` (last day) and a French ``libelle`` to a calendar, whatever the locale of the machines."""
    day = F.col("debut")
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(day) - 1)
    label = {
        "jour": F.date_format(day, "dd/MM/yyyy"), "semaine": F.concat(F.lit("S"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit(" "), F.extract(F.lit("YEAROFWEEK"), day).cast("string")),
        "trimestre": F.concat(F.lit("T"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string")), "annee": F.year(day).cast("string"),
    }.get(granularity, F.concat(month, F.lit(" "), F.year(day).cast("string")))
    step = F.expr(f"CAST(debut + interval {_STEP.get(granularity, _STEP['mois'])} AS date)")
    return periods.withColumns({"fin": F.date_sub(step, 1), "libelle": label})


def counted(df: DataFrame, when: str, granularity: str, out: str) -> DataFrame:
    return df.where(F.col(when).isNotNull()).groupBy(period_key(F.col(when), granularity).alias("periode")).agg(F.count(F.lit(1)).alias(out))


def with_clamped_stock(df: DataFrame, order: str, delta: str, out: str, opening: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``, the clamped running stock over ``delta``."""
    keys = by or []
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("_c", F.lit(opening) + F.sum(delta).over(w))
    return summed.withColumn(out, F.col("_c") - F.least(F.lit(0), F.min("_c").over(w))).drop("_c")
