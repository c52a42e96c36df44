"""Forecast of a daily series by double exponential smoothing, folded in JVM expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_DAYS = 90
QUANTILE = 1.28


def forecast(series: DataFrame, horizon: int = 30) -> DataFrame:
    """``etape, jour, prevu, bas, haut`` for ``horizon`` days (30 if 0) after the last of ``jour, y``.

    Days without rows aren't filled. The smoothing parameters are the first of a 9 x 9 grid with the
    least mean absolute error. A series is one value per day, so one row holds it; fewer than 90 days
    are an error.
    """
    if series.count() < LEAST_DAYS:
        raise ValueError(f"a forecast needs {LEAST_DAYS} days")
    horizon = horizon or 30
    one = series.agg(F.array_sort(F.collect_list(F.struct("jour", "y"))).alias("s"))
    one = one.select(F.transform("s", lambda x: x["y"]).alias("y"), F.element_at("s", -1)["jour"].alias("dernier"))
    steps = F.array(*[F.lit(i / 10) for i in range(1, 10)])
    grid = one.withColumn("alpha", F.explode(steps)).withColumn("beta", F.explode(steps))
    first, second = F.get("y", F.lit(0)), F.get("y", F.lit(1))
    start = F.struct(first.alias("l"), (second - first).alias("b"), F.lit(0.0).alias("e"), F.lit(0.0).alias("q"), F.lit(0.0).alias("r"))

    def step(s, y):
        guess = s["l"] + s["b"]
        level = F.col("alpha") * y + (1 - F.col("alpha")) * guess
        off = y - guess
        return F.struct(level.alias("l"), (F.col("beta") * (level - s["l"]) + (1 - F.col("beta")) * s["b"]).alias("b"), (s["e"] + F.abs(off)).alias("e"), (s["q"] + off * off).alias("q"), (s["r"] + off).alias("r"))

    folded = grid.withColumn("_s", F.aggregate(F.slice("y", 2, F.size("y")), start, step)).withColumn("n", F.size("y") - 1)
    best = folded.agg(F.min_by(F.struct("_s", "n", "dernier"), F.struct(F.col("_s.e"), "alpha", "beta")).alias("m")).select("m.*")
    spread = F.sqrt((F.col("_s.q") - F.col("_s.r") * F.col("_s.r") / F.col("n")) / (F.col("n") - 1))
    out = best.withColumn("etape", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.greatest(F.lit(0.0), F.col("_s.l") + F.col("etape") * F.col("_s.b"))
    margin = F.lit(QUANTILE) * spread * F.sqrt(F.col("etape").cast("double"))
    return out.select("etape", F.date_add("dernier", F.col("etape")).alias("jour"), F.round(value + 1e-9, 4).alias("prevu"), F.round(F.greatest(F.lit(0.0), value - margin) + 1e-9, 4).alias("bas"), F.round(value + margin + 1e-9, 4).alias("haut"))
