"""Flows and resolution times: per period, running stock, distributions, dashboard sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guichet.operators.instantane import between_days, filled, snapshot
from guichet.operators.ordre import with_percentiles
from guichet.operators.periodes import MONTHS, calendar, counted, labelled, period_key, with_clamped_stock
from guichet.plans.registre import Registre
from guichet.session import cut

query = Registre()
#: The range of the ranged variants; every other query covers all days.
BEGIN, END = "2024-07-01", "2025-06-30"
TARGET_N1 = 75.0
CLOSED = ("Résolu", "Clos")
DAY_US = 86_400_000_000

_KEY_SQL = {"jour": "strftime({c}, '%Y-%m-%d')", "semaine": "strftime({c}, '%G-W%V')", "mois": "strftime({c}, '%Y-%m')", "trimestre": "year({c}) || '-Q' || quarter({c})", "annee": "strftime({c}, '%Y')"}
_RANGE = f"{{c}} >= DATE '{BEGIN}' AND {{c}} < DATE '{END}' + INTERVAL 1 DAY"
_CLOSED_SQL = "statut IN ('Résolu', 'Clos') AND date_resolution IS NOT NULL"


def days(end: Column, begin: Column) -> Column:
    """Fractional days between two times."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(end) - us(begin)) / F.lit(float(DAY_US))


_DAYS_SQL = "(epoch_us({e}) - epoch_us({b})) / 86400000000.0"
_D = _DAYS_SQL.format(e="date_resolution", b="date_ouverture")


def _opened(spark: SparkSession, d: str, *more: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    return snapshot(spark, d, "date_ouverture", *more).where(between_days(F.col("date_ouverture"), begin, end))


def _resolved(spark: SparkSession, d: str, *more: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    t = snapshot(spark, d, "date_ouverture", "date_resolution", "statut", *more)
    return t.where(F.col("statut").isin(*CLOSED) & F.col("date_resolution").isNotNull() & between_days(F.col("date_resolution"), begin, end))


def _durations(spark: SparkSession, d: str, *more: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Closed tickets with both dates, closing in the range, no negative durations."""
    t = _resolved(spark, d, *more, begin=begin, end=end).withColumn("duree", days(F.col("date_resolution"), F.col("date_ouverture")))
    return t.where(F.col("duree") >= 0)


def _bounds(df: DataFrame, *columns: str) -> tuple[str, str]:
    """First and last day of several time columns: one row of minima and maxima."""
    r = df.agg(F.least(*[F.min(c) for c in columns]).cast("date").alias("a"), F.greatest(*[F.max(c) for c in columns]).cast("date").alias("b")).first()
    return (str(r["a"]), str(r["b"])) if r["a"] else ("1970-01-01", "1970-01-01")


_DURATIONS_SQL = f"dur AS (SELECT *, {_D} AS duree FROM t WHERE {_CLOSED_SQL} AND {_D} >= 0)"


def _add_flows() -> None:
    for g, key in _KEY_SQL.items():

        def entries(spark: SparkSession, d: str, g: str = g) -> DataFrame:
            return counted(_opened(spark, d), "date_ouverture", g, "entrees")

        def exits(spark: SparkSession, d: str, g: str = g) -> DataFrame:
            return counted(_resolved(spark, d), "date_resolution", g, "sorties")

        query(f"SELECT {key.format(c='date_ouverture')} AS periode, count(*) AS entrees FROM t WHERE date_ouverture IS NOT NULL GROUP BY 1", f"flow_in_{g}")(entries)
        query(f"SELECT {key.format(c='date_resolution')} AS periode, count(*) AS sorties FROM t WHERE {_CLOSED_SQL} GROUP BY 1", f"flow_out_{g}")(exits)


_add_flows()


@query(f"SELECT strftime(date_ouverture, '%Y-%m') AS periode, count(*) AS entrees FROM t WHERE {_RANGE.format(c='date_ouverture')} GROUP BY 1")
def flow_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Monthly entries of a range of days: the ranged variant of ``flow_in_mois``."""
    return counted(_opened(spark, d, begin=BEGIN, end=END), "date_ouverture", "mois", "entrees")


@query(f"SELECT strftime(date_resolution, '%Y-%m') AS periode, count(*) AS sorties FROM t WHERE {_CLOSED_SQL} AND {_RANGE.format(c='date_resolution')} GROUP BY 1")
def flow_out_range(spark: SparkSession, d: str) -> DataFrame:
    return counted(_resolved(spark, d, begin=BEGIN, end=END), "date_resolution", "mois", "sorties")


_CALENDAR_SQL = f"""k AS (SELECT date_ouverture AS x FROM t UNION ALL SELECT date_resolution FROM t WHERE {_CLOSED_SQL}),
 cal AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(x) FROM k)), (SELECT max(x) FROM k), INTERVAL 1 MONTH)) AS debut)"""


@query(f"""WITH {_CALENDAR_SQL},
 e AS (SELECT strftime(date_ouverture, '%Y-%m') AS periode, count(*) AS n FROM t GROUP BY 1), s AS (SELECT strftime(date_resolution, '%Y-%m') AS periode, count(*) AS n FROM t WHERE {_CLOSED_SQL} GROUP BY 1),
 f AS (SELECT strftime(debut, '%Y-%m') AS periode, coalesce(e.n, 0) AS entrees, coalesce(s.n, 0) AS sorties FROM cal LEFT JOIN e ON e.periode = strftime(debut, '%Y-%m') LEFT JOIN s ON s.periode = strftime(debut, '%Y-%m')),
 c AS (SELECT *, sum(entrees - sorties) OVER (ORDER BY periode) AS c FROM f)
 SELECT periode, entrees, sorties, CAST(c - least(0, min(c) OVER (ORDER BY periode)) AS BIGINT) AS stock FROM c""")  # fmt: skip
def flow_balance_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Monthly balance on a gapless calendar of all months with a stock that never falls below 0."""
    t = cut(snapshot(spark, d, "date_ouverture", "date_resolution", "statut").select("date_ouverture", F.when(F.col("statut").isin(*CLOSED), F.col("date_resolution")).alias("date_resolution")), "flux")
    base = calendar(spark, *_bounds(t, "date_ouverture", "date_resolution"), "mois").select("periode")
    both = base.join(counted(t, "date_ouverture", "mois", "entrees"), "periode", "left").join(counted(t, "date_resolution", "mois", "sorties"), "periode", "left")
    both = both.na.fill(0, ["entrees", "sorties"]).withColumn("_d", F.col("entrees") - F.col("sorties"))
    return with_clamped_stock(both, "periode", "_d", "stock").drop("_d")


@query("SELECT greatest(count(*) FILTER (date_ouverture < DATE '2025-01-01') - count(*) FILTER (statut IN ('Résolu', 'Clos') AND date_resolution < DATE '2025-01-01'), 0) AS stock FROM t")
def stock_at_date(spark: SparkSession, d: str) -> DataFrame:
    return _stock_at(spark, d, "2025-01-01")


def _stock_at(spark: SparkSession, d: str, day: str) -> DataFrame:
    at = F.to_date(F.lit(day))
    t = snapshot(spark, d, "date_ouverture", "date_resolution", "statut")
    return t.agg(F.greatest(F.count_if(F.col("date_ouverture") < at) - F.count_if(F.col("statut").isin(*CLOSED) & (F.col("date_resolution") < at)), F.lit(0)).alias("stock"))


_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


@query(f"""WITH {_CALENDAR_SQL}, c AS (SELECT CAST(debut AS DATE) AS debut FROM cal)
 SELECT strftime(debut, '%Y-%m') AS periode, debut, CAST(debut + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS fin, {_MONTHS_SQL}[month(debut)] || ' ' || year(debut) AS libelle FROM c""")
def period_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Every month that anything happened in, with its first and last day and its label."""
    t = snapshot(spark, d, "date_ouverture", "date_resolution", "statut").select("date_ouverture", F.when(F.col("statut").isin(*CLOSED), F.col("date_resolution")).alias("date_resolution"))
    return labelled(calendar(spark, *_bounds(t, "date_ouverture", "date_resolution"), "mois"), "mois")


def _ventilation_sql(c: str) -> str:
    return f"""SELECT {c}, CAST(sum(e) AS BIGINT) AS entrees, CAST(sum(s) AS BIGINT) AS sorties, CAST(sum(e) - sum(s) AS BIGINT) AS solde FROM (
 SELECT {c}, 1 AS e, 0 AS s FROM t WHERE date_ouverture IS NOT NULL UNION ALL
 SELECT {c}, 0, 1 FROM t WHERE {_CLOSED_SQL}) WHERE {c} <> '' GROUP BY 1"""


def _ventilation(spark: SparkSession, d: str, c: str) -> DataFrame:
    """One pass over the snapshot: entries and exits are two conditional sums."""
    t = snapshot(spark, d, c, "date_ouverture", "date_resolution", "statut").where(filled(F.col(c)))
    came = F.col("date_ouverture").isNotNull()
    left = F.col("statut").isin(*CLOSED) & F.col("date_resolution").isNotNull()
    by = t.groupBy(c).agg(F.count_if(came).alias("entrees"), F.count_if(left).alias("sorties")).where((F.col("entrees") > 0) | (F.col("sorties") > 0))
    return by.withColumn("solde", F.col("entrees") - F.col("sorties"))


@query(_ventilation_sql("technicien_principal"))
def ventilation_technician(spark: SparkSession, d: str) -> DataFrame:
    return _ventilation(spark, d, "technicien_principal")


@query(_ventilation_sql("groupe_principal"))
def ventilation_group(spark: SparkSession, d: str) -> DataFrame:
    return _ventilation(spark, d, "groupe_principal")


@query(f"""WITH e AS (SELECT technicien_principal AS q, strftime(date_ouverture, '%Y-%m') AS p, count(*) AS n FROM t WHERE technicien_principal <> '' GROUP BY 1, 2),
 s AS (SELECT technicien_principal AS q, strftime(date_resolution, '%Y-%m') AS p, count(*) AS n, avg({_D}) AS m FROM t WHERE technicien_principal <> '' AND NOT est_vivant AND date_resolution IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT coalesce(e.q, s.q) AS technicien_principal, coalesce(e.p, s.p) AS periode, coalesce(e.n, 0) AS entrees, coalesce(s.n, 0) AS sorties, round(s.m + 1e-9, 6) AS mttr FROM e FULL JOIN s ON e.q = s.q AND e.p = s.p),
 c AS (SELECT *, sum(entrees - sorties) OVER (PARTITION BY technicien_principal ORDER BY periode) AS c FROM f)
 SELECT technicien_principal, periode, entrees, sorties, mttr, CAST(c - least(0, min(c) OVER (PARTITION BY technicien_principal ORDER BY periode)) AS BIGINT) AS stock FROM c""")  # fmt: skip
def technician_history(spark: SparkSession, d: str) -> DataFrame:
    """Monthly entries, exits, mean time (negatives included) and clamped stock per assignee, where anything happened."""
    t = snapshot(spark, d, "technicien_principal", "date_ouverture", "date_resolution", "est_vivant").where(filled(F.col("technicien_principal")))
    move = F.array(
        F.struct(period_key(F.col("date_ouverture"), "mois").alias("periode"), F.lit(1).alias("e"), F.lit(0).alias("s"), F.lit(None).cast("double").alias("m")),
        F.struct(
            F.when(~F.col("est_vivant"), period_key(F.col("date_resolution"), "mois")).alias("periode"), F.lit(0).alias("e"), F.lit(1).alias("s"), days(F.col("date_resolution"), F.col("date_ouverture")).alias("m")
        ),
    )
    moves = t.select("technicien_principal", F.explode(move).alias("v")).select("technicien_principal", "v.*").where(F.col("periode").isNotNull())
    by = moves.groupBy("technicien_principal", "periode").agg(F.sum("e").alias("entrees"), F.sum("s").alias("sorties"), F.round(F.avg("m") + 1e-9, 6).alias("mttr")).withColumn("_d", F.col("entrees") - F.col("sorties"))
    return with_clamped_stock(by, "periode", "_d", "stock", by=["technicien_principal"]).drop("_d")


_STATS_SQL = "count(*) AS n, round(avg(duree) + 1e-9, 6) AS moyenne, round(quantile_cont(duree, 0.5) + 1e-9, 6) AS mediane, round(quantile_cont(duree, 0.9) + 1e-9, 6) AS p90, round(stddev_pop(duree) + 1e-9, 6) AS ecart_type"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


def _stats(df: DataFrame, *by: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Count, mean, median, p90 and deviation of ``duree`` per group; the percentiles by one range sort, so no group is held by a task."""
    narrow = cut(df.select(*by, "duree"), "durees")
    base = narrow.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("duree").alias("moyenne"), F.stddev_pop("duree").alias("ecart_type"), *[c.alias(n) for n, c in (more or {}).items()])
    return _rounded(with_percentiles(base, narrow, list(by), "duree", {"mediane": 0.5, "p90": 0.9}), "moyenne", "mediane", "p90", "ecart_type")


def _within(n: int) -> Column:
    return F.round(F.count_if(F.col("duree") < n) * 100.0 / F.count(F.lit(1)) + 1e-9, 6)


def _rates() -> dict[str, Column]:
    return {"en_24h": _within(1), "en_48h": _within(2)}


_RATES_SQL = "round(count(*) FILTER (duree < 1) * 100.0 / count(*) + 1e-9, 6) AS en_24h, round(count(*) FILTER (duree < 2) * 100.0 / count(*) + 1e-9, 6) AS en_48h"


@query(f"WITH {_DURATIONS_SQL} SELECT {_STATS_SQL} FROM dur")
def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(_durations(spark, d))


@query(f"WITH {_DURATIONS_SQL} SELECT {_STATS_SQL} FROM dur WHERE {_RANGE.format(c='date_resolution')}")
def resolution_stats_range(spark: SparkSession, d: str) -> DataFrame:
    """The same for tickets closed in a range of days."""
    return _stats(_durations(spark, d, begin=BEGIN, end=END))


@query(f"WITH {_DURATIONS_SQL} SELECT {_STATS_SQL}, {_RATES_SQL} FROM dur")
def delais_kpi(spark: SparkSession, d: str) -> DataFrame:
    """Resolution times with the shares solved within one and two days."""
    return _stats(_durations(spark, d), more=_rates())


_BUCKET_SQL = "CASE WHEN duree < 1 THEN '<24h' WHEN duree < 2 THEN '24-48h' WHEN duree < 7 THEN '2-7j' WHEN duree < 30 THEN '7-30j' ELSE '>30j' END"


def _bucket(c: Column) -> Column:
    return F.when(c < 1, "<24h").when(c < 2, "24-48h").when(c < 7, "2-7j").when(c < 30, "7-30j").otherwise(">30j")


_BUCKETS_SQL = f"""SELECT tranche, ordre, n, round(n * 100.0 / sum(n) OVER () + 1e-9, 6) AS part, CAST(sum(n) OVER (ORDER BY ordre) AS BIGINT) AS cumul, round(sum(n) OVER (ORDER BY ordre) * 100.0 / sum(n) OVER () + 1e-9, 6) AS part_cumulee
 FROM (SELECT {_BUCKET_SQL} AS tranche, min(CASE WHEN duree < 1 THEN 0 WHEN duree < 2 THEN 1 WHEN duree < 7 THEN 2 WHEN duree < 30 THEN 3 ELSE 4 END) AS ordre, count(*) AS n FROM {{source}} GROUP BY 1)"""


def _buckets(df: DataFrame) -> DataFrame:
    """``duree`` in five classes: counts, shares, running totals and running shares."""
    c = F.col("duree")
    order = F.when(c < 1, 0).when(c < 2, 1).when(c < 7, 2).when(c < 30, 3).otherwise(4)
    by = df.groupBy(_bucket(c).alias("tranche"), order.alias("ordre")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # five rows
    by = by.withColumns({"cumul": F.sum("n").over(every.orderBy("ordre")), "_t": F.sum("n").over(every)})
    return by.withColumns({"part": F.round(F.col("n") * 100.0 / F.col("_t") + 1e-9, 6), "part_cumulee": F.round(F.col("cumul") * 100.0 / F.col("_t") + 1e-9, 6)}).drop("_t")


@query(f"WITH {_DURATIONS_SQL} {_BUCKETS_SQL.format(source='dur')}")
def resolution_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _buckets(_durations(spark, d))


_MTTR_SQL = """SELECT {c} AS cle, count(*) AS n, round(avg(d) + 1e-9, 6) AS moyenne, round(quantile_cont(d, 0.5) FILTER (d >= 0) + 1e-9, 6) AS mediane, count(*) FILTER (d < 0) AS negatifs,
 round(count(*) * 100.0 / (SELECT count(*) FROM t WHERE NOT est_vivant AND date_cloture_approx IS NOT NULL AND {d} >= 0) + 1e-9, 6) AS part FROM (SELECT *, {d} AS d FROM t WHERE NOT est_vivant AND date_cloture_approx IS NOT NULL) GROUP BY 1"""
_C = _DAYS_SQL.format(e="date_cloture_approx", b="date_ouverture")


def _add_mttr() -> None:
    """Mean and count keep negative durations, the median leaves them out."""
    for name, c in (("type", "type_ticket"), ("priority", "priorite_label"), ("group", "groupe_principal"), ("technician", "technicien_principal")):

        def one(spark: SparkSession, d: str, c: str = c) -> DataFrame:
            t = snapshot(spark, d, c, "est_vivant", "date_ouverture", "date_cloture_approx").where(~F.col("est_vivant") & F.col("date_cloture_approx").isNotNull())
            t = cut(t.select(F.col(c).alias("cle"), days(F.col("date_cloture_approx"), F.col("date_ouverture")).alias("d")), "durees")
            base = t.groupBy("cle").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("moyenne"), F.count_if(F.col("d") < 0).alias("negatifs"))
            base = base.withColumn("part", F.col("n") * 100.0 / F.sum(F.col("n") - F.col("negatifs")).over(Window.partitionBy(F.lit(1))))  # one row per key
            return _rounded(with_percentiles(base, t.where("d >= 0"), ["cle"], "d", {"mediane": 0.5}), "moyenne", "mediane", "part")

        query(_MTTR_SQL.format(c=c, d=_C), f"resolution_by_{name}")(one)


_add_mttr()


@query(f"""WITH x AS (SELECT strftime(date_cloture_approx, '%Y-%m') AS periode, {_C} AS duree FROM t WHERE NOT est_vivant AND date_cloture_approx IS NOT NULL AND {_C} >= 0)
 SELECT periode, {_STATS_SQL}, {_RATES_SQL} FROM x GROUP BY 1""")  # fmt: skip
def resolution_trend(spark: SparkSession, d: str) -> DataFrame:
    """By closing month: statistics and shares solved within one and two days."""
    t = snapshot(spark, d, "est_vivant", "date_ouverture", "date_cloture_approx").where(~F.col("est_vivant"))
    t = t.withColumn("duree", days(F.col("date_cloture_approx"), F.col("date_ouverture"))).where(F.col("duree") >= 0)
    return _stats(t.withColumn("periode", period_key(F.col("date_cloture_approx"), "mois")), "periode", more=_rates())


def drill_level(niveau1: str | None = None, niveau2: str | None = None, chemin: str | None = None) -> tuple[str, str | None, str | None]:
    """(column to group by, column to filter by, its value): the most specific choice alone filters, and opens the level below it."""
    if chemin is not None:
        return "categorie", "categorie", chemin
    if niveau2 is not None:
        return "categorie", "categorie_niveau2", niveau2
    if niveau1 is not None:
        return "categorie_niveau2", "categorie_niveau1", niveau1
    return "categorie_niveau1", None, None


def delais_par_categorie(durations: DataFrame, niveau1: str | None = None, niveau2: str | None = None, chemin: str | None = None) -> DataFrame:
    """Resolution times with rates per category of the level the choice opens."""
    by, column, value = drill_level(niveau1, niveau2, chemin)
    chosen = durations if column is None else durations.where(F.col(column) == F.lit(value))
    return _stats(chosen.where(filled(F.col(by))), by, more=_rates())


_LEVELS = ("categorie_niveau1", "categorie_niveau2", "categorie")


@query(f"WITH {_DURATIONS_SQL} SELECT categorie_niveau1, {_STATS_SQL}, {_RATES_SQL} FROM dur WHERE categorie_niveau1 <> '' GROUP BY 1")
def delais_by_category(spark: SparkSession, d: str) -> DataFrame:
    return delais_par_categorie(_durations(spark, d, *_LEVELS))


@query(f"WITH {_DURATIONS_SQL} SELECT categorie_niveau2, {_STATS_SQL}, {_RATES_SQL} FROM dur WHERE categorie_niveau1 = 'Réseau' AND categorie_niveau2 <> '' GROUP BY 1")
def delais_drilldown(spark: SparkSession, d: str) -> DataFrame:
    """One first level opened: a choice of the user."""
    return delais_par_categorie(_durations(spark, d, *_LEVELS), "Réseau")


@query(f"WITH {_DURATIONS_SQL}, m AS (SELECT min(categorie_niveau2) AS c FROM t WHERE categorie_niveau2 <> '') SELECT categorie, {_STATS_SQL}, {_RATES_SQL} FROM dur WHERE categorie_niveau2 = (SELECT c FROM m) AND categorie <> '' GROUP BY 1")
def delais_drilldown_path(spark: SparkSession, d: str) -> DataFrame:
    """One second level opened; a first level chosen beside it doesn't filter."""
    t = cut(_durations(spark, d, *_LEVELS), "durees")
    first = snapshot(spark, d, "categorie_niveau2").where(filled(F.col("categorie_niveau2"))).agg(F.min("categorie_niveau2")).first()[0]
    return delais_par_categorie(t, "sans effet", first or "")


@query(f"WITH {_DURATIONS_SQL} SELECT categorie_niveau1, categorie_niveau2, {_STATS_SQL}, {_RATES_SQL} FROM dur WHERE categorie_niveau1 <> '' AND categorie_niveau2 <> '' GROUP BY 1, 2")
def delais_by_subcategory(spark: SparkSession, d: str) -> DataFrame:
    """Every second level at once."""
    t = _durations(spark, d, *_LEVELS).where(filled(F.col("categorie_niveau1")) & filled(F.col("categorie_niveau2")))
    return _stats(t, "categorie_niveau1", "categorie_niveau2", more=_rates())


@query("SELECT DISTINCT categorie_niveau1 AS categorie FROM t WHERE categorie_niveau1 <> ''")
def delais_categories(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, d, "categorie_niveau1").where(filled(F.col("categorie_niveau1"))).select(F.col("categorie_niveau1").alias("categorie")).distinct()


@query(f"""WITH {_CALENDAR_SQL}, {_DURATIONS_SQL}, m AS (SELECT strftime(date_resolution, '%Y-%m') AS periode, count(*) AS n, avg(duree) AS a FROM dur GROUP BY 1)
 SELECT strftime(debut, '%Y-%m') AS periode, coalesce(n, 0) AS n, round(coalesce(a, 0) + 1e-9, 6) AS moyenne FROM cal LEFT JOIN m ON m.periode = strftime(debut, '%Y-%m')""")  # fmt: skip
def delais_trend(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled monthly trend of resolution times over all months."""
    t = cut(snapshot(spark, d, "date_ouverture", "date_resolution", "statut").select("date_ouverture", F.when(F.col("statut").isin(*CLOSED), F.col("date_resolution")).alias("date_resolution")), "durees")
    done = t.withColumn("duree", days(F.col("date_resolution"), F.col("date_ouverture"))).where(F.col("duree") >= 0)
    by = done.groupBy(period_key(F.col("date_resolution"), "mois").alias("periode")).agg(F.count(F.lit(1)).alias("n"), F.avg("duree").alias("a"))
    return calendar(spark, *_bounds(t, "date_ouverture", "date_resolution"), "mois").select("periode").join(by, "periode", "left").select("periode", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("a", F.lit(0.0)) + 1e-9, 6).alias("moyenne"))


_PICKUP_SQL = f"{_DAYS_SQL.format(e='derniere_modification', b='date_ouverture')}"


def _pickup(spark: SparkSession, d: str) -> DataFrame:
    """The delay until tickets were taken up, by proxy: last change minus opening of closed ones."""
    t = snapshot(spark, d, "est_vivant", "date_ouverture", "derniere_modification").where(~F.col("est_vivant"))
    return t.select(days(F.col("derniere_modification"), F.col("date_ouverture")).alias("duree")).where(F.col("duree").isNotNull())


@query(f"SELECT round(avg(p) + 1e-9, 6) AS moyenne, round(quantile_cont(p, 0.5) + 1e-9, 6) AS mediane, round(quantile_cont(p, 0.9) + 1e-9, 6) AS p90, count(p) AS n FROM (SELECT {_PICKUP_SQL} AS p FROM t WHERE NOT est_vivant)")
def pickup_delay(spark: SparkSession, d: str) -> DataFrame:
    return _stats(_pickup(spark, d)).drop("ecart_type")


@query(f"WITH p AS (SELECT {_PICKUP_SQL} AS duree FROM t WHERE NOT est_vivant AND derniere_modification IS NOT NULL) {_BUCKETS_SQL.format(source='p')}")
def pickup_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _buckets(_pickup(spark, d))


_N1_SQL = """count(*) AS clos,
 count(*) FILTER (coalesce(len(techniciens), 0) <= 1 AND coalesce(technicien_principal, '') <> '' AND coalesce(nombre_suivis, 0) <= 1) AS strict,
 count(*) FILTER (coalesce(len(techniciens), 0) <= 1 AND coalesce(technicien_principal, '') <> '') AS elargi,
 count(*) FILTER (coalesce(len(techniciens), 0) > 1 AND coalesce(technicien_principal, '') <> '') AS plusieurs, count(*) FILTER (coalesce(technicien_principal, '') = '') AS aucun,
 {rates} FROM t WHERE NOT est_vivant"""
_N1_RATES = {
    "taux_strict": "coalesce(len(techniciens), 0) <= 1 AND coalesce(technicien_principal, '') <> '' AND coalesce(nombre_suivis, 0) <= 1", "taux_elargi": "coalesce(len(techniciens), 0) <= 1 AND coalesce(technicien_principal, '') <> ''",
    "taux_plusieurs": "coalesce(len(techniciens), 0) > 1 AND coalesce(technicien_principal, '') <> ''", "taux_aucun": "coalesce(technicien_principal, '') = ''",
}
_N1_SQL = _N1_SQL.format(rates=", ".join(f"round(count(*) FILTER ({c}) * 100.0 / greatest(count(*), 1) + 1e-9, 1) AS {n}" for n, c in _N1_RATES.items()) + f", {TARGET_N1}::DOUBLE AS objectif")


def _n1(spark: SparkSession, d: str, by: list[Column], *more: str) -> DataFrame:
    t = snapshot(spark, d, "est_vivant", "techniciens", "technicien_principal", "nombre_suivis", *more).where(~F.col("est_vivant"))
    many, named = F.coalesce(F.size("techniciens"), F.lit(0)), F.coalesce("technicien_principal", F.lit("")) != ""
    counts = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clos"), F.count_if((many <= 1) & named & (F.coalesce("nombre_suivis", F.lit(0)) <= 1)).alias("strict"), F.count_if((many <= 1) & named).alias("elargi"),
        F.count_if((many > 1) & named).alias("plusieurs"), F.count_if(~named).alias("aucun"),
    )
    rate = lambda c: F.round(F.col(c) * 100.0 / F.greatest("clos", F.lit(1)) + 1e-9, 1)
    return counts.withColumns({f"taux_{c}": rate(c) for c in ("strict", "elargi", "plusieurs", "aucun")}).withColumn("objectif", F.lit(TARGET_N1))


@query(f"SELECT {_N1_SQL}")
def n1_rates(spark: SparkSession, d: str) -> DataFrame:
    return _n1(spark, d, [])


@query(f"SELECT groupe_principal, {_N1_SQL} GROUP BY 1")
def n1_by_group(spark: SparkSession, d: str) -> DataFrame:
    return _n1(spark, d, [F.col("groupe_principal")], "groupe_principal")


@query(f"SELECT strftime(date_cloture_approx, '%Y-%m') AS periode, {_N1_SQL} AND date_cloture_approx IS NOT NULL GROUP BY 1")
def n1_trend(spark: SparkSession, d: str) -> DataFrame:
    return _n1(spark, d, [period_key(F.col("date_cloture_approx"), "mois").alias("periode")], "date_cloture_approx").where(F.col("periode").isNotNull())


def _volumes(spark: SparkSession, d: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    came = counted(_opened(spark, d, begin=begin, end=end), "date_ouverture", "mois", "crees")
    t = snapshot(spark, d, "est_vivant", "date_cloture_approx").where(~F.col("est_vivant") & between_days(F.col("date_cloture_approx"), begin, end))
    both = came.join(counted(t, "date_cloture_approx", "mois", "resolus"), "periode", "full").na.fill(0, ["crees", "resolus"])
    return both.withColumn("ecart", F.col("crees") - F.col("resolus"))


_VOLUMES_SQL = """WITH e AS (SELECT strftime(date_ouverture, '%Y-%m') AS p, count(*) AS n FROM t WHERE {a} GROUP BY 1), s AS (SELECT strftime(date_cloture_approx, '%Y-%m') AS p, count(*) AS n FROM t WHERE NOT est_vivant AND {b} GROUP BY 1),
 v AS (SELECT coalesce(e.p, s.p) AS periode, coalesce(e.n, 0) AS crees, coalesce(s.n, 0) AS resolus, coalesce(e.n, 0) - coalesce(s.n, 0) AS ecart FROM e FULL JOIN s ON e.p = s.p)"""


@query(_VOLUMES_SQL.format(a="date_ouverture IS NOT NULL", b="date_cloture_approx IS NOT NULL") + " SELECT * FROM v")
def volumes(spark: SparkSession, d: str) -> DataFrame:
    """Created and resolved per month: a full outer join of two counts."""
    return _volumes(spark, d)


@query(_VOLUMES_SQL.format(a=_RANGE.format(c="date_ouverture"), b=_RANGE.format(c="date_cloture_approx")) + f""" SELECT CAST(sum(crees) AS BIGINT) AS crees, CAST(sum(resolus) AS BIGINT) AS resolus, round(sum(resolus)::DOUBLE / sum(crees) + 1e-9, 1) AS ratio, round(sum(crees)::DOUBLE / count(*) + 1e-9, 1) AS crees_par_mois,
 (SELECT greatest(count(*) FILTER (date_ouverture < DATE '{BEGIN}') - count(*) FILTER (statut IN ('Résolu', 'Clos') AND date_resolution < DATE '{BEGIN}'), 0) FROM t) AS stock_debut FROM v""")  # fmt: skip
def volume_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a range of days: closed against created, mean per month with any, the stock on its first day."""
    by = _volumes(spark, d, BEGIN, END)
    one = by.agg(
        F.sum("crees").alias("crees"), F.sum("resolus").alias("resolus"), F.round(F.coalesce(F.sum("resolus") / F.nullif(F.sum("crees"), F.lit(0)), F.lit(0.0)) + 1e-9, 1).alias("ratio"),
        F.round(F.sum("crees") / F.greatest(F.count(F.lit(1)), F.lit(1)) + 1e-9, 1).alias("crees_par_mois"),
    )
    return one.withColumn("_k", F.lit(1)).join(_stock_at(spark, d, BEGIN).select(F.col("stock").alias("stock_debut"), F.lit(1).alias("_k")), "_k").drop("_k")


# The order of priority labels in reports, most urgent first; others come last.
PRIORITY_ORDER = ("Majeure", "Très haute", "Haute", "Moyenne", "Basse", "Très basse")
TOP_GROUPS = 10


def _typology(spark: SparkSession, d: str, c: str) -> DataFrame:
    by = _opened(spark, d, c).groupBy(F.coalesce(c, F.lit("Non renseigné")).alias("libelle")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("part", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))) + 1e-9, 6))  # one row per label


_TYPOLOGY_SQL = "SELECT coalesce({c}, 'Non renseigné') AS libelle, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER () + 1e-9, 6) AS part FROM t GROUP BY 1"


def _add_typology() -> None:
    for name, c in (("type", "type_ticket"), ("group", "groupe_principal"), ("category", "categorie_niveau1")):

        def one(spark: SparkSession, d: str, c: str = c) -> DataFrame:
            return _typology(spark, d, c)

        query(_TYPOLOGY_SQL.format(c=c), f"typology_{name}")(one)


_add_typology()


@query(f"SELECT libelle, n, part, coalesce(list_position({list(PRIORITY_ORDER)!r}, libelle), {len(PRIORITY_ORDER) + 1}) AS ordre FROM ({_TYPOLOGY_SQL.format(c='priorite_label')}) ORDER BY ordre, libelle")
def typology_priority(spark: SparkSession, d: str) -> DataFrame:
    """Priorities in their own order."""
    place = F.array_position(F.array(*[F.lit(x) for x in PRIORITY_ORDER]), F.col("libelle"))
    return _typology(spark, d, "priorite_label").withColumn("ordre", F.when(place == 0, len(PRIORITY_ORDER) + 1).otherwise(place).cast("int")).orderBy("ordre", "libelle")


@query(_TYPOLOGY_SQL.format(c="groupe_principal") + f" ORDER BY n DESC, libelle LIMIT {TOP_GROUPS}")
def typology_top_groups(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest groups; shares are of all tickets."""
    return _typology(spark, d, "groupe_principal").orderBy(F.desc("n"), "libelle").limit(TOP_GROUPS)


@query(f"""SELECT count(*) FILTER (r) AS total, (SELECT count(*) FROM t WHERE est_vivant) AS vivants, min(date_ouverture) FILTER (r) AS premiere, max(date_ouverture) FILTER (r) AS derniere,
 count(DISTINCT technicien_principal) FILTER (r AND technicien_principal <> '') AS techniciens, count(DISTINCT groupe_principal) FILTER (r AND groupe_principal <> '') AS groupes,
 bool_or(categorie <> '') AS a_categories FROM (SELECT *, {_RANGE.format(c='date_ouverture')} AS r FROM t)""")  # fmt: skip
def dashboard_meta(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a range of days beside the live stock of today, in one scan."""
    t = snapshot(spark, d, "est_vivant", "date_ouverture", "technicien_principal", "groupe_principal", "categorie").withColumn("r", between_days(F.col("date_ouverture"), BEGIN, END))
    some = lambda c: F.count_distinct(F.when(F.col("r") & filled(F.col(c)), F.col(c)))
    return t.agg(
        F.count_if("r").alias("total"), F.count_if("est_vivant").alias("vivants"), F.min(F.when(F.col("r"), F.col("date_ouverture"))).alias("premiere"), F.max(F.when(F.col("r"), F.col("date_ouverture"))).alias("derniere"),
        some("technicien_principal").alias("techniciens"), some("groupe_principal").alias("groupes"), F.bool_or(filled(F.col("categorie"))).alias("a_categories"),
    )


#: The sections of the dashboard, each a query of its own.
DASHBOARD = (
    "dashboard_meta", "pickup_delay", "pickup_buckets", "resolution_stats", "resolution_buckets", "resolution_by_type", "resolution_by_priority", "resolution_by_group", "resolution_by_technician", "resolution_trend",
    "n1_rates", "n1_by_group", "n1_trend", "volumes", "volume_totals", "typology_type", "typology_priority", "typology_top_groups", "typology_category",
)


def dashboard(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The whole dashboard in one call: lazy sections by name, ready for ``sorties.write_report``."""
    return {name: query.queries[name](spark, d) for name in DASHBOARD}


@query(f"""SELECT * FROM (SELECT technicien_principal, count(*) AS n FROM t WHERE technicien_principal <> '' AND date_ouverture >= DATE '{BEGIN}' AND date_ouverture < DATE '{END}' GROUP BY 1)""")
def technician_history_range(spark: SparkSession, d: str) -> DataFrame:
    """Entries per assignee in the history's own range, which ends with the first instant of its last day."""
    t = snapshot(spark, d, "technicien_principal", "date_ouverture").where(filled(F.col("technicien_principal")))
    chosen = t.where((F.col("date_ouverture") >= F.to_date(F.lit(BEGIN))) & (F.col("date_ouverture") < F.to_date(F.lit(END))))
    return chosen.groupBy("technicien_principal").agg(F.count(F.lit(1)).alias("n"))
