"""Stock of live tickets: overview, by assignee and group, lookups, hierarchy, import profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guichet.operators.doublons import ranked
from guichet.operators.hierarchie import rolled_up
from guichet.operators.instantane import filled, filtered, snapshot
from guichet.operators.ordre import running, with_percentiles
from guichet.plans.registre import Registre
from guichet.session import cut, load

query = Registre()


def _live(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return snapshot(spark, d, "est_vivant", *columns).where("est_vivant")


@query("SELECT count(*) AS total, count(*) FILTER (est_vivant) AS vivants, count(*) FILTER (NOT est_vivant) AS termines FROM t")
def stock_totals(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, d, "est_vivant").agg(F.count(F.lit(1)).alias("total"), F.count_if("est_vivant").alias("vivants"), F.count_if(~F.col("est_vivant")).alias("termines"))


@query("SELECT statut, est_vivant, count(*) AS n FROM t GROUP BY ALL")
def stock_by_status(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, d, "statut", "est_vivant").groupBy("statut", "est_vivant").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(anciennete_jours), 1) AS age_moyen, quantile_cont(anciennete_jours, 0.5) AS age_median, count(*) AS n FROM t WHERE est_vivant")
def stock_age_stats(spark: SparkSession, d: str) -> DataFrame:
    live = cut(_live(spark, d, "anciennete_jours").select("anciennete_jours"), "ages")
    return with_percentiles(live.agg(F.round(F.avg("anciennete_jours"), 1).alias("age_moyen"), F.count(F.lit(1)).alias("n")), live, [], "anciennete_jours", {"age_median": 0.5})


@query("""SELECT tranche, count(*) AS n, round(count(*) * 100.0 / greatest(sum(count(*)) OVER (), 1), 6) AS part FROM
 (SELECT CASE WHEN anciennete_jours < 1 THEN '<1' WHEN anciennete_jours < 2 THEN '1' WHEN anciennete_jours < 7 THEN '2-6' WHEN anciennete_jours < 30 THEN '7-29' ELSE '30+' END AS tranche FROM t WHERE est_vivant) GROUP BY 1""")  # fmt: skip
def stock_age_buckets(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("anciennete_jours")
    bucket = F.when(a < 1, "<1").when(a < 2, "1").when(a < 7, "2-6").when(a < 30, "7-29").otherwise("30+")
    by = _live(spark, d, "anciennete_jours").groupBy(bucket.alias("tranche")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("part", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # five rows


@query("SELECT count(*) FILTER (inactivite_jours >= 14) AS inactifs_14, count(*) FILTER (inactivite_jours >= 30) AS inactifs_30, count(*) FILTER (technicien_principal IS NULL OR technicien_principal = '') AS non_affectes FROM t WHERE est_vivant")
def stock_inactive(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d, "inactivite_jours", "technicien_principal").agg(
        F.count_if(F.col("inactivite_jours") >= 14).alias("inactifs_14"), F.count_if(F.col("inactivite_jours") >= 30).alias("inactifs_30"), F.count_if(~F.coalesce(filled(F.col("technicien_principal")), F.lit(False))).alias("non_affectes")
    )


@query("SELECT type_ticket, count(*) AS n FROM t WHERE est_vivant GROUP BY 1")
def stock_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d, "type_ticket").groupBy("type_ticket").agg(F.count(F.lit(1)).alias("n"))


_BY_TECH = """SELECT technicien_principal, count(*) AS total, count(*) FILTER (type_ticket = 'Incident') AS incidents, count(*) FILTER (type_ticket = 'Demande') AS demandes,
 round(coalesce(avg(anciennete_jours), 0), 1) AS age_moyen, count(*) FILTER (inactivite_jours >= 14) AS inactifs_14,
 count(*) FILTER (statut = 'Nouveau') AS nouveaux, count(*) FILTER (statut = 'En cours (Attribué)') AS attribues, count(*) FILTER (statut = 'En cours (Planifié)') AS planifies, count(*) FILTER (statut = 'En attente') AS en_attente
 FROM t WHERE est_vivant AND technicien_principal <> ''"""
# Live statuses and the columns that count them.
_STATUSES = {"Nouveau": "nouveaux", "En cours (Attribué)": "attribues", "En cours (Planifié)": "planifies", "En attente": "en_attente"}


def _by_technician(live: DataFrame) -> DataFrame:
    return live.where(filled(F.col("technicien_principal"))).groupBy("technicien_principal").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("type_ticket") == "Incident").alias("incidents"), F.count_if(F.col("type_ticket") == "Demande").alias("demandes"),
        F.round(F.coalesce(F.avg("anciennete_jours"), F.lit(0.0)), 1).alias("age_moyen"), F.count_if(F.col("inactivite_jours") >= 14).alias("inactifs_14"),
        *[F.count_if(F.col("statut") == k).alias(n) for k, n in _STATUSES.items()],
    )


@query(_BY_TECH + " GROUP BY 1")
def stock_by_technician(spark: SparkSession, d: str) -> DataFrame:
    return _by_technician(_live(spark, d, "technicien_principal", "type_ticket", "statut", "anciennete_jours", "inactivite_jours"))


@query(_BY_TECH + " AND type_ticket = 'Incident' AND groupe_niveau1 = '_DSI' AND anciennete_jours BETWEEN 5 AND 400 GROUP BY 1")
def stock_by_technician_filtered(spark: SparkSession, d: str) -> DataFrame:
    live = _live(spark, d, "technicien_principal", "type_ticket", "statut", "anciennete_jours", "inactivite_jours", "groupe_niveau1")
    return _by_technician(filtered(live, type_ticket="Incident", groupe="_DSI", age_min=5, age_max=400))


@query("SELECT groupe_principal, groupe_niveau1, groupe_niveau2, count(*) AS total, count(DISTINCT technicien_principal) AS techniciens, round(coalesce(avg(anciennete_jours), 0), 1) AS age_moyen FROM t WHERE est_vivant AND groupe_principal <> '' GROUP BY 1, 2, 3")
def stock_by_group(spark: SparkSession, d: str) -> DataFrame:
    live = _live(spark, d, "groupe_principal", "groupe_niveau1", "groupe_niveau2", "technicien_principal", "anciennete_jours").where(filled(F.col("groupe_principal")))
    return live.groupBy("groupe_principal", "groupe_niveau1", "groupe_niveau2").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("technicien_principal").alias("techniciens"), F.round(F.coalesce(F.avg("anciennete_jours"), F.lit(0.0)), 1).alias("age_moyen"))


@query("SELECT technicien_principal, count(*) AS traites, count(*) FILTER (est_vivant) AS en_cours, count(*) FILTER (type_ticket = 'Incident') AS incidents FROM t WHERE technicien_principal <> '' GROUP BY 1")
def all_technicians(spark: SparkSession, d: str) -> DataFrame:
    t = snapshot(spark, d, "technicien_principal", "est_vivant", "type_ticket").where(filled(F.col("technicien_principal")))
    return t.groupBy("technicien_principal").agg(F.count(F.lit(1)).alias("traites"), F.count_if("est_vivant").alias("en_cours"), F.count_if(F.col("type_ticket") == "Incident").alias("incidents"))


@query("SELECT id, titre, statut, date_ouverture, array_to_string(techniciens, '|') AS techniciens, array_to_string(groupes, '|') AS groupes FROM t WHERE id = (SELECT min(id) FROM tickets)")
def ticket_detail(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tickets")
    first = t.agg(F.min("id")).first()[0]
    from guichet.operators.instantane import newest

    one = newest(t.where(F.col("id") == F.lit(first)), ["titre", "statut", "date_ouverture", "techniciens", "groupes"])  # pushed to the scan
    return one.select("id", "titre", "statut", "date_ouverture", F.array_join("techniciens", "|").alias("techniciens"), F.array_join("groupes", "|").alias("groupes"))


@query("SELECT id, titre, anciennete_jours FROM t WHERE est_vivant AND (technicien_principal IS NULL OR technicien_principal = '') ORDER BY coalesce(anciennete_jours, 0) DESC, id LIMIT 500")
def attribution_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 500 oldest unassigned tickets: a top-k report."""
    free = _live(spark, d, "titre", "anciennete_jours", "technicien_principal").where(~F.coalesce(filled(F.col("technicien_principal")), F.lit(False)))
    return free.orderBy(F.coalesce("anciennete_jours", F.lit(0)).desc(), "id").limit(500).select("id", "titre", "anciennete_jours")


@query("SELECT technicien_principal, id, coalesce(anciennete_jours, 0) AS age, row_number() OVER (PARTITION BY technicien_principal ORDER BY coalesce(anciennete_jours, 0) DESC, id) AS rang FROM t WHERE est_vivant AND technicien_principal <> ''")
def technician_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Each assignee's live tickets by age."""
    live = _live(spark, d, "technicien_principal", "anciennete_jours").where(filled(F.col("technicien_principal"))).select("technicien_principal", "id", F.coalesce("anciennete_jours", F.lit(0)).alias("age"))
    placed = ranked(live.withColumn("_rang", -F.col("age")), "technicien_principal", ["_rang", "id"])  # a hot assignee spreads over partitions
    return placed.select("technicien_principal", "id", "age", F.col("pos").cast("long").alias("rang"))


_TREE = """WITH p AS (SELECT string_split({c}, ' > ') AS parts, type_ticket FROM t WHERE {c} <> ''),
 u AS (SELECT parts, type_ticket, unnest(generate_series(1, least(len(parts), 3))) AS niveau FROM p)
 SELECT array_to_string(parts[1:niveau], ' > ') AS chemin, CAST(niveau AS BIGINT) AS niveau, count(*) AS n, count(*) FILTER (type_ticket = 'Incident') AS incidents,
 round(count(*) * 100.0 / (SELECT count(*) FROM p), 1) AS part FROM u GROUP BY 1, 2"""


@query(_TREE.format(c="categorie"))
def category_tree(spark: SparkSession, d: str) -> DataFrame:
    return rolled_up(snapshot(spark, d, "categorie", "type_ticket"), "categorie")


@query(_TREE.format(c="groupe_principal"))
def group_tree(spark: SparkSession, d: str) -> DataFrame:
    return rolled_up(snapshot(spark, d, "groupe_principal", "type_ticket"), "groupe_principal")


@query(_TREE.format(c="categorie").replace("FROM t WHERE", "FROM t WHERE est_vivant AND"))
def category_tree_live(spark: SparkSession, d: str) -> DataFrame:
    """The tree of live tickets only: the other scope of ``category_tree``."""
    return rolled_up(filtered(snapshot(spark, d, "categorie", "type_ticket", "est_vivant"), vivants=True), "categorie")


@query("SELECT id, titre, anciennete_jours, row_number() OVER (ORDER BY coalesce(anciennete_jours, 0) DESC, id) AS rang FROM t WHERE est_vivant AND (technicien_principal IS NULL OR technicien_principal = '')")
def unassigned_tickets(spark: SparkSession, d: str) -> DataFrame:
    """All unassigned live tickets with their place by age; the order runs over all partitions."""
    free = _live(spark, d, "titre", "anciennete_jours", "technicien_principal").where(~F.coalesce(filled(F.col("technicien_principal")), F.lit(False)))
    placed = running(free.select("id", "titre", "anciennete_jours", (-F.coalesce("anciennete_jours", F.lit(0))).alias("_age")), [], ["_age", "id"], out="rang")
    return placed.select("id", "titre", "anciennete_jours", "rang")


@query("SELECT count(*) AS n, round(coalesce(avg(coalesce(anciennete_jours, 0)), 0) + 1e-9, 6) AS age_moyen FROM t WHERE est_vivant AND (technicien_principal IS NULL OR technicien_principal = '')")
def unassigned_stats(spark: SparkSession, d: str) -> DataFrame:
    free = _live(spark, d, "anciennete_jours", "technicien_principal").where(~F.coalesce(filled(F.col("technicien_principal")), F.lit(False)))
    return free.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(F.coalesce("anciennete_jours", F.lit(0))), F.lit(0.0)) + 1e-9, 6).alias("age_moyen"))


@query("SELECT technicien_principal, count(*) AS n FROM t WHERE est_vivant AND contains(lower(technicien_principal), 'an') AND type_ticket = 'Demande' GROUP BY 1")
def technicians_named(spark: SparkSession, d: str) -> DataFrame:
    """Live requests of assignees whose name holds some letters, in any case: the filters of the lists."""
    live = filtered(_live(spark, d, "technicien_principal", "type_ticket"), type_ticket="Demande").where(F.contains(F.lower("technicien_principal"), F.lit("an")))
    return live.groupBy("technicien_principal").agg(F.count(F.lit(1)).alias("n"))
