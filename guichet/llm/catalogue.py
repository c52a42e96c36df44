"""Queries of the training-data problems, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.llm import grappes, jetons, melange, personnes, quantiles, similarite, troncature
from guichet.session import cut, load

P2 = dict(texts=["titre", "suivis_description"], least=20, threshold=0.6)
P3 = dict(texts=["titre", "solution"], least=25, threshold=0.55)
RANKS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


FREE_TEXTS = ["suivis_description", "solution", "taches_description"]


def _given(spark: SparkSession, d: str) -> frozenset[str]:
    return personnes.given_names(load(spark, d, "tickets"), ["demandeur", "technicien_principal"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each different piece of personal data in a ticket's free texts."""
    return personnes.find(load(spark, d, "tickets"), "id", FREE_TEXTS, _given(spark, d), personnes.secret_of(spark)).select("id", "champ", "genre", "valeur")


def p1_masque(spark: SparkSession, d: str) -> DataFrame:
    """The free texts with each piece replaced by a typed, linked placeholder."""
    t = load(spark, d, "tickets").select("id", "import_id", *FREE_TEXTS)
    return personnes.mask(t, FREE_TEXTS, _given(spark, d), personnes.secret_of(spark))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tickets with nearly the same title and follow-ups."""
    return similarite.expand_pairs(*similarite.linked_classes(load(spark, d, "tickets"), "id", **P2))


def p2_groupes(spark: SparkSession, d: str) -> DataFrame:
    """One row per ticket of a near-duplicate group: its group and its class's number of links."""
    members, links = similarite.linked_classes(load(spark, d, "tickets"), "id", **P2)
    degree = links.select(F.explode(F.array("a", "b")).alias("classe")).groupBy("classe").agg(F.count(F.lit(1)).alias("liens"))
    where = grappes.blocks(links).withColumnRenamed("noeud", "classe")
    placed = members.join(where, "classe", "left").withColumn("bloc", F.coalesce("bloc", "classe")).join(degree, "classe", "left")
    return placed.join(grappes.linked_groups(placed, 2), "id").select("id", "groupe_id", F.coalesce("liens", F.lit(0)).alias("liens"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return grappes.clustered(*similarite.linked_classes(load(spark, d, "tickets"), "id", **P3))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Tickets of clusters that hang together through links, at least four tickets each."""
    return grappes.linked_groups(cut(_clusters(spark, d), "grappes"), 4)


def p3_grappes(spark: SparkSession, d: str) -> DataFrame:
    """Markov clusters of at least four tickets with their most typical ones."""
    return grappes.described(cut(_clusters(spark, d), "grappes"), typical=3, least=4)


def _newest_durations(spark: SparkSession, d: str, extra: tuple[str, ...] = ()) -> DataFrame:
    t = load(spark, d, "tickets")
    keep = ["date_ouverture", "date_resolution", "groupe_principal", "technicien_principal"]
    now = quantiles.newest(t, "id", ["import_id", "derniere_modification"], keep + ["import_id"])
    duration = quantiles.duration_us(F.col("date_ouverture"), F.col("date_resolution"))
    return quantiles.frequencies(now, ["groupe_principal", "technicien_principal"], duration, extra)


def _seconds(found: DataFrame) -> DataFrame:
    return found.select("dimension", "groupe", "n", "rang", F.round(F.col("valeur") / 1e6 + 1e-7, 4).alias("secondes"))


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles (seconds) of the resolution time per group and per assignee; error bound 0."""
    return _seconds(quantiles.percentiles(_newest_durations(spark, d), RANKS))


def p7_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The same from partial tables, one per import of the newest state, merged."""
    return _seconds(quantiles.percentiles(quantiles.merge(_newest_durations(spark, d, ("import_id",))), RANKS))


def p7_partiels(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable partial result behind both: how often each duration occurs per group and import."""
    return _newest_durations(spark, d, ("import_id",))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k."""
    return jetons.encode(load(spark, d, "documents"), "text", ["doc_id"])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = load(spark, d, "cibles_melange")
    tokens = jetons.Tokenizer(spark)
    texts = cut(melange.distinct_texts(load(spark, d, "documents"), tokens.count), "textes_distincts")
    return melange.mix(texts, targets, melange.wanted_budget(texts, targets).first()["budget"]), targets


def p9_melange(spark: SparkSession, d: str) -> DataFrame:
    """The mix, in order: as many tokens as all texts of sources with a target hold; scarce sources fall short."""
    return _mix(spark, d)[0]


def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return melange.shares(*_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return troncature.truncated(load(spark, d, "documents"), "doc_id", "text", "source")


def p10_taux(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return troncature.rates(load(spark, d, "documents"), "doc_id", "text", "source")


def p10_limites(spark: SparkSession, d: str) -> DataFrame:
    """Hidden length limits of each source, by the way of counting that shows them."""
    return troncature.limits(troncature.inspected(load(spark, d, "documents"), "doc_id", "text", "source"), "doc_id")


QUERIES = {q.__name__: q for q in (p1_found, p1_masque, p2_found, p2_groupes, p3_found, p3_grappes, p7_percentiles, p7_fusion, p7_partiels, p8_ids, p9_melange, p9_parts, p10_found, p10_taux, p10_limites)}

# Word sets in DuckDB: one row per different word of each ticket id.
_WORDS_SQL = """w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(strip_accents(coalesce(titre, '') || ' ' || coalesce({body}, ''))), '[\\p{{L}}\\p{{N}}]{{4,}}')) AS m FROM tickets),
 n AS (SELECT id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= {least}), v AS (SELECT w.id, m FROM w JOIN n USING (id)),
 c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM v a JOIN v b ON a.m = b.m AND a.id < b.id GROUP BY 1, 2),
 l AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= {t} * (x.n + y.n - c) - 1e-9)"""
_P7_SQL = """WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY import_id DESC, derniere_modification DESC NULLS LAST, date_ouverture DESC NULLS LAST, date_resolution DESC NULLS LAST) AS rn FROM tickets) WHERE rn = 1),
 d AS (SELECT 'groupe_principal' AS dimension, groupe_principal AS g, epoch_us(date_resolution) - epoch_us(date_ouverture) AS v FROM t UNION ALL
 SELECT 'technicien_principal', technicien_principal, epoch_us(date_resolution) - epoch_us(date_ouverture) FROM t),
 s AS (SELECT dimension, CASE WHEN trim(g) <> '' THEN g END AS groupe, count(*) AS n, {columns} FROM d WHERE v IS NOT NULL GROUP BY 1, 2)
 {rows}"""
_P7 = _P7_SQL.format(
    columns=", ".join(f"quantile_cont(v::DOUBLE, {r}) AS q{i}" for i, r in enumerate(RANKS)),
    rows=" UNION ALL ".join(f"SELECT dimension, groupe, n, {r}::DOUBLE AS rang, round(q{i} / 1e6 + 1e-7, 4) AS secondes FROM s" for i, r in enumerate(RANKS)),
)
ORACLES: dict[str, str] = {
    "p7_percentiles": _P7,
    "p7_fusion": _P7,
    "p7_partiels": _P7_SQL.split(",\n s AS")[0].replace("AS g,", "AS g, import_id,").replace("technicien_principal, epoch_us", "technicien_principal, import_id, epoch_us") + " SELECT dimension, CASE WHEN trim(g) <> '' THEN g END AS groupe, import_id, v AS valeur, count(*) AS n FROM d WHERE v IS NOT NULL GROUP BY ALL",
    "p2_found": "WITH " + _WORDS_SQL.format(body="suivis_description", least=P2["least"], t=P2["threshold"]) + " SELECT id_a, id_b FROM l",
    "p3_found": "WITH RECURSIVE " + _WORDS_SQL.format(body="solution", least=P3["least"], t=P3["threshold"])
    + """, e AS (SELECT id_a AS a, id_b AS b FROM l UNION SELECT id_b, id_a FROM l), r AS (SELECT a AS id, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id),
 k AS (SELECT id, min(g) AS groupe_id FROM r GROUP BY 1)
 SELECT id, groupe_id FROM k WHERE groupe_id IN (SELECT groupe_id FROM k GROUP BY 1 HAVING count(*) >= 4)""",
}
