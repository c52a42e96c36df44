"""Recommending assignees: category shares, closeness of words, present load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guichet.functions.mots import FRENCH, PHRASES, SERVICE_DESK, bigrams, stems, tokens
from guichet.operators.corpus import counts
from guichet.operators.instantane import filled
from guichet.session import cut

THRESHOLD, TOP, LEAST, CATEGORY_WEIGHT = 20, 3, 0.01, 0.7
HALF_LIFE = 0.693 / 30
MONTHS = 3  # how far back profiles look


def _waiting(t: DataFrame) -> DataFrame:
    return t.where(F.col("est_vivant") & ~F.coalesce(filled(F.col("technicien_principal")), F.lit(False)))


def _stock(t: DataFrame) -> DataFrame:
    live = t.where(F.col("est_vivant") & filled(F.col("technicien_principal")))
    return live.groupBy(F.col("technicien_principal").alias("technicien")).agg(F.count(F.lit(1)).alias("_stock"))


def _best(pairs: DataFrame, profiles: DataFrame, t: DataFrame, threshold: float) -> DataFrame:
    """Of (id, groupe_principal, technicien, competence): load factor, own group first, top three."""
    who = profiles.select("technicien", "groupes")
    p = pairs.join(who, "technicien").join(_stock(t), "technicien", "left")
    p = p.withColumn("_g", F.coalesce(F.array_contains("groupes", F.col("groupe_principal")), F.lit(False)))
    p = p.withColumn("_local", F.max("_g").over(Window.partitionBy("id"))).where(F.col("_g") | ~F.col("_local"))
    load = 1 + F.coalesce("_stock", F.lit(0)) / F.lit(float(threshold))
    p = p.withColumn("score", F.round(F.col("competence") / load + 1e-9, 6)).where(F.col("score") >= LEAST)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "technicien"))
    return p.withColumn("rang", rank.cast("long")).where(F.col("rang") <= TOP).select("id", "technicien", "score", "rang")


def by_category(t: DataFrame, profiles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id, technicien, score, rang``; candidates meet through the category, never as a cross product."""
    shares = profiles.select("technicien", F.explode("cat_distribution").alias("categorie_niveau1", "competence"))
    pairs = _waiting(t).select("id", "groupe_principal", "categorie_niveau1").join(shares, "categorie_niveau1")
    return _best(pairs, profiles, t, threshold)


def centroids(tf: DataFrame, owners: DataFrame, documents: int, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """(``technicien, terme, w`` of unit length, ``terme, idf``) of solved tickets weighted by recency; ``owners``: doc, technicien, poids."""
    idf = tf.groupBy("terme").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).select("terme", F.ln(1 + F.lit(float(documents)) / (1 + F.col("df"))).alias("idf"))
    docs = unit(tf.join(idf, "terme").select("doc", "terme", ((1 + F.ln("n")) * F.col("idf")).alias("w")), "doc")
    summed = docs.join(owners, "doc").groupBy("technicien", "terme").agg(F.sum(F.col("w") * F.col("poids")).alias("w"))
    return unit(summed, "technicien"), idf


def unit(df: DataFrame, key: str) -> DataFrame:
    """Vectors (key, terme, w) scaled to length 1; the norm is an aggregate and a join, not a window."""
    norm = df.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return df.join(norm, key).select(key, "terme", (F.col("w") / F.col("_n")).alias("w"))


def words(t: DataFrame, *texts: str) -> DataFrame:
    """``doc, terme, n``: stems of the texts one after the other, and their neighbours (also across two texts)."""
    split = F.concat(*[tokens(F.col(c), (*FRENCH, *SERVICE_DESK), PHRASES) for c in texts])
    s = t.select("id", stems(split).alias("_s"))
    return counts(s, "id", F.concat("_s", bigrams(F.col("_s"))))


def recent(t: DataFrame, as_of: str | None = None, months: int = MONTHS) -> DataFrame:
    """Solved tickets of named assignees with ``technicien`` and the recency weight ``poids`` (0.5 without a date).

    With ``as_of`` only those of the last ``months`` before it, and their age counts from it; without, all,
    and age counts from the last one. The date is the resolution's, else the closing's, else the last change's.
    """
    when = F.coalesce(*[F.col(c) for c in ("date_resolution", "date_cloture_approx", "derniere_modification") if c in t.columns])
    solved = t.where(~F.col("est_vivant") & filled(F.col("technicien_principal"))).withColumn("_quand", when)
    if as_of is None:
        last = F.lit(solved.agg(F.max("_quand")).first()[0])
    else:
        last = F.to_date(F.lit(as_of))
        solved = solved.where(F.col("_quand") >= F.add_months(last, -months))
    age = F.greatest(F.datediff(last, "_quand"), F.lit(0))
    return solved.withColumns({"technicien": F.col("technicien_principal"), "poids": F.coalesce(F.exp(-F.lit(HALF_LIFE) * age), F.lit(0.5))}).drop("_quand")


def category_of(t: DataFrame) -> Column:
    """The most specific level a ticket has."""
    return F.coalesce(*[F.col(c) for c in ("categorie_niveau2", "categorie_niveau1") if c in t.columns])


def category_shares(solved: DataFrame) -> DataFrame:
    """``technicien, categorie, part``: shares of an assignee's recency weights; without a category SANS_CATEGORIE."""
    by = solved.groupBy("technicien", F.coalesce(category_of(solved), F.lit("SANS_CATEGORIE")).alias("categorie")).agg(F.sum("poids").alias("_w"))
    return by.withColumn("part", F.col("_w") / F.sum("_w").over(Window.partitionBy("technicien"))).drop("_w")  # one row per category


def _cosines(asked: DataFrame, centre: DataFrame, waiting: DataFrame, profiles: DataFrame) -> DataFrame:
    """``id, technicien, cosinus`` of tickets and assignees that share a word: within the ticket's group where that has
    assignees (met on word and group, so other groups cost nothing), among all where it has none."""
    members = profiles.select("technicien", F.explode("groupes").alias("groupe_principal"))
    manned = members.select("groupe_principal").distinct()
    grouped = asked.join(waiting.select(F.col("id").alias("doc"), "groupe_principal"), "doc").join(manned.withColumn("_gens", F.lit(True)), "groupe_principal", "left")
    own = grouped.where("_gens").join(centre.join(members, "technicien"), ["terme", "groupe_principal"])
    free = grouped.where(F.col("_gens").isNull()).join(centre, "terme")
    both = own.select("doc", "technicien", "w", "v").unionByName(free.select("doc", "technicien", "w", "v"))
    return both.groupBy(F.col("doc").alias("id"), "technicien").agg(F.sum(F.col("w") * F.col("v")).alias("cosinus"))


def by_profile(t: DataFrame, profiles: DataFrame, threshold: float = THRESHOLD, weight: float = CATEGORY_WEIGHT, as_of: str | None = None, months: int = MONTHS) -> DataFrame:
    """Competence = 0.7 category share + 0.3 cosine where the category is known, else the cosine; candidates meet through words or category.

    Profiles are of title, follow-ups and solution, waiting tickets of title and follow-ups. With ``as_of`` the
    profiles and category shares are those of the last ``months``; without, of all tickets with the shares of
    ``profiles``. A ticket without a suggestion stays, with null ``technicien, score, rang``.
    """
    solved = recent(t, as_of, months)
    owners = solved.select(F.col("id").alias("doc"), "technicien", "poids")
    centre, idf = centroids(cut(words(solved, "titre", "suivis_description", "solution"), "mots"), owners, solved.count())
    waiting = _waiting(t).withColumn("categorie", category_of(t) if as_of else F.col("categorie_niveau1"))
    asked = unit(words(waiting, "titre", "suivis_description").join(idf, "terme").select("doc", "terme", ((1 + F.ln("n")) * F.col("idf")).alias("w")), "doc")
    cosine = _cosines(asked, cut(centre.withColumnRenamed("w", "v"), "profils"), waiting, profiles)
    shares = category_shares(solved) if as_of else profiles.select("technicien", F.explode("cat_distribution").alias("categorie", "part"))
    base = waiting.select("id", "groupe_principal", "categorie")
    by_share = base.join(shares, "categorie").select("id", "technicien", "part")
    both = by_share.join(cosine, ["id", "technicien"], "full").join(base, "id")
    known = filled(F.col("categorie"))
    part, cos = F.coalesce("part", F.lit(0.0)), F.coalesce("cosinus", F.lit(0.0))
    pairs = both.select("id", "groupe_principal", "technicien", F.when(F.coalesce(known, F.lit(False)), weight * part + (1 - weight) * cos).otherwise(cos).alias("competence"))
    return waiting.select("id").join(_best(pairs, profiles, t, threshold), "id", "left")
