"""Mining of whole ticket texts: choice of corpus, stems with their surface forms, clusters of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from guichet.functions.mots import FRENCH, PHRASES, SERVICE_DESK, stems, tokens
from guichet.functions.reglages import stop_table
from guichet.operators import corpus
from guichet.operators.vecteurs import ITERATIONS, knee
from guichet.session import cut, shared_folder

#: Name of a corpus and the column that holds it; anything else is the title.
CORPORA = {"suivis": "suivis_description", "solutions": "solution", "titre": "titre"}
#: Terms of a vocabulary for which k-means may hold its centres (k dense vectors); more is an error, not a cut.
TERMS_MOST = 2_000_000
# The silhouette from which a cluster's coherence has a name.
COHERENCE = ((0.5, "forte"), (0.25, "moyenne"))


def column_of(name: str) -> str:
    return CORPORA.get(name, "titre")


def words(t: DataFrame, name: str, names: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """``doc, terme, n`` of the words of a corpus: phrases of forms removed, stop words of the lists, of assignees' ``names`` (column nom) and of users (``own``: mot) left out."""
    counted = corpus.counts(t, "id", tokens(F.col(column_of(name)), (*FRENCH, *SERVICE_DESK), PHRASES))
    if names is None and own is None:
        return counted
    dynamic = stop_table(t.sparkSession, [], own, names=names).withColumnRenamed("mot", "terme")
    return counted.join(dynamic, "terme", "left_anti")


def stemmed(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc, terme, n`` of stems, ``terme, forme``: each stem's most frequent word). Each different word is stemmed once; ties take the last form."""
    forms = counted.groupBy("terme").agg(F.sum("n").alias("n")).withColumn("racine", F.get(stems(F.array("terme")), F.lit(0))).where(F.col("racine").isNotNull())
    forms = cut(forms, "racines")
    by = counted.join(forms.select("terme", "racine"), "terme").groupBy("doc", F.col("racine").alias("terme")).agg(F.sum("n").alias("n"))
    return by, forms.groupBy(F.col("racine").alias("terme")).agg(F.max_by("terme", F.struct("n", "terme")).alias("forme"))


def stats(tf: DataFrame, weights: DataFrame, documents: int) -> DataFrame:
    """One row: documents, words before the vocabulary, vocabulary, non-zero weights, words per document, share of empty cells."""
    total = tf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mots"))
    p = weights.agg(F.count_distinct("terme").alias("vocabulaire"), F.count(F.lit(1)).alias("non_nuls"))
    one = total.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")
    cells = F.lit(float(documents)) * F.col("vocabulaire")
    return one.select(
        F.lit(documents).cast("long").alias("documents"), "mots", "vocabulaire", "non_nuls", F.round(F.col("mots") / F.lit(float(max(documents, 1))) + 1e-9, 6).alias("moyenne"),
        F.round(F.when(cells > 0, 1 - F.col("non_nuls") / cells).otherwise(1.0) + 1e-9, 6).alias("parcimonie"),
    )


def sparse_vectors(weights: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """``doc, features`` (sparse ML vectors) of ``doc, terme, poids`` and ``terme, place``. Made by the JVM alone: the parts of
    a vector are written as its storage struct and read back as the vector type."""
    from pyspark.ml.linalg import VectorUDT

    rows = weights.join(vocabulary, "terme").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "poids"))).alias("_v"))  # as many entries as a document has words
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.transform("_v", lambda x: x["place"]).alias("indices"), F.transform("_v", lambda x: x["poids"]).alias("values"))
    path = f"{shared_folder(weights.sparkSession)}/vecteurs-{uuid.uuid4().hex}"
    rows.select("doc", parts.alias("features")).write.parquet(path)
    return weights.sparkSession.read.schema(StructType([StructField("doc", LongType()), StructField("features", VectorUDT())])).parquet(path)


def silhouettes(weights: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """``doc, cluster, silhouette`` of unit vectors by squared distances to all members of each cluster.

    The mean squared distance of x to a cluster of n unit vectors with mean m is 2 - 2 x.m, so no pairs are
    made: one join on the term with its k means. Within its own cluster x itself is left out; alone in its
    cluster x has no inner distance (0). A single cluster gives 0.
    """
    sizes = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
    size = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, n)])
    both = weights.join(placed, "doc")
    means = both.groupBy("terme").agg(F.array(*[F.sum(F.when(F.col("cluster") == c, F.col("poids")).otherwise(0.0)) / sizes.get(c, 1) for c in range(k)]).alias("m"))
    dots = both.join(means, "terme").groupBy("doc", "cluster").agg(F.array(*[F.sum(F.col("poids") * F.get("m", F.lit(c))) for c in range(k)]).alias("d"))
    far = F.transform("d", lambda x: F.greatest(2 - 2 * x, F.lit(0.0)))
    n = F.element_at(size, F.col("cluster"))
    inner = F.when(n > 1, F.get(far, F.col("cluster")) * n / (n - 1)).otherwise(0.0)
    others = [F.when(F.col("cluster") != c, F.get(far, F.lit(c))) for c in sizes]
    outer = F.least(*others) if len(others) > 1 else F.lit(None).cast("double")
    s = F.when(outer.isNull() | (F.greatest(inner, outer) == 0), 0.0).otherwise((outer - inner) / F.greatest(inner, outer))
    return dots.select("doc", "cluster", s.cast(DoubleType()).alias("silhouette"))


def text_clusters(tf: DataFrame, documents: int, low: int = 2, high: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(``doc, cluster, silhouette``, ``cluster, terme, poids, rang``): k-means of TF-IDF vectors with k at the knee of the
    inertia (else the middle), and the five heaviest terms of each centre. Documents without a word of the vocabulary are in no cluster."""
    from pyspark.ml.clustering import KMeans

    weights = cut(corpus.tfidf(tf, documents), "poids")
    terms = weights.select("terme").distinct()
    size = terms.count()
    if size > TERMS_MOST:
        raise ValueError(f"more than {TERMS_MOST} terms: raise the least document frequency")
    if not size:
        empty = weights.limit(0)
        return empty.select("doc", F.lit(0).alias("cluster"), F.lit(0.0).alias("silhouette")), empty.select(F.lit(0).alias("cluster"), "terme", "poids", F.lit(0).alias("rang"))
    places = cut(terms.withColumn("place", (F.row_number().over(Window.orderBy("terme")) - 1).cast("int")), "vocabulaire")  # a bounded vocabulary
    data = sparse_vectors(weights, places, size)
    ks = list(range(low, min(high, data.count()) + 1)) or [1]
    fits = [KMeans(k=k, seed=seed, maxIter=ITERATIONS, tol=1e-4).fit(data) for k in ks] if ks != [1] else []
    if fits:
        at = knee([f.summary.trainingCost for f in fits])
        model = fits[at if at is not None else len(fits) // 2]
        placed = cut(model.transform(data).select("doc", F.col("prediction").alias("cluster")), "places")
    else:
        placed = cut(data.select("doc", F.lit(0).alias("cluster")), "places")
    k = (placed.agg(F.max("cluster")).first()[0] or 0) + 1
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    centre = weights.join(placed, "doc").groupBy("cluster", "terme").agg(F.sum("poids").alias("_w")).join(sizes, "cluster").select("cluster", "terme", F.round(F.col("_w") / F.col("_n"), 9).alias("poids"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("poids"), "terme"))
    return silhouettes(weights, placed, k), centre.withColumn("rang", rank).where(F.col("rang") <= 5)


def described_clusters(found: DataFrame, terms: DataFrame, forms: DataFrame) -> DataFrame:
    """``cluster, taille, silhouette, coherence, etiquette`` (stems), ``mots`` (their surface forms)."""
    s = F.col("silhouette")
    named = F.when(s >= COHERENCE[0][0], COHERENCE[0][1]).when(s >= COHERENCE[1][0], COHERENCE[1][1]).otherwise("faible")
    by = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("taille"), F.round(F.avg("silhouette"), 6).alias("silhouette")).withColumn("coherence", named)
    top = terms.join(forms, "terme", "left").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rang", "terme", F.coalesce("forme", "terme").alias("forme")))).alias("_t"))  # five each
    text = lambda f: F.array_join(F.transform("_t", lambda x: x[f]), " ")
    return by.join(top, "cluster", "left").select("cluster", "taille", "silhouette", "coherence", text("terme").alias("etiquette"), text("forme").alias("mots"))
