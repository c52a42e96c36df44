"""Text mining, full-text ranking, duplicates, anomalies, forecast, recommendation, clusters of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.functions import mots
from guichet.operators import affectation, corpus, doublons, prevision, vecteurs
from guichet.operators.instantane import active_import, filled, snapshot
from guichet.operators.ordre import with_percentiles
from guichet.plans.flux import _DAYS_SQL, days
from guichet.plans.registre import Registre
from guichet.session import cut, load

query = Registre()
TOP_TERMS, TOP_EDGES = 80, 200

# The tokenizer in DuckDB, written out: tags and entities, words by letters, byte lengths, the stop words as text.
_STOP_WORDS = """
 le la les un une des du de au aux a à dans sur pour avec sans entre vers par en chez contre sous devant derrière après avant pendant depuis dès jusqu
 je tu il elle nous vous ils elles on ce cette ces celui celle ceux celles se me te lui leur y moi toi soi qui que quoi dont où lequel laquelle lesquels lesquelles
 et ou mais donc car ni si comme lorsque quand puisque parce pourtant cependant or tandis est sont ai ont était été eu fait faire être avoir peut doit va vont sera seront avait avaient serait soit faut
 ne pas plus très bien aussi encore même tout tous toute toutes autre autres trop peu beaucoup déjà alors ainsi ici là jamais toujours souvent parfois maintenant hier demain fois
 l d n s c qu j m t ça cela ceci oui non via
 bonjour bonsoir cordialement cdlt salutations merci svp veuillez madame monsieur cher chère objet ref référence ci-joint ci-dessous ci-dessus pj sujet info information
 reçu enregistré noté transmis transféré pris compte ticket incident demande numéro dossier urgent priorité date problème question aide besoin solution réponse
 système service utilisateur poste logiciel résolu clos resolu assigné
"""
_STOP = ", ".join(f"'{w}'" for w in _STOP_WORDS.split())
_HTML_SQL = "<[^>]*>|&(?:amp|lt|gt|quot|apos|nbsp);|&#[0-9]+;|&#x[0-9a-f]+;"


def _tokens_sql(text: str, key: str, source: str) -> str:
    return f"""w AS (SELECT {key} AS doc, unnest(regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '{_HTML_SQL}', ' ', 'gi')), '[\\p{{L}}][\\p{{L}}\\p{{N}}]*')) AS terme FROM {source}),
 tf AS (SELECT doc, terme, count(*) AS n FROM w WHERE strlen(terme) BETWEEN 2 AND 30 AND terme NOT IN ({_STOP}) GROUP BY 1, 2)"""


_TFIDF_SQL = """df AS (SELECT terme, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
 raw AS (SELECT doc, terme, df, (1 + ln(n)) * ln(1 + (SELECT count(*) FROM {docs})::DOUBLE / (1 + df)) AS w FROM tf JOIN df USING (terme)),
 p AS (SELECT doc, terme, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS poids FROM raw),
 k AS (SELECT terme, round(sum(poids), 6) AS score, min(df) AS df FROM p GROUP BY 1)"""
_TITLES = "WITH " + _tokens_sql("titre", "id", "t") + ", " + _TFIDF_SQL.format(docs="t")


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = snapshot(spark, d, "titre")
    return t, corpus.counts(t, "id", mots.tokens(F.col("titre")))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    t, tf = _titles(spark, d)
    return corpus.tfidf(tf, t.count())


@query(_TITLES + " SELECT (SELECT count(*) FROM t) AS documents, (SELECT CAST(sum(n) AS BIGINT) FROM tf) AS mots, (SELECT count(*) FROM df) AS vocabulaire, (SELECT count(*) FROM p) AS non_nuls")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words before the vocabulary, vocabulary, non-zero weights."""
    t, tf = _titles(spark, d)
    n = t.count()
    total = tf.agg(F.sum("n").alias("mots"))
    p = corpus.tfidf(tf, n).agg(F.count_distinct("terme").alias("vocabulaire"), F.count(F.lit(1)).alias("non_nuls"))
    return total.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").select(F.lit(n).cast("long").alias("documents"), "mots", "vocabulaire", "non_nuls")


@query(_TITLES + " SELECT doc, terme, round(poids + 1e-9, 6) AS poids FROM p")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).select("doc", "terme", F.round(F.col("poids") + 1e-9, 6).alias("poids"))


@query(_TITLES + " SELECT terme, score, df FROM k ORDER BY score DESC, terme LIMIT 50")
def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return corpus.keywords(_weights(spark, d), 50)


@query(_TITLES + """, g AS (SELECT groupe_principal AS groupe, terme, round(sum(poids), 6) AS score, count(*) AS df FROM p JOIN t ON t.id = p.doc WHERE groupe_principal <> '' GROUP BY 1, 2)
 SELECT groupe, terme, score, df, rang FROM (SELECT *, row_number() OVER (PARTITION BY groupe ORDER BY score DESC, terme) AS rang FROM g) WHERE rang <= 20""")  # fmt: skip
def top_keywords_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the titles of each named group."""
    groups = snapshot(spark, d, "groupe_principal").where(filled(F.col("groupe_principal"))).select(F.col("id").alias("doc"), F.col("groupe_principal").alias("groupe"))
    return corpus.group_keywords(_weights(spark, d), groups, 20)


@query(_TITLES + " SELECT terme, doc AS id FROM tf WHERE terme IN (SELECT terme FROM k ORDER BY score DESC, terme LIMIT 20)")
def keyword_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the top keywords."""
    t, tf = _titles(spark, d)
    top = corpus.keywords(corpus.tfidf(tf, t.count()), 20)
    return tf.join(top, "terme", "left_semi").select("terme", F.col("doc").alias("id"))


_EDGES = _TITLES + f""", top AS (SELECT terme FROM k ORDER BY score DESC, terme LIMIT {TOP_TERMS}), c AS (SELECT doc, terme FROM tf WHERE terme IN (SELECT terme FROM top)),
 e AS (SELECT a.terme AS terme_a, b.terme AS terme_b, count(*) AS n FROM c a JOIN c b ON a.doc = b.doc AND a.terme < b.terme GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, terme_a, terme_b LIMIT {TOP_EDGES})"""  # fmt: skip


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, tf = _titles(spark, d)
    top = corpus.keywords(corpus.tfidf(tf, t.count()), TOP_TERMS)
    return tf, corpus.cooccurrences(tf, top).orderBy(F.desc("n"), "terme_a", "terme_b").limit(TOP_EDGES)


@query(_EDGES + " SELECT terme_a, terme_b, n FROM e")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)[1]


@query(_EDGES + " SELECT terme, count(*) AS voisins, CAST(sum(n) AS BIGINT) AS force FROM (SELECT terme_a AS terme, n FROM e UNION ALL SELECT terme_b, n FROM e) GROUP BY 1")
def cooccurrence_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)[1]
    both = e.select(F.explode(F.array("terme_a", "terme_b")).alias("terme"), "n")
    return both.groupBy("terme").agg(F.count(F.lit(1)).alias("voisins"), F.sum("n").alias("force"))


@query(_EDGES + ", f AS (SELECT * FROM e ORDER BY n DESC, terme_a, terme_b LIMIT 1) SELECT x.doc AS id FROM tf x JOIN tf y ON x.doc = y.doc JOIN f ON x.terme = terme_a AND y.terme = terme_b")
def edge_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets that hold both words of the strongest edge: an intersection of postings."""
    tf, e = _edges(spark, d)
    a, b = e.orderBy(F.desc("n"), "terme_a", "terme_b").first()[:2]
    return tf.where(F.col("terme") == a).select(F.col("doc").alias("id")).intersect(tf.where(F.col("terme") == b).select(F.col("doc").alias("id")))


_ROOT = "demande"
_RAW = "WITH w AS (SELECT id AS doc, unnest(regexp_extract_all(lower(regexp_replace(coalesce(titre, ''), '" + _HTML_SQL + "', ' ', 'gi')), '[\\p{L}][\\p{L}\\p{N}]*')) AS terme FROM t), tf AS (SELECT DISTINCT doc, terme FROM w WHERE strlen(terme) BETWEEN 4 AND 30)"


@query(_RAW + f""", l1 AS (SELECT * FROM (SELECT y.terme, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, y.terme) AS r FROM tf x JOIN tf y ON x.doc = y.doc WHERE x.terme = '{_ROOT}' AND y.terme <> '{_ROOT}' GROUP BY 1 HAVING count(*) >= 2) WHERE r <= 12),
 l2 AS (SELECT * FROM (SELECT l1.terme AS p, z.terme, count(*) AS n, row_number() OVER (PARTITION BY l1.terme ORDER BY count(*) DESC, z.terme) AS r FROM l1 JOIN tf y ON y.terme = l1.terme JOIN tf x ON x.doc = y.doc AND x.terme = '{_ROOT}' JOIN tf z ON z.doc = y.doc
 WHERE z.terme NOT IN ('{_ROOT}', l1.terme) GROUP BY 1, 2 HAVING count(*) >= 2) WHERE r <= 5)
 SELECT '{_ROOT}|' || terme AS chaine, '{_ROOT}' AS parent, terme, CAST(1 AS BIGINT) AS profondeur, n FROM l1 UNION ALL SELECT '{_ROOT}|' || p || '|' || terme, '{_ROOT}|' || p, terme, 2, n FROM l2""")  # fmt: skip
def mindmap_depth2(spark: SparkSession, d: str) -> DataFrame:
    return _mindmap(spark, d, 2)


def _mindmap(spark: SparkSession, d: str, depth: int) -> DataFrame:
    words = F.filter(mots.tokens(F.col("titre"), ()), lambda w: F.octet_length(w) >= 4)
    return corpus.mind_map(corpus.counts(snapshot(spark, d, "titre"), "id", words), _ROOT, depth=depth)


@query()
def mindmap_depth5(spark: SparkSession, d: str) -> DataFrame:
    """The mind map to its full depth (no SQL: a data-dependent recursion)."""
    return _mindmap(spark, d, 5)


def _bm25_sql(hits: str, count: int, also: str = "") -> str:
    return (
        "WITH "
        + _tokens_sql("text", "doc_id", "documents")
        + f""", h AS (SELECT doc, CAST(sum(n) AS BIGINT) AS longueur FROM tf GROUP BY 1), l AS (SELECT doc_id AS doc, coalesce(longueur, 0) AS longueur FROM documents LEFT JOIN h ON h.doc = doc_id),
 q AS (SELECT doc, q, sum(n) AS n FROM ({hits}) GROUP BY 1, 2), dq AS (SELECT q, count(*) AS df FROM q GROUP BY 1),
 s AS (SELECT doc, round(sum(ln(1 + ((SELECT count(*) FROM l)::DOUBLE - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * longueur / (SELECT avg(longueur) FROM l)))) + 1e-9, 6) AS score, count(*) AS c FROM q JOIN dq USING (q) JOIN l USING (doc) GROUP BY 1)
 SELECT doc, score FROM s WHERE c = {count} {also}"""
    )


def _search(spark: SparkSession, d: str, words: list[str], prefixes: list[str]) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    words_of = mots.tokens(F.col("text"))
    tf = corpus.counts(docs, "doc_id", words_of)
    lengths = docs.select(F.col("doc_id").alias("doc"), F.size(words_of).cast("long").alias("longueur"))
    return corpus.bm25(tf, lengths, words, prefixes)


@query(_bm25_sql("SELECT doc, terme AS q, n FROM tf WHERE terme IN ('serveur', 'mémoire')", 2), newest=False)
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Documents with both words, ranked."""
    return _search(spark, d, ["serveur", "mémoire"], [])


@query(_bm25_sql("SELECT doc, 'imprim*' AS q, n FROM tf WHERE terme LIKE 'imprim%'", 1, "AND doc NOT IN (SELECT doc FROM tf WHERE terme = 'panne')"), newest=False)
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a word that begins so, without those of another word."""
    found = _search(spark, d, [], ["imprim"])
    docs = load(spark, d, "documents").select("doc_id", "text")
    without = corpus.counts(docs, "doc_id", mots.tokens(F.col("text"))).where(F.col("terme") == "panne").select("doc")
    return found.join(without, "doc", "left_anti")


@query()
def stemmed_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Top stems with their most frequent word (no SQL: DuckDB has no stemmer here)."""
    t = snapshot(spark, d, "titre")
    words = t.select("id", F.explode(mots.tokens(F.col("titre"))).alias("mot"))
    vocabulary = words.groupBy("mot").agg(F.count(F.lit(1)).alias("n"))
    stemmed = vocabulary.withColumn("racine", F.get(mots.stems(F.array("mot")), F.lit(0))).where(F.col("racine").isNotNull())
    by = stemmed.groupBy("racine").agg(F.sum("n").alias("n"), F.max_by("mot", F.struct("n", "mot")).alias("mot"))
    return by.orderBy(F.desc("n"), "racine").limit(100)


# DuckDB's similarity compares bytes: accented letters are written there as single bytes of their own, one for each letter.
_ACCENTS = "àâäáçéèêëîïíñôöóûùüúÿœæ"
_BYTES = " || ".join(f"chr({n})" for n in (*range(1, 9), *range(14, 32))[: len(_ACCENTS)])
_JW = f"""WITH g AS (SELECT id, lower(coalesce(titre, '')) AS titre, translate(lower(coalesce(titre, '')), '{_ACCENTS}', {_BYTES}) AS octets, coalesce(groupe_principal, 'Inconnu') AS groupe FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY groupe ORDER BY titre, id) AS pos, count(*) OVER (PARTITION BY groupe) AS taille FROM g),
 s AS (SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, jaro_winkler_similarity(a.octets, b.octets) AS s FROM r a JOIN r b ON a.groupe = b.groupe AND a.pos < b.pos AND (a.taille <= 500 OR b.pos < a.pos + 30))
 SELECT id_a, id_b, round(s + 1e-9, 6) AS similarite FROM s WHERE s > 0.92"""


def _lower_titles(spark: SparkSession, d: str) -> DataFrame:
    t = snapshot(spark, d, "titre", "groupe_principal")
    return t.select("id", F.lower(F.coalesce("titre", F.lit(""))).alias("titre"), F.coalesce("groupe_principal", F.lit("Inconnu")).alias("groupe"))


@query(_JW)
def duplicates_jw(spark: SparkSession, d: str) -> DataFrame:
    """Titles of one group that are nearly equal: all pairs of small groups, a sliding window of sorted titles in large ones."""
    return doublons.similar_titles(_lower_titles(spark, d), 0.92).select("id_a", "id_b", F.round(F.col("similarite") + 1e-9, 6).alias("similarite"))


@query(_JW + " ORDER BY similarite DESC, id_a, id_b LIMIT 200")
def duplicates_top(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most similar pairs of the report."""
    return duplicates_jw(spark, d).orderBy(F.desc("similarite"), "id_a", "id_b").limit(200)


_D = _DAYS_SQL.format(e="date_resolution", b="date_ouverture")


@query(f"""WITH x AS (SELECT id, ln({_D} + 1) AS v FROM t WHERE date_resolution IS NOT NULL AND {_D} > 0), s AS (SELECT avg(v) AS m, stddev_pop(v) AS e FROM x)
 SELECT id, round((v - m) / e + 1e-9, 6) AS z, (v - m) / e > 3.5 AS forte FROM x, s WHERE e >= 1e-10 AND (v - m) / e > 2.5""")  # fmt: skip
def zscore_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Unusually long resolutions on a log scale."""
    t = snapshot(spark, d, "date_ouverture", "date_resolution").withColumn("d", days(F.col("date_resolution"), F.col("date_ouverture"))).where(F.col("d") > 0)
    t = t.select("id", F.ln(F.col("d") + 1).alias("v"))
    m, e = t.agg(F.avg("v"), F.stddev_pop("v")).first()
    if not e or e < 1e-10:
        return t.limit(0).select("id", F.lit(0.0).alias("z"), F.lit(False).alias("forte"))
    z = (F.col("v") - F.lit(m)) / F.lit(e)
    return t.where(z > 2.5).select("id", F.round(z + 1e-9, 6).alias("z"), (z > 3.5).alias("forte"))


_HOLT = """WITH s AS (SELECT row_number() OVER (ORDER BY j) AS i, j, y FROM (SELECT CAST(date_ouverture AS DATE) AS j, count(*)::DOUBLE AS y FROM t GROUP BY 1)),
 g AS (SELECT x.a / 10.0::DOUBLE AS alpha, z.a / 10.0::DOUBLE AS beta FROM range(1, 10) x(a), range(1, 10) z(a)),
 h AS (SELECT alpha, beta, 1::BIGINT AS i, (SELECT y FROM s WHERE i = 1) AS l, (SELECT y FROM s WHERE i = 2) - (SELECT y FROM s WHERE i = 1) AS b, 0::DOUBLE AS e, 0::DOUBLE AS q, 0::DOUBLE AS r FROM g
 UNION ALL SELECT alpha, beta, s.i, alpha * y + (1 - alpha) * (l + b), beta * ((alpha * y + (1 - alpha) * (l + b)) - l) + (1 - beta) * b, e + abs(y - (l + b)), q + (y - (l + b)) * (y - (l + b)), r + (y - (l + b)) FROM h JOIN s ON s.i = h.i + 1),
 m AS (SELECT *, i - 1 AS n FROM h WHERE i = (SELECT max(i) FROM s) ORDER BY e, alpha, beta LIMIT 1),
 f AS (SELECT CAST(k AS INTEGER) AS etape, (SELECT max(j) FROM s) + CAST(k AS INTEGER) AS jour, greatest(0, l + k * b) AS v, 1.28 * sqrt((q - r * r / n) / (n - 1)) * sqrt(k::DOUBLE) AS w FROM m, range(1, 31) x(k))
 SELECT etape, jour, round(v + 1e-9, 4) AS prevu, round(greatest(0, v - w) + 1e-9, 4) AS bas, round(v + w + 1e-9, 4) AS haut FROM f"""


@query(_HOLT)
def forecast_holt(spark: SparkSession, d: str) -> DataFrame:
    """Daily openings forecast for 30 days by double exponential smoothing with the best of 81 parameter pairs."""
    t = snapshot(spark, d, "date_ouverture").groupBy(F.to_date("date_ouverture").alias("jour")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return prevision.forecast(t, 30)


_PROFILE = """WITH k AS (SELECT technicien, unnest(map_entries(cat_distribution), recursive := true) FROM profils),
 stock AS (SELECT technicien_principal AS technicien, count(*) AS n FROM t WHERE est_vivant AND technicien_principal <> '' GROUP BY 1),
 c AS (SELECT t.id, k.technicien, k.value AS part, list_contains(p.groupes, t.groupe_principal) AS du_groupe FROM t JOIN k ON k.key = t.categorie_niveau1 JOIN profils p ON p.technicien = k.technicien
 WHERE t.est_vivant AND coalesce(t.technicien_principal, '') = ''),
 f AS (SELECT *, bool_or(du_groupe) OVER (PARTITION BY id) AS local FROM c),
 s AS (SELECT id, f.technicien, round(part / (1 + coalesce(n, 0) / 20.0::DOUBLE) + 1e-9, 6) AS score FROM f LEFT JOIN stock USING (technicien) WHERE coalesce(du_groupe, false) OR NOT coalesce(local, false))
 SELECT id, technicien, score, rang FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, technicien) AS rang FROM s WHERE score >= 0.01) WHERE rang <= 3"""


@query(_PROFILE)
def assignment_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Three assignees per unassigned live ticket, by category share and load, of its group's where there are any."""
    t = snapshot(spark, d, "est_vivant", "technicien_principal", "groupe_principal", "categorie_niveau1")
    return affectation.by_category(t, load(spark, d, "profils"))


_PROFILED = ("est_vivant", "technicien_principal", "groupe_principal", "categorie_niveau1", "categorie_niveau2", "date_resolution", "date_cloture_approx", "derniere_modification")


def _as_of(spark: SparkSession, d: str) -> str:
    """The day of the active import: nothing depends on the clock."""
    imports = load(spark, d, "imports")
    return str(imports.where(F.col("id") == active_import(imports)).select(F.to_date("import_date")).first()[0])


@query("""WITH a AS (SELECT CAST(import_date AS DATE) AS jour FROM imports WHERE id = (SELECT max(id) FROM imports WHERE is_active)),
 s AS (SELECT technicien_principal AS technicien, coalesce(categorie_niveau2, categorie_niveau1, 'SANS_CATEGORIE') AS categorie, coalesce(exp(-0.693 / 30 * greatest(date_diff('day', CAST(coalesce(date_resolution, date_cloture_approx, derniere_modification) AS DATE), jour), 0)), 0.5) AS w
 FROM t, a WHERE NOT est_vivant AND technicien_principal <> '' AND coalesce(date_resolution, date_cloture_approx, derniere_modification) >= jour - INTERVAL 3 MONTH)
 SELECT technicien, categorie, round(sum(w) / sum(sum(w)) OVER (PARTITION BY technicien) + 1e-9, 6) AS part FROM s GROUP BY 1, 2""")  # fmt: skip
def profile_categories(spark: SparkSession, d: str) -> DataFrame:
    """Each assignee's shares of categories among tickets solved in the last three months, recent ones counting more."""
    solved = affectation.recent(snapshot(spark, d, *_PROFILED), _as_of(spark, d))
    return affectation.category_shares(solved).select("technicien", "categorie", F.round(F.col("part") + 1e-9, 6).alias("part"))


@query()
def assignment_by_profile(spark: SparkSession, d: str) -> DataFrame:
    """The same with 0.3 of the score from the closeness of the ticket's stems and neighbours to the assignee's tickets solved in the last three months; tickets without a suggestion have nulls."""
    t = snapshot(spark, d, *_PROFILED, "titre", "suivis_description", "solution")
    return affectation.by_profile(cut(t, "tickets"), load(spark, d, "profils"), as_of=_as_of(spark, d))


@query("""WITH d AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings), c AS (SELECT label, i, avg(v::DOUBLE) AS m FROM d GROUP BY 1, 2),
 x AS (SELECT d.vec_id, c.label, sum((v::DOUBLE - m) * (v::DOUBLE - m)) AS q FROM d JOIN c USING (i) GROUP BY 1, 2)
 SELECT vec_id, proche FROM (SELECT vec_id, label AS proche, row_number() OVER (PARTITION BY vec_id ORDER BY round(q, 9), label) AS r FROM x) WHERE r = 1""", newest=False)  # fmt: skip
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest label centroid."""
    return vecteurs.nearest_centroid(load(spark, d, "embeddings"))


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means of the embeddings (not of tickets) with k by the knee of the inertia: sizes, and the silhouette of all clusters together."""
    return vecteurs.kmeans(load(spark, d, "embeddings"))


@query("""SELECT technicien_principal, count(*) AS n, CAST(sum(n1) AS BIGINT) AS seuls FROM (SELECT technicien_principal, CASE WHEN len(techniciens) = 1 THEN 1 ELSE 0 END AS n1 FROM t WHERE technicien_principal <> '' AND id IN (SELECT id FROM t WHERE categorie_niveau1 = 'Réseau'))
 GROUP BY 1 ORDER BY n DESC, technicien_principal LIMIT 10""")  # fmt: skip
def subset_top_technicians(spark: SparkSession, d: str) -> DataFrame:
    """Top ten assignees of a subset of ids (semi-join)."""
    t = snapshot(spark, d, "technicien_principal", "techniciens", "categorie_niveau1")
    ids = t.where(F.col("categorie_niveau1") == "Réseau").select("id")
    by = t.join(ids, "id", "left_semi").where(filled(F.col("technicien_principal"))).groupBy("technicien_principal").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("techniciens") == 1).alias("seuls"))
    return by.orderBy(F.desc("n"), "technicien_principal").limit(10)


@query("SELECT window_start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)", newest=False)
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hourly windows over the event table (the batch face of ``streaming.flux_evenements``)."""
    e = load(spark, d, "events").withColumn("window_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("window_start", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))




@query(_PROFILE.replace("SELECT id, technicien, score, rang FROM (SELECT", "SELECT count(*) AS tickets, count(*) FILTER (score > 0.3) AS couverts, round(avg(coalesce(score, 0)) + 1e-9, 6) AS score_moyen FROM (SELECT id FROM t WHERE est_vivant AND coalesce(technicien_principal, '') = '') w LEFT JOIN (SELECT")
       .replace("WHERE rang <= 3", "q ON q.id = w.id AND rang = 1"))
def recommendation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many unassigned tickets have a good first suggestion, and the mean first score (0 where there is none)."""
    t = snapshot(spark, d, "est_vivant", "technicien_principal", "groupe_principal", "categorie_niveau1")
    first = affectation.by_category(t, load(spark, d, "profils")).where("rang = 1").select("id", "score")
    free = t.where(F.col("est_vivant") & ~F.coalesce(filled(F.col("technicien_principal")), F.lit(False))).select("id")
    score = F.coalesce("score", F.lit(0.0))
    return free.join(first, "id", "left").agg(F.count(F.lit(1)).alias("tickets"), F.count_if(score > 0.3).alias("couverts"), F.round(F.avg(score) + 1e-9, 6).alias("score_moyen"))


_SUBSET = "(SELECT * FROM t WHERE id IN (SELECT id FROM t WHERE categorie_niveau1 = 'Logiciel'))"


@query(f"""SELECT count(*) AS tickets, count(*) FILTER (est_vivant) AS vivants, round(avg(anciennete_jours) FILTER (NOT est_vivant) + 1e-9, 6) AS age_moyen_clos, quantile_cont(anciennete_jours, 0.5) FILTER (NOT est_vivant) AS age_median_clos,
 count(*) FILTER (type_ticket = 'Incident') AS incidents, count(*) FILTER (type_ticket = 'Demande') AS demandes,
 round(count(*) FILTER (type_ticket = 'Incident')::DOUBLE / greatest(count(*) FILTER (type_ticket = 'Demande'), 1) + 1e-9, 6) AS ratio, count(*) FILTER (est_vivant AND anciennete_jours > 90) AS vivants_90, count(*) FILTER (est_vivant AND inactivite_jours > 14) AS inactifs_14 FROM {_SUBSET}""")  # fmt: skip
def cluster_detail(spark: SparkSession, d: str) -> DataFrame:
    """Profile of a set of tickets given by ids (semi-join); the ages are those of closed tickets."""
    t = _subset(spark, d, "est_vivant", "anciennete_jours", "inactivite_jours", "type_ticket")
    live, closed = F.col("est_vivant"), F.when(~F.col("est_vivant"), F.col("anciennete_jours"))
    t = cut(t.select("id", "est_vivant", "anciennete_jours", "inactivite_jours", "type_ticket", closed.alias("age")), "ensemble")
    incidents, requests = F.count_if(F.col("type_ticket") == "Incident"), F.count_if(F.col("type_ticket") == "Demande")
    one = t.agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if(live).alias("vivants"), F.round(F.avg("age") + 1e-9, 6).alias("age_moyen_clos"),
        incidents.alias("incidents"), requests.alias("demandes"), F.round(incidents / F.greatest(requests, F.lit(1)) + 1e-9, 6).alias("ratio"),
        F.count_if(live & (F.col("anciennete_jours") > 90)).alias("vivants_90"), F.count_if(live & (F.col("inactivite_jours") > 14)).alias("inactifs_14"),
    )
    return with_percentiles(one, t, [], "age", {"age_median_clos": 0.5})


def _subset(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = snapshot(spark, d, "categorie_niveau1", *columns)
    return t.join(t.where(F.col("categorie_niveau1") == "Logiciel").select("id"), "id", "left_semi")


@query(f"SELECT groupe_principal, count(*) AS n FROM {_SUBSET} WHERE groupe_principal IS NOT NULL GROUP BY 1 ORDER BY n DESC, groupe_principal")
def cluster_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the same set, the largest first."""
    return _subset(spark, d, "groupe_principal").where(F.col("groupe_principal").isNotNull()).groupBy("groupe_principal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "groupe_principal")


@query(f"SELECT id, titre, statut, technicien_principal, anciennete_jours, coalesce(nombre_suivis, 0) AS suivis, est_vivant FROM {_SUBSET} ORDER BY anciennete_jours DESC NULLS LAST, id")
def cluster_list(spark: SparkSession, d: str) -> DataFrame:
    """The tickets of the same set, the oldest first."""
    t = _subset(spark, d, "titre", "statut", "technicien_principal", "anciennete_jours", "nombre_suivis", "est_vivant")
    return t.orderBy(F.desc_nulls_last("anciennete_jours"), "id").select("id", "titre", "statut", "technicien_principal", "anciennete_jours", F.coalesce("nombre_suivis", F.lit(0)).alias("suivis"), "est_vivant")


@query(f"SELECT strftime(date_ouverture, '%Y-%m') AS periode, count(*) AS n FROM {_SUBSET} GROUP BY 1")
def cluster_months(spark: SparkSession, d: str) -> DataFrame:
    """Monthly openings of the same set."""
    return _subset(spark, d, "date_ouverture").groupBy(F.date_format("date_ouverture", "yyyy-MM").alias("periode")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, regexp_replace(titre, '(?i)(serveur|réseau)', '<mark>\\1</mark>', 'g') AS extrait FROM t WHERE regexp_matches(titre, '(?i)(serveur|réseau)')")
def search_highlight(spark: SparkSession, d: str) -> DataFrame:
    """Titles with the words looked for marked."""
    words = r"(?iu)(serveur|réseau)"
    return snapshot(spark, d, "titre").where(F.col("titre").rlike(words)).select("id", F.regexp_replace("titre", words, "<mark>$1</mark>").alias("extrait"))
