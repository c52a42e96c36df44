"""Search over the four text fields of tickets, mining of whole follow-ups and solutions, clusters of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.operators import corpus, recherche, textes
from guichet.operators.instantane import filled, filtered, snapshot
from guichet.plans.registre import Registre
from guichet.session import cut

query = Registre()
FIELDS = ["titre", "suivis_description", "solution", "taches_description"]
MOST = 50  # results of a search

# Tokens of the four fields in DuckDB; places count within a field.
_INDEX_SQL = (
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT id, {k} AS champ, regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+') AS l FROM t" for k, c in enumerate(FIELDS))
    + "), w AS (SELECT id, champ, unnest(l) AS terme, generate_subscripts(l, 1) AS place FROM f), n AS (SELECT id, CAST(sum(len(l)) AS BIGINT) AS longueur FROM f GROUP BY 1)"
)


def _leaf_sql(words: str) -> str:
    if words.endswith("*"):
        return f"SELECT id, count(*) AS n FROM w WHERE terme LIKE '{words[:-1]}%' GROUP BY 1"
    first, *rest = words.split()
    joins = " ".join(f"JOIN w w{k} ON w{k}.id = w0.id AND w{k}.champ = w0.champ AND w{k}.place = w0.place + {k} AND w{k}.terme = '{x}'" for k, x in enumerate(rest, 1))
    return f"SELECT w0.id, count(*) AS n FROM w w0 {joins} WHERE w0.terme = '{first}' GROUP BY 1"


def _search_sql(leaves: list[str], rule: str) -> str:
    """The ranked ids of a query given by its words and a rule over n0, n1 ..."""
    parts = ", ".join(f"l{k} AS ({_leaf_sql(x)})" for k, x in enumerate(leaves))
    score = " + ".join(f"greatest(ln(((SELECT count(*) FROM n) - (SELECT count(*) FROM l{k}) + 0.5) / ((SELECT count(*) FROM l{k}) + 0.5)), 1e-6) * n{k} * 2.2 / (n{k} + 1.2 * (0.25 + 0.75 * longueur / (SELECT avg(longueur) FROM n)))" for k in range(len(leaves)))
    counts = ", ".join(f"coalesce(l{k}.n, 0) AS n{k}" for k in range(len(leaves)))
    joins = " ".join(f"LEFT JOIN l{k} ON l{k}.id = n.id" for k in range(len(leaves)))
    return f"{_INDEX_SQL}, {parts}, h AS (SELECT n.id, longueur, {counts} FROM n {joins}), s AS (SELECT id, round({score} + 1e-9, 6) AS score FROM h WHERE {rule}), r AS (SELECT * FROM s ORDER BY score DESC, id LIMIT {MOST})"


def ticket_search(spark: SparkSession, d: str, text: str, limit: int = MOST, folder: str | None = None) -> DataFrame:
    """The best tickets for a query of the grammar, with the title marked and a snippet of the solution.

    ``folder``: an index made before by ``recherche.build_index``; without one it is made of all tickets.
    """
    t = snapshot(spark, d, *FIELDS, "statut", "technicien_principal")
    if folder is None:
        t = cut(t, "tickets")
        folder = recherche.build_index(t, "id", FIELDS)
    best = recherche.search(spark, folder, text).orderBy(F.desc("score"), "doc").limit(limit)
    shown = t.join(F.broadcast(best.withColumnRenamed("doc", "id")), "id")  # at most ``limit`` rows
    return shown.select("id", "titre", "statut", "technicien_principal", recherche.highlighted(F.col("titre"), text).alias("titre_marque"), recherche.snippet(F.col("solution"), text).alias("extrait"), "score")


@query(_search_sql(["serveur", "memoire"], "n0 > 0 AND n1 > 0") + " SELECT id, score FROM r")
def search_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets with both words in any field, whatever their accents."""
    return ticket_search(spark, d, "serveur Mémoire").select("id", "score")


@query(_search_sql(["imprim*", "reseau", "mot de passe", "vpn"], "(n0 > 0 AND n1 = 0) OR (n2 > 0 AND n3 = 0)") + " SELECT id, score FROM r")
def search_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Word beginnings, phrases, OR and NOT."""
    return ticket_search(spark, d, 'imprim* NOT réseau OR "mot de passe" NOT vpn').select("id", "score")


_MARK = "list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: CASE WHEN strip_accents(lower(x)) LIKE 'imprim%' THEN '<mark>' || x || '</mark>' ELSE x END)"


@query(
    _search_sql(["imprim*"], "n0 > 0")
    + f""", m AS (SELECT t.id, titre, statut, technicien_principal, score, {_MARK.format(c="coalesce(titre, '')")} AS a, {_MARK.format(c="coalesce(solution, '')")} AS b FROM r JOIN t USING (id)),
 p AS (SELECT *, greatest(coalesce(list_position(list_transform(b, lambda x: x LIKE '<mark>%'), true), 0) - {recherche.BEFORE}, 1) AS de FROM m)
 SELECT id, titre, statut, technicien_principal, array_to_string(a, '') AS titre_marque, (CASE WHEN de > 1 THEN '...' ELSE '' END) || array_to_string(b[de:de + {recherche.SNIPPET - 1}], '') || (CASE WHEN de + {recherche.SNIPPET} <= len(b) THEN '...' ELSE '' END) AS extrait, score FROM p"""
)
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """What a search shows: ticket, marked title, snippet of the solution, score."""
    return ticket_search(spark, d, "imprim*")


def _corpus_sql(name: str) -> str:
    """Term weights of a corpus of live tickets without words of forms, stop words and parts of assignees' names."""
    from guichet.functions.mots import PHRASES
    from guichet.plans.fouille import _HTML_SQL, _STOP, _TFIDF_SQL

    text = f"lower(regexp_replace(coalesce({textes.column_of(name)}, ''), '{_HTML_SQL}', ' ', 'gi'))"
    for p in PHRASES:
        text = f"replace({text}, '{p.replace(chr(39), chr(39) * 2)}', ' ')"
    return (
        f"WITH v AS (SELECT * FROM t WHERE est_vivant), x AS (SELECT id AS doc, {text} AS c FROM v), w AS (SELECT doc, unnest(regexp_extract_all(c, '[\\p{{L}}][\\p{{L}}\\p{{N}}]*')) AS terme FROM x),"
        + f" noms AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(technicien_principal), '[^\\p{{L}}\\p{{N}}]+')) AS terme FROM tickets WHERE technicien_principal <> ''),"
        + f" tf AS (SELECT doc, terme, count(*) AS n FROM w WHERE strlen(terme) BETWEEN 2 AND 30 AND terme NOT IN ({_STOP}) AND terme NOT IN (SELECT terme FROM noms WHERE strlen(terme) >= 2) GROUP BY 1, 2), "
        + _TFIDF_SQL.format(docs="v")
    )


def _live_words(spark: SparkSession, d: str, name: str, resolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """(live tickets, or all with ``resolved``; word counts of the corpus)."""
    from guichet.session import load

    t = filtered(snapshot(spark, d, textes.column_of(name), "est_vivant", "groupe_principal"), vivants=None if resolved else True)
    t = cut(t, "corpus")
    names = load(spark, d, "tickets").where(filled(F.col("technicien_principal"))).select(F.col("technicien_principal").alias("nom")).distinct()
    return t, cut(textes.words(t, name, names), "mots")


def _add_corpora() -> None:
    for name in ("suivis", "solutions"):

        def keywords(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            t, tf = _live_words(spark, d, name)
            return corpus.keywords(corpus.tfidf(tf, t.count()), 50)

        def numbers(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            t, tf = _live_words(spark, d, name)
            n = t.count()
            return textes.stats(tf, corpus.tfidf(tf, n), n)

        query(_corpus_sql(name) + " SELECT terme, score, df FROM k ORDER BY score DESC, terme LIMIT 50", f"keywords_{name}")(keywords)
        query(
            _corpus_sql(name) + """, z AS (SELECT (SELECT count(*) FROM v) AS documents, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM tf) AS mots, (SELECT count(*) FROM df) AS vocabulaire, (SELECT count(*) FROM p) AS non_nuls)
 SELECT *, round(mots::DOUBLE / greatest(documents, 1) + 1e-9, 6) AS moyenne, round(CASE WHEN documents * vocabulaire > 0 THEN 1 - non_nuls::DOUBLE / (documents * vocabulaire) ELSE 1 END + 1e-9, 6) AS parcimonie FROM z""",
            f"corpus_stats_{name}",
        )(numbers)


_add_corpora()


@query(_corpus_sql("suivis") + """, e AS (SELECT coalesce(groupe_principal, 'Inconnu') AS groupe, id AS doc FROM v), s AS (SELECT groupe, count(*) AS tickets FROM e GROUP BY 1),
 g AS (SELECT groupe, terme, round(sum(poids), 6) AS score, count(*) AS df FROM p JOIN e USING (doc) GROUP BY 1, 2)
 SELECT groupe, tickets, terme, score, df, rang FROM (SELECT *, row_number() OVER (PARTITION BY groupe ORDER BY score DESC, terme) AS rang FROM g) JOIN s USING (groupe) WHERE rang <= 20 ORDER BY tickets DESC, groupe, rang""")  # fmt: skip
def keywords_by_group_suivis(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the follow-ups of each group, the largest group first."""
    t, tf = _live_words(spark, d, "suivis")
    groups = t.select(F.col("id").alias("doc"), F.coalesce("groupe_principal", F.lit("Inconnu")).alias("groupe"))
    sizes = groups.groupBy("groupe").agg(F.count(F.lit(1)).alias("tickets"))
    return corpus.group_keywords(corpus.tfidf(tf, t.count()), groups, 20).join(sizes, "groupe").orderBy(F.desc("tickets"), "groupe", "rang").select("groupe", "tickets", "terme", "score", "df", "rang")


@query()
def text_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The 20 heaviest stems of the solutions of all tickets with their most frequent words (no SQL: DuckDB has no such stemmer)."""
    t, counted = _live_words(spark, d, "solutions", resolved=True)
    by, forms = textes.stemmed(counted)
    return corpus.keywords(corpus.tfidf(cut(by, "racines_tf"), t.count()), 20).join(forms, "terme")


@query()
def text_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the titles of live tickets: sizes, silhouettes, coherence, labels (no SQL: an iterative fit)."""
    t, counted = _live_words(spark, d, "titre")
    by, forms = textes.stemmed(counted)
    found, terms = textes.text_clusters(cut(by, "racines_tf"), t.count())
    return textes.described_clusters(found, terms, forms)
