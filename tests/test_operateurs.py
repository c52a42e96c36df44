"""Operators on small fixtures."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from guichet.functions import mots
from guichet.operators import corpus, doublons, instantane, ordre, periodes, prevision, vecteurs
from guichet.operators.hierarchie import rolled_up


def test_newest_and_merge(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 1, None)]
    df = spark.createDataFrame(rows, "id long, import_id long, statut string").withColumns({c: F.lit(None).cast(t) for c, t in (("derniere_modification", "timestamp_ntz"), ("date_resolution", "timestamp_ntz"), ("nombre_suivis", "int"))})
    assert sorted((r.id, r.statut) for r in instantane.newest(df, ["statut", "import_id"]).collect()) == [(1, "b"), (2, None)]
    new = df.where("id = 2").withColumn("statut", F.lit("neuf"))
    assert sorted((r.id, r.statut) for r in instantane.merge(df, new).collect()) == [(1, "b"), (2, "neuf")]
    assert instantane.newest(df.limit(0), ["statut"]).count() == 0


def test_imports(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "b", True)], "id long, filename string, is_active boolean")
    assert instantane.active_import(df) == 2 and instantane.active_import(instantane.activate(df, 1)) == 1
    with pytest.raises(ValueError):
        instantane.active_import(df.where("id = 1"))


def test_period_keys(spark):
    df = spark.createDataFrame([(date(2026, 1, 5),), (date(2024, 12, 30),)], "d date")
    key = lambda g, **k: [r[0] for r in df.select(periodes.period_key(F.col("d"), g, **k)).collect()]
    assert key("semaine") == ["2026-W02", "2025-W01"] and key("semaine", week="lundi") == ["2026-W01", "2024-W53"]
    assert key("trimestre") == ["2026-Q1", "2024-Q4"] and key("jour")[0] == "2026-01-05" and key("annee")[1] == "2024" and key("?") == ["2026-01", "2024-12"]
    assert [periodes.auto_granularity(n) for n in (14, 15, 30, 364, 365, 730)] == ["jour", "semaine", "mois", "mois", "trimestre", "annee"]
    assert periodes.calendar(spark, "2026-01-10", "2026-03-01", "mois").count() == 3


def test_clamped_stock(spark):
    import random

    rnd = random.Random(5)
    steps = [rnd.randrange(-9, 9) for _ in range(200)]
    s, want = 7, []
    for x in steps:
        s = max(0, s + x)
        want.append(s)
    df = spark.createDataFrame(list(enumerate(steps)), "i int, d int")
    assert [r.s for r in periodes.with_clamped_stock(df, "i", "d", "s", 7).orderBy("i").collect()] == want


def test_rollup(spark):
    df = spark.createDataFrame([("A > B > C > D", "Incident"), ("A > B", "x"), ("", "x"), (None, "x")], "p string, type_ticket string")
    assert sorted((r.chemin, r.n, r.part) for r in rolled_up(df, "p").collect()) == [("A", 2, 100.0), ("A > B", 2, 100.0), ("A > B > C", 1, 50.0)]


def test_words(spark):
    df = spark.createDataFrame([("<p>L'imprimante &amp; le réseau: Réseau2</p>",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(mots.tokens(F.col("t"))).collect()] == [["imprimante", "réseau", "réseau2"], [], []]
    one = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in one.select(mots.bigrams(F.col("w"))).collect()] == [["a_b", "b_c"], [], []]


@pytest.mark.parametrize(("word", "want"), [("continuellement", "continuel"), ("majestueusement", "majestu"), ("imprimantes", "imprim"), ("réseaux", "réseau"), ("chevaux", "cheval"), ("nationale", "national"), ("contenu", "contenu"), ("quand", "quand"), ("jouer", "jou")])
def test_stems(word, want):
    assert mots.stem(word) == want


def test_jaro_winkler():
    assert abs(mots.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5 and abs(mots.jaro_winkler("dixon", "dicksonx") - 0.813333) < 1e-5
    assert mots.jaro_winkler("", "") == 1.0 and mots.jaro_winkler("a", "") == 0.0


def test_jaro_winkler_of_many_pairs():
    import random

    rnd = random.Random(2)
    words = ["", "a", "martha", "marhta", "dixon", "dicksonx"] + ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    got = mots.jaro_winkler_many([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(g - mots.jaro_winkler(a, b)) < 1e-12 for g, (a, b) in zip(got, pairs))
    some = mots.jaro_winkler_many([a for a, _ in pairs], [b for _, b in pairs], 0.8)
    assert all(abs(s - g) < 1e-12 or (s == 0 and g <= 0.8) for s, g in zip(some, got))


def test_tfidf_unit_length_and_cooccurrence(spark):
    tf = corpus.counts(spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["c", "d", "e"])], "id long, w array<string>"), "id", F.col("w"))
    w = corpus.tfidf(tf, 3)
    assert all(abs(r[1] - 1) < 1e-9 for r in w.groupBy("doc").agg(F.sum(F.col("poids") * F.col("poids"))).collect())
    terms = corpus.keywords(w, 10)
    assert [(r.terme_a, r.terme_b, r.n) for r in corpus.cooccurrences(tf, terms).collect()] == [("a", "b", 2)]


def test_ranks_over_partitions(spark):
    df = spark.range(1000).select(F.col("id"), F.lit("g").alias("groupe"), (F.col("id") % 7).cast("string").alias("titre"))
    got = doublons.ranked(df, "groupe", ["titre", "id"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 1001)) and [(r.titre, r.id) for r in got] == sorted((r.titre, r.id) for r in got)


def test_forecast(spark):
    rows = [(date(2024, 1, 1) + timedelta(i), 10 + 0.1 * i) for i in range(100)]
    df = spark.createDataFrame(rows, "jour date, y double")
    got = prevision.forecast(df, 3).orderBy("etape").collect()
    assert [round(r.prevu, 2) for r in got] == [20.0, 20.1, 20.2] and got[0].jour == date(2024, 4, 10)
    with pytest.raises(ValueError):
        prevision.forecast(df.limit(10))


def test_knee():
    assert vecteurs.knee([100, 20, 10, 8, 7]) == 1 and vecteurs.knee([1, 2, 3]) is None and vecteurs.knee([1, 0]) is None


def test_profiles_read_the_long_texts(spark):
    """A word of the follow-ups finds the assignee whose solutions hold its other form; a ticket without a match stays."""
    from guichet.operators.affectation import by_profile, words

    rows = [(i, False, tech, "", None, "divers", None, text, None) for i, (tech, text) in enumerate([("a", "imprimante bloquée")] * 2 + [("b", "routeur coupé")] * 2)]
    rows += [(10, True, None, "", None, "divers", "imprimantes bloquées", None, None), (11, True, None, "", None, "zzz", None, None, None)]
    t = spark.createDataFrame(rows, "id long, est_vivant boolean, technicien_principal string, groupe_principal string, categorie_niveau1 string, titre string, suivis_description string, solution string, date_resolution timestamp_ntz")
    profiles = spark.createDataFrame([("a", {}, []), ("b", {}, [])], "technicien string, cat_distribution map<string,double>, groupes array<string>")
    got = {(r.id, r.rang): r.technicien for r in by_profile(t, profiles).collect()}
    assert got[(10, 1)] == "a" and got[(11, None)] is None
    assert any("_" in r.terme for r in words(t.where("id = 10"), "titre", "suivis_description").collect())


def test_kmeans_may_settle_slowly(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    from guichet.operators.vecteurs import kmeans

    seen, plain = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, data: seen.append(self.getMaxIter()) or plain(self, data))
    df = spark.createDataFrame([([float(i % 3), float(i)],) for i in range(12)], "embedding array<double>")
    assert sum(r.taille for r in kmeans(df, high=3).collect()) == 12 and set(seen) == {100}


def test_running_sums(spark):
    """Against a plain fold: a hot group over several partitions, the null group, no group, nothing."""
    import random

    rnd = random.Random(3)
    rows = [("gros" if i % 3 else None, rnd.randrange(50), i, rnd.randrange(9)) for i in range(600)] + [("seul", 1, 1000, 5)]
    df = spark.createDataFrame(rows, "g string, o int, id long, v long")
    want, sums = {}, {}
    for g, _, i, v in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])):
        want[i] = sums[g] = sums.get(g, 0) + v
    got = ordre.running(df, ["g"], ["o", "id"], "v", total="t", partitions=5).collect()
    assert {r.id: r.cumul for r in got} == want and all(r.t == sums[r.g] for r in got)
    every = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [r.id for r in ordre.running(df, [], ["o", "id"], out="pos", partitions=5).orderBy("pos").collect()] == [r[2] for r in every]
    assert ordre.running(df.limit(0), ["g"], ["o", "id"], "v").count() == 0


def test_percentiles_of_groups(spark):
    import numpy as np

    rows = [("a" if i % 4 else None, float((i * 37) % 101) / 7) for i in range(400)] + [("un", 2.5), ("vide", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    base = df.groupBy("g").agg(F.count("*").alias("k"))
    got = {r.g: r for r in ordre.with_percentiles(base, df, ["g"], "x", {"m": 0.5, "p": 0.9}).collect()}
    for g in ("a", None, "un"):
        values = [x for h, x in rows if h == g]
        assert abs(got[g].m - np.quantile(values, 0.5)) < 1e-9 and abs(got[g].p - np.quantile(values, 0.9)) < 1e-9
    assert got["vide"].m is None and got["vide"].k == 1
    one = ordre.with_percentiles(df.agg(F.count("x").alias("k")), df, [], "x", {"m": 0.5}).first()
    assert abs(one.m - np.quantile([x for _, x in rows if x is not None], 0.5)) < 1e-9
    assert ordre.with_percentiles(df.limit(0).agg(F.count("x").alias("k")), df.limit(0), [], "x", {"m": 0.5}).first().m is None


def test_all_similar_titles(spark):
    """The exact mode against every pair, copies, empty and null titles included; the window may miss some."""
    import random
    from itertools import combinations

    rnd = random.Random(4)
    base = ["écran noir au démarrage", "imprimante bloquée", "réseau coupé étage 3", "", "mot de passe oublié", "accès refusé au partage"]
    rows = [(i, None if i == 7 else "".join(c for c in rnd.choice(base) if rnd.random() > 0.05), rnd.choice(["g", "h", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, titre string, groupe string")
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if (a[2] or "Inconnu") == (b[2] or "Inconnu") and mots.jaro_winkler(a[1] or "", b[1] or "") > 0.92}
    got = [(r.id_a, r.id_b) for r in doublons.similar_titles(df, 0.92, exact=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.id_a, r.id_b) for r in doublons._all_similar(df, 0.92, block=7).select("id_a", "id_b").collect()} == want
    windowed = {(r.id_a, r.id_b) for r in doublons.similar_titles(df.na.fill({"titre": "", "groupe": "Inconnu"}), 0.92, small=10, reach=5).collect()}
    assert windowed <= want


def test_day_bounds():
    assert {str(instantane.day_bound(x)) for x in ("2025-01-31", "2025-01-31T23:00:00", "31/01/2025", "31-01-2025 10:00")} == {"2025-01-31"}
    with pytest.raises(ValueError):
        instantane.day_bound("demain")


def test_released_tables(spark):
    from guichet.session import cut, release

    release(spark)
    t = cut(spark.range(3))
    assert t.count() == 3 and release(spark) == 1 and release(spark) == 0


def test_search_grammar(spark):
    from guichet.operators import recherche

    rows = [(1, "Serveur de mémoire", "mot de passe perdu"), (2, "memoires vives", None), (3, None, "le mot passe"), (4, "IMPRIMANTE", ""), (5, "", None)]
    t = spark.createDataFrame(rows, "id long, a string, b string")
    folder = recherche.build_index(t, "id", ["a", "b"])
    ids = lambda q: {r.doc for r in recherche.search(spark, folder, q).collect()}
    assert ids("Memoire") == {1} and ids("mémo*") == {1, 2} and ids('"mot de passe"') == {1} and ids("mot passe") == {1, 3}
    assert ids("mot NOT perdu") == {3} and ids("imprimante OR memoires") == {2, 4} and ids("imprimante AND perdu") == set() and ids("absent") == set()
    for wrong in ("", "NOT a", "a OR", "a NOT", "?"):
        with pytest.raises(ValueError):
            recherche.parse(wrong)
    shown = t.where("id = 1").select(recherche.highlighted(F.col("a"), "memoire"), recherche.snippet(F.concat(F.repeat(F.lit("x "), 100), F.col("b"), F.repeat(F.lit(" y"), 100)), "passe")).first()
    assert shown[0] == "Serveur de <mark>mémoire</mark>" and shown[1].startswith("...x") and "<mark>passe</mark>" in shown[1] and shown[1].endswith("...")
    empty = recherche.build_index(t.limit(0), "id", ["a", "b"])
    assert recherche.search(spark, empty, "mot").count() == 0
    assert recherche.fold("Éçœ") == "ecœ"


def test_text_clusters(spark):
    """Three vocabularies give three clusters; silhouettes equal those over all pairs; labels hold surface forms."""
    import numpy as np

    from guichet.operators import textes

    rows = [(10 * g + i, g, w) for g, vocabulary in enumerate(("imprimante toner papier bourrage", "routeur fibre débit coupure", "badge porte lecteur accès")) for i in range(8) for w in vocabulary.split()[i % 2 : 3 + i % 2]]
    counted = spark.createDataFrame([(i, w, 1) for i, _, w in rows], "doc long, terme string, n long")
    by, forms = textes.stemmed(counted)
    found, terms = textes.text_clusters(by, 24, high=5)
    got = {r.doc: (r.cluster, r.silhouette) for r in found.collect()}
    assert len({frozenset(d for d in got if got[d][0] == c) for c in {c for c, _ in got.values()}} & {frozenset(range(10 * g, 10 * g + 8)) for g in range(3)}) == 3
    weights = corpus.tfidf(by, 24).collect()
    names = sorted({r.terme for r in weights})
    x = {d: np.zeros(len(names)) for d in got}
    for r in weights:
        x[r.doc][names.index(r.terme)] = r.poids
    for d, (c, s) in got.items():
        mean = {k: np.mean([((x[d] - x[e]) ** 2).sum() for e in got if got[e][0] == k and e != d]) for k in {v[0] for v in got.values()}}
        a, b = mean[c], min(v for k, v in mean.items() if k != c)
        assert abs(s - (b - a) / max(a, b)) < 1e-9
    told = textes.described_clusters(found, terms, forms).collect()
    assert sum(r.taille for r in told) == 24 and all(r.coherence == "forte" and len(r.mots.split()) >= 4 for r in told) and any("imprimante" in r.mots for r in told)
    none, _ = textes.text_clusters(by.limit(0), 0)
    assert none.count() == 0
