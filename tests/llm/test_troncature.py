"""Truncated texts."""

from pyspark.sql import functions as F

from guichet.llm.troncature import at_limit, inspected, limits, rates, truncated

CASES = {
    "Le serveur redémarre.": False, "Le serveur redém": True, "Le serveur redémarre. ...": False, "Le serveur redém...": True, "Le badge [...]": True, "Fini. À suivre…": False,
    "Fait.\nCordialement,\nMerci d'avance": False, "Fait.\n- changer l'étiquette\n- Hyloquen 72": False, "Fait.\nRéf. KB-81488": False, "Fait.\n(fin du message)": False, "Fait.\n[pièce jointe : 1]": False,
    "<p>Fait.</p>": False, "<p>Fait.</p": True, "<p>Fait.</p><": True, "<p>Fait.</p><p>": True, "Voir la version v5.": True, "Voir la version v5.1.2.": False, "Voir la version v10.18.1.": False, "Fini. A\u0300 suivre…": False, "Fini. Ã\u0080 suivreâ\u0080¦": False, "Fini. â\u0080¦": False, "Fini. Ã suivreâ¦": False, "Le badgeâ\u0080¦": True, "Adresse 10.12.": True, "Adresse 10.12.13.14.": False,
    "je regarde": False, "1. Fait.\n2.": True, "1. Fait.\n2. Vu.": False, "Bonne nouvelle !": False, "Dit \"oui.\"": False, "coupe le son, ": True, "": False, None: False, " \n ": False, "mot " * 100_000: True, "a < b.": False,
}


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(CASES)], "doc_id long, text string, source string, ligne string")
    got = {r.doc_id for r in truncated(df, "doc_id", "text", "source").collect()}
    assert {t: i in got for i, t in enumerate(CASES)} == CASES


def test_learned_closings(spark):
    rows = [(i, f"Phrase numero {i}.\nPôle accueil du public", "s") for i in range(20)] + [(99, "Phrase.\nPôle accu", "s"), (100, "Phrase.\nPôle accueil du public", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.doc_id for r in truncated(df, "doc_id", "text", "source").collect()] == [99]


def test_limits(spark):
    rows = [(i, "é" * (20 + i) + "x", "a") for i in range(200)]
    rows += [(1000 + i, ("mot" + str(i) + " " + "abc " * 100)[:150], "a") for i in range(40)]  # 150 characters
    rows += [(2000 + i, "é" * (39 + i % 2) + "x" * (2 - 2 * (i % 2)), "b") for i in range(40)]  # 80 bytes
    rows += [(3000 + i, "z" * (40 + 3 * i), "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.source, r.mesure, r.limite) for r in limits(inspected(df, "doc_id", "text", "source"), "doc_id").collect()}
    assert ("a", "caracteres", 150) in got and ("b", "utf8", 80) in got
    ids = {r.doc_id for r in at_limit(inspected(df, "doc_id", "text", "source"), "doc_id").collect()}
    assert set(range(1000, 1040)) | set(range(2000, 2040)) <= ids and not ids & set(range(0, 100))


def test_rates_and_empty(spark):
    df = spark.createDataFrame([(1, "Fini.", "a"), (2, "pas fin", "a"), (2, "pas fin", "a"), (3, None, "a"), (4, " ", "b")], "doc_id long, text string, source string")
    assert [(r.source, r.textes, r.coupes) for r in rates(df, "doc_id", "text", "source").collect()] == [("a", 3, 2)]
    assert truncated(df.limit(0), "doc_id", "text", "source").count() == 0 and limits(inspected(df.limit(0), "doc_id", "text", "source"), "doc_id").count() == 0


def test_verdicts_do_not_depend_on_the_number_of_texts(spark):
    """Six texts with an unlisted closing are whole, and one cut in it is cut, beside 300 and 30,000 others."""
    own = [(i, f"Le poste {i} est rendu.\nAmicalement vôtre", "s") for i in range(6)] + [(6, "Le poste 6 est rendu.\nAmicalement vô", "s")]
    for n in (300, 30_000):
        others = spark.range(n).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("Le dossier "), F.col("id"), F.lit(" est clos.")).alias("text"), F.lit("s").alias("source"))
        df = spark.createDataFrame(own, "doc_id long, text string, source string").unionByName(others)
        assert [r.doc_id for r in truncated(df, "doc_id", "text", "source").collect()] == [6]


def test_a_line_cut_anywhere_is_no_closing(spark):
    """A frequent last sentence cut at each of its letters in many texts makes none of its beginnings a closing."""
    line = "le routeur du premier palier redémarre seul chaque nuit"
    rows = [(1000 * k + n, f"Constat {k}.{n} noté.\n{line[:k]}", "s") for k in range(1, len(line)) for n in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert truncated(df, "doc_id", "text", "source").count() == len(rows)


def test_short_limits(spark):
    rows = [(i, f"{i * 7919:x}".ljust(19, "q") + "z", "court") for i in range(60)]
    seen = inspected(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    assert {(r.mesure, r.limite) for r in limits(seen, "doc_id").collect()} == {("caracteres", 20)}
