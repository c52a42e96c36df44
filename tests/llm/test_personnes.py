"""Personal data."""

import re

import pytest

from guichet.llm.personnes import CARD_FORMAT, KEY_SETTING, NIR_CORSICA, NIR_FORMAT, NIR_MONTHS, Format, card_valid, day_of, find, given_names, mask, mask_text, nir_key, nir_valid, permute, pseudonym, secret_of, spans

GIVEN = frozenset("Hugo Kenza Malo Bastien Prune Raphaël Jade Solène Jean-Malo".split())
KEY = b"essai"
CASES = {
    "Voir Kenza PONSARIN au 01 99 00 12 71 pour un créneau.": [("nom", "Kenza PONSARIN"), ("telephone", "01 99 00 12 71")],
    "+33 (0)1.99.00.12.71, 0033 199 001 271, +33199001271, 0199001271": [("telephone", "+33 (0)1.99.00.12.71"), ("telephone", "0033 199 001 271"), ("telephone", "+33199001271"), ("telephone", "0199001271")],
    "Salle Bastien réservée, serveur Raphaël dans la baie 2.": [], "SALLE BASTIEN RÉSERVÉE": [],
    "Signé : Viltagnon Malo Archivage du pilote": [("nom", "Viltagnon Malo")], "MARTACHET Hugo (absent)": [("nom", "MARTACHET Hugo")], "D'après G. Trannignon, tout": [("nom", "G. Trannignon")],
    "Mme Lavrazac et M. Hugo Durand-Petit": [("nom", "Lavrazac"), ("nom", "Hugo Durand-Petit")], "Compte de jade ponaudec (": [("nom", "jade ponaudec")],
    "NIR 2 41 09 99 991 561 88 et lot 941102144763323": [("identite", "2 41 09 99 991 561 88")], "Carte 4512 99Z 20669, 970499Y87584": [("identite", "4512 99Z 20669"), ("identite", "970499Y87584")],
    "154 ter allée de l'Écluse Haute 99766 Saurmogny. Fin": [("adresse", "154 ter allée de l'Écluse Haute 99766 Saurmogny")], "7 impasse des Sabotiers à Fixtagny": [("adresse", "7 impasse des Sabotiers à Fixtagny")],
    "13 postes, rue intérieure du bâtiment C.": [], "112 av. du Chemin Creux\n99540 Montrirne": [("adresse", "112 av. du Chemin Creux\n99540 Montrirne")], "8 quai Octave Branquier ; badge à la loge": [("adresse", "8 quai Octave Branquier")],
    "x.y+z@valmorne.example. a_b (at) valmorne.example, Mention @equipe, //partage/export@2020/x": [("courriel", "x.y+z@valmorne.example"), ("courriel", "a_b (at) valmorne.example")],
    "04-01-2025 10:48 : série 4929-7806-11, commande 0537-60-2180-4, 10.172.139.86, poste interne 3276": [], "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_spans(text):
    assert [(k, text[a:b]) for a, b, k in spans(text, GIVEN)] == CASES[text]


def test_masking_keeps_the_rest():
    for text, want in CASES.items():
        parts = re.split(r"\[(?:NOM|TELEPHONE|IDENTITE|ADRESSE|COURRIEL):[^\]]*\]", mask_text(text, GIVEN, KEY))
        rest = text
        for part, (_, value) in zip(parts, want):
            assert rest.startswith(part + value)
            rest = rest[len(part) + len(value) :]
        assert rest == parts[-1]
    assert mask_text(None, GIVEN, KEY) is None


@pytest.mark.parametrize("filler", ["x" * 200_000, "a." * 100_000, "a-" * 100_000, "12 " * 70_000, "Abc " * 50_000, "rue de la " * 20_000, "0" * 200_000, "@" * 100_000])
def test_long_texts_take_no_long_time(filler):
    import time

    began = time.time()
    got = spans(filler + " écrire à x.y@valmorne.example ou Hugo Martel.", GIVEN)
    assert time.time() - began < 10 and {k for _, _, k in got} >= {"courriel"}


def test_permutation():
    for size in (1, 2, 10, 97, 1000):
        image = [permute(v, size, KEY, "t") for v in range(size)]
        assert sorted(image) == list(range(size)) and [permute(v, size, KEY, "t", back=True) for v in image] == list(range(size))


def test_pseudonyms_are_linked_and_valid():
    forms = ["01 99 00 12 71", "+33 (0)1.99.00.12.71", "0033 199 001 271", "0199001271"]
    new = [pseudonym("telephone", f, KEY) for f in forms]
    assert len({re.sub(r"\D", "", n.replace("(0)", ""))[-9:] for n in new}) == 1
    assert all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, b in zip(forms, new))
    nirs = ["2 41 09 99 991 561 88", "2410999991561 88"]
    a, b = (re.sub(r"\D", "", pseudonym("identite", n, KEY)) for n in nirs)
    assert a == b and nir_valid(a) and a != "241099999156188"
    assert pseudonym("nom", "Kenza  PONSARIN", KEY) == pseudonym("nom", "kenza ponsarin", KEY) != pseudonym("nom", "Kenza PONSARIN", b"autre")


def test_tables(spark):
    rows = [(1, "Voir Hugo Martel.", None), (1, "Voir Hugo Martel.", None), (2, "", "x" * 300_000 + " Hugo Martel"), (None, None, None)]
    df = spark.createDataFrame([(*r, "g", "v") for r in rows], "id long, suivis string, solution string, genre string, valeur string")
    got = {tuple(r) for r in find(df, "id", ["suivis", "solution"], GIVEN, KEY).select("id", "champ", "genre", "valeur").collect()}
    assert got == {(1, "suivis", "nom", "Hugo Martel"), (2, "solution", "nom", "Hugo Martel")}
    masked = mask(df, ["suivis"], GIVEN, KEY).collect()
    assert len(masked) == 4 and masked[0].suivis.startswith("Voir [NOM:") and masked[0].genre == "g"
    assert find(df.limit(0), "id", ["suivis"], GIVEN, KEY).count() == 0


def test_given_names(spark):
    df = spark.createDataFrame([("Hugo Martel", None), ("Hugo Vilard", "Malo Creton"), ("Supervision automatique", ""), ("Service", "Malo Creton")], "demandeur string, technicien string")
    assert given_names(df, ["demandeur", "technicien"]) == {"Hugo"} and given_names(df.limit(0), ["demandeur"]) == frozenset()


def test_small_domains_are_permuted_whole():
    """Every value of a format is the pseudonym of exactly one: no two persons are linked."""
    small = (Format("a", ("1", "2", "3", "4", "7", "8"), 1, ("01", "20", "50", "99"), ("2A", "2B"), 1), Format("b", 3), Format("c", ("x",)), Format("d", 2, ("A", "B", "C"), 1))
    for f in small:
        texts = [f.text(i) for i in range(f.size)]
        assert len(set(texts)) == f.size and [f.index(t) for t in texts] == list(range(f.size))
        assert sorted(f.permuted(t, KEY) for t in texts) == sorted(texts)


def test_social_security_numbers_are_never_merged():
    assert pseudonym("identite", "1 85 05 78 006 084 91", KEY) != pseudonym("identite", "3 85 05 78 006 084 88", KEY)
    seen = {}
    for sex in "123478":
        for month in NIR_MONTHS:
            for place in ("78006084", "2A006084", "2B006084"):
                number = f"{sex}85{month}{place}"
                bare = number + f"{nir_key(number):02d}"
                assert nir_valid(bare)
                new = pseudonym("identite", bare, KEY)
                assert nir_valid(new) and len(new) == 15 and (new[5:7] in ("2A", "2B")) == (place[:2] in ("2A", "2B"))
                assert seen.setdefault(new, bare) == bare
    assert NIR_FORMAT.size == 6 * 100 * len(NIR_MONTHS) * 100 * 10**6 and NIR_CORSICA.size * 50 == NIR_FORMAT.size


def test_cards_and_dates():
    new = pseudonym("identite", "4512 99Z 20669", KEY)
    assert re.fullmatch(r"\d{4} \d{2}[A-Z] \d{5}", new) and card_valid(re.sub(" ", "", new)) and new != "4512 99Z 20669" and CARD_FORMAT.size == 100 * 12 * 100 * 26 * 10**5
    assert spans("Carte 4513 99Z 20669", GIVEN) == []  # no such month
    forms = ["12/03/1985", "12.03.1985", "12-3-1985", "1985-03-12", "12 mars 1985"]
    assert len({day_of(pseudonym("naissance", f, KEY))[0] for f in forms}) == 1 and day_of("31/02/1985") is None
    days = [f"{d:02d}/{m:02d}/85" for m in range(1, 13) for d in range(1, 32) if day_of(f"{d:02d}/{m:02d}/85")]
    assert len({pseudonym("naissance", x, KEY) for x in days}) == 365
    text = "Né le 12/03/1985, venu le 12/03/2025 (date de naissance : 31/02/1985)."
    masked = mask_text(text, GIVEN, KEY)
    assert re.fullmatch(r"Né le \[NAISSANCE:\d\d/\d\d/\d{4}\], venu le 12/03/2025 \(date de naissance : 31/02/1985\)\.", masked)
    assert spans(text, GIVEN) == []  # find lists the five kinds only


def test_secret(spark):
    own = secret_of(spark)
    assert len(own) == 32 and secret_of(spark) == own
    spark.conf.set(KEY_SETTING, "geheim")
    try:
        assert secret_of(spark) != own and secret_of(spark) == secret_of(spark)
    finally:
        spark.conf.unset(KEY_SETTING)


def test_remainder_of_whole_tables(spark, data):
    """Row for row the masked fields are the old ones with placeholders in place of the pieces found."""
    from guichet.llm import catalogue

    old = catalogue.load(spark, data, "tickets").select("id", "import_id", *catalogue.FREE_TEXTS).collect()
    new = catalogue.p1_masque(spark, data).collect()
    assert len(old) == len(new)
    pieces = {(r.id, r.champ, r.valeur) for r in catalogue.p1_found(spark, data).collect()}
    mark = re.compile(r"\[(?:NOM|TELEPHONE|IDENTITE|ADRESSE|COURRIEL):[^\]]*\]")
    texts = {(r.id, c): r[c] for r in old for c in catalogue.FREE_TEXTS}  # all copies of an id have the same texts
    for r in new:
        for c in catalogue.FREE_TEXTS:
            if r[c] is None:
                assert texts[r.id, c] is None
                continue
            own = "|".join(re.escape(v) for i, f, v in pieces if (i, f) == (r.id, c))
            assert re.fullmatch(f"(?:{own})".join(re.escape(part) for part in mark.split(r[c])), texts[r.id, c])
