"""Files in and out, normalisation, settings, streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from guichet.functions.reglages import Reglages, read_settings, stop_words
from guichet.operators.normalisation import normalised
from guichet.sources import sorties
from guichet.sources.enregistrements import load_records
from guichet.sources.fichiers import HEADERS, MissingColumns, decode, encoding_of, read_export
from guichet.streaming.flux_evenements import upsert_stream, windowed

HEAD = ";".join(HEADERS)
ROWS = [
    '5 732 943;Écran noir – 5 €;_DSI > _SUPPORT > _N2;Nouveau;"Anna Bel\nTom Cor";Ugo Dan;05-01-2026 16:24;Incident;"ligne 1\nligne ""2""";0;;;Haute;;4;;;A > B > C',
    "2;x;;Clos;;;2026-01-05;Demande;;;;;;;;;06-01-2026 10:00",
    "INVALID;x;;Clos;;;2026-01-05;Demande;;;;;;;;;;;trop",
]


@pytest.mark.parametrize(("encoding", "mark"), [("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("cp1252", b"")])
def test_delimited(spark, tmp_path, encoding, mark):
    p = tmp_path / "export.csv"
    p.write_bytes(mark + "\n".join([HEAD.replace("Titre", " Titre "), *ROWS]).encode(encoding))
    assert encoding_of(spark, str(p)) == ("UTF-8" if encoding == "utf-8" else "windows-1252")
    got = read_export(spark, str(p)).collect()
    assert [r.id for r in got] == ["5 732 943", "2", "INVALID"] and got[0].titre == "Écran noir – 5 €" and got[0].suivis_description == 'ligne 1\nligne "2"' and got[1].categorie is None
    assert decode(p.read_bytes()).startswith("ID")


def test_missing_and_optional_columns(spark, tmp_path):
    p = tmp_path / "export.csv"
    p.write_text("\n".join([HEAD.replace("Titre;", "").replace("Statut;", "Etat;"), ROWS[1]]))
    with pytest.raises(MissingColumns) as e:
        read_export(spark, str(p))
    assert e.value.names == ["Titre", "Statut"]
    p.write_text("\n".join([HEAD.replace(";Urgence", ";X"), ROWS[1]]))
    assert read_export(spark, str(p)).first().urgence is None


def test_workbook(spark, tmp_path):
    def sheet(rows):
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        cell = lambda v, c, r: f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{c}{r}"><v>{v}</v></c>'
        body = "".join("<row>" + "".join(cell(v, chr(65 + k), n) for k, v in enumerate(row, 0) if v is not None) + "</row>" for n, row in enumerate(rows, 1))
        return f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"

    p = tmp_path / "export.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet([list(HEADERS), [42.0, "Titre", None, "Clos", None, None, 44914.39167]]))
    got = read_export(spark, str(p)).collect()
    assert len(got) == 1 and got[0].id == "42" and got[0].titre == "Titre" and got[0].groupe is None and got[0].date_ouverture == "44914.39167" and got[0].categorie is None


def test_normalised(spark, tmp_path):
    p = tmp_path / "export.csv"
    p.write_text("\n".join([HEAD, *ROWS]))
    raw = read_export(spark, str(p)).withColumn("rec_id", F.monotonically_increasing_id())
    valid, rejected = load_records(raw, spark.createDataFrame([], "rec_id long, ligne string"))
    t = {r.id: r for r in normalised(valid, "2026-02-05 15:00:00").collect()}
    assert rejected.count() == 1 and set(t) == {5732943, 2}
    a = t[5732943]
    assert a.techniciens == ["Anna Bel", "Tom Cor"] and a.technicien_principal == "Anna Bel" and a.groupe_niveau3 == "_N2" and a.categorie_niveau2 == "B" and a.est_vivant and a.anciennete_jours == 30 and a.priorite == 4 and a.urgence == 4
    assert t[2].techniciens == [] and t[2].technicien_principal is None and not t[2].est_vivant


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, True, "A/B c", ["x"]), (2, 5, True, "", ["y"]), (3, 6, False, "D", [])], "id long, import_id long, est_vivant boolean, technicien_principal string, techniciens array<string>")
    sorties.write_plans(df, str(tmp_path / "plans"))
    assert [p.name for p in (tmp_path / "plans").iterdir() if p.is_dir()] == ["technicien=A_B_c"]
    sorties.write_report({"stock": df}, str(tmp_path / "rapport"))
    assert spark.read.csv(str(tmp_path / "rapport/stock"), header=True).count() == 3
    sorties.write_snapshot(df, str(tmp_path / "stock"))
    sorties.write_snapshot(df.where("import_id = 6").withColumn("id", F.lit(9).cast("long")), str(tmp_path / "stock"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "stock")).collect()) == [1, 2, 9]
    with pytest.raises(ValueError):
        sorties.write_report({}, str(tmp_path), "xls")


def test_settings(spark):
    df = spark.createDataFrame([("seuil_z", "3.5"), ("horizon", "abc"), ("autre", "1")], "cle string, valeur string")
    assert read_settings(df) == Reglages(seuil_z=3.5)
    words = spark.createDataFrame([(" Foo ",), ("foo",), (None,)], "mot string")
    assert stop_words(["le", "la"], words, spark.createDataFrame([("LA",)], "mot string")) == ["foo", "le"]


def test_windows_on_a_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed(stream, late="400 days").writeStream.format("memory").queryName("fenetres").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windowed(events).groupBy().agg(F.sum("n"), F.count("*")).first()
    assert tuple(spark.sql("select sum(n), count(*) from fenetres").first()) == tuple(batch)


def test_upserts_on_a_stream(spark, tmp_path):
    schema = "id long, import_id long, statut string, derniere_modification timestamp_ntz, date_resolution timestamp_ntz, nombre_suivis int"
    for k in (1, 2):
        spark.createDataFrame([(1, k, f"s{k}", None, None, None), (k * 10, k, "x", None, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "stock"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.id, r.statut) for r in spark.read.parquet(str(tmp_path / "stock/v1")).collect()) == [(1, "s2"), (10, "x"), (20, "x")]


def test_open_document(spark, tmp_path):
    ns = " ".join(f'xmlns:{n}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for n in ("office", "table", "text"))
    text = lambda v: f'<table:table-cell office:value-type="string"><text:p>{v}</text:p></table:table-cell>'
    cells = '<table:table-cell office:value-type="float" office:value="42.0"/>' + text("Titre") + '<table:table-cell table:number-columns-repeated="1"/>' + text("Clos") + '<table:table-cell table:number-columns-repeated="16000"/>'
    body = f'<table:table-row>{"".join(map(text, HEADERS))}</table:table-row><table:table-row>{cells}</table:table-row><table:table-row table:number-rows-repeated="9"><table:table-cell/></table:table-row>'
    p = tmp_path / "export.ods"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("content.xml", f"<office:document-content {ns}><office:body><office:spreadsheet><table:table>{body}</table:table></office:spreadsheet></office:body></office:document-content>")
    got = read_export(spark, str(p)).collect()
    assert len(got) == 1 and got[0].id == "42" and got[0].titre == "Titre" and got[0].groupe is None and got[0].statut == "Clos" and got[0].categorie is None
    with pytest.raises(ValueError):
        read_export(spark, str(tmp_path / "alt.xls"))


def test_kept_results(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sorties.kept(spark, str(tmp_path / "memoire"), {"import": 3, "mois": 3}, build).count() == 3
    assert sorties.kept(spark, str(tmp_path / "memoire"), {"import": 4, "mois": 3}, build).count() == 3 and len(built) == 2


def test_stop_table(spark):
    from guichet.functions.reglages import stop_table

    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    got = stop_table(spark, ["le", "la"], one("mot", " Foo ", None, ""), one("mot", "LA"), one("nom", "Anna Bel-Tom", "X", None)).collect()
    assert sorted(r.mot for r in got) == ["anna", "bel", "foo", "le", "tom"]
