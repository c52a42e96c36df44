"""Imports: registry, profile, merge and replace, export files written and read again, reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.operators import instantane
from guichet.operators.instantane import filled, merge, snapshot
from guichet.plans import stock
from guichet.plans.registre import Registre
from guichet.session import load, shared_folder
from guichet.sources import sorties
from guichet.sources.fichiers import HEADERS, read_export
from guichet.streaming import flux_evenements

query = Registre()


@query("""SELECT import_id, count(*) AS lignes, count(DISTINCT id) AS ids, count(*) FILTER (est_vivant) AS vivants, count(*) FILTER (NOT est_vivant) AS termines, min(date_ouverture) AS premiere, max(date_ouverture) AS derniere,
 count(DISTINCT statut) AS statuts, count(DISTINCT type_ticket) AS types, count(DISTINCT groupe_principal) AS groupes FROM tickets GROUP BY 1""", newest=False)  # fmt: skip
def import_profiles(spark: SparkSession, d: str) -> DataFrame:
    return instantane.import_profile(load(spark, d, "tickets"))


@query("""SELECT import_id, champ, valeur, count(*) AS n FROM (SELECT import_id, 'statut' AS champ, statut AS valeur FROM tickets UNION ALL SELECT import_id, 'type_ticket', type_ticket FROM tickets UNION ALL SELECT import_id, 'groupe', unnest(groupes) FROM tickets)
 WHERE valeur <> '' GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""", newest=False)  # fmt: skip
def import_values(spark: SparkSession, d: str) -> DataFrame:
    """The different statuses, types and groups (one row per group of a ticket) of each import, sorted; counted before the shuffle."""
    t = load(spark, d, "tickets")
    one = lambda name, c: F.transform(c, lambda x: F.struct(F.lit(name).alias("champ"), x.alias("valeur")))
    every = F.concat(one("statut", F.array("statut")), one("type_ticket", F.array("type_ticket")), one("groupe", F.coalesce("groupes", F.array().cast("array<string>"))))
    rows = t.select("import_id", F.explode(every).alias("v")).select("import_id", "v.*").where(filled(F.col("valeur")))
    return rows.groupBy("import_id", "champ", "valeur").agg(F.count(F.lit(1)).alias("n")).orderBy("import_id", "champ", "valeur")


@query("SELECT id, filename, import_date, is_active FROM imports ORDER BY import_date DESC, id DESC", newest=False)
def import_list(spark: SparkSession, d: str) -> DataFrame:
    return instantane.import_history(load(spark, d, "imports"))


_MERGED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY import_id > 12 DESC, import_id DESC, derniere_modification DESC NULLS LAST,
 date_resolution DESC NULLS LAST, nombre_suivis DESC NULLS LAST, statut DESC NULLS LAST) AS rn FROM tickets) WHERE rn = 1"""


def _merged(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = load(spark, d, "tickets").select("id", *{"import_id", "statut", "derniere_modification", "date_resolution", "nombre_suivis", *columns})
    return merge(t.where("import_id <= 12"), t.where("import_id > 12"))


@query(f"SELECT id, import_id, statut, priorite FROM ({_MERGED})", newest=False)
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Later imports merged into earlier ones; new rows win."""
    return _merged(spark, d, "priorite").select("id", "import_id", "statut", "priorite")


_META = "count(*) AS lignes, count(*) FILTER (est_vivant) AS vivants, count(*) FILTER (NOT est_vivant) AS termines, min(date_ouverture) AS premiere, max(date_ouverture) AS derniere"


@query(f"SELECT {_META} FROM ({_MERGED})", newest=False)
def merge_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The registry's figures recomputed over the merged stock."""
    return instantane.metadata(_merged(spark, d, "est_vivant", "date_ouverture"))


@query("SELECT i.id, i.is_active, count(x.id) AS lignes FROM (SELECT id, false AS is_active FROM imports UNION ALL SELECT max(id) + 1, true FROM imports) i LEFT JOIN (SELECT id, import_id FROM tickets UNION ALL SELECT id, (SELECT max(id) + 1 FROM imports) FROM t WHERE est_vivant) x ON x.import_id = i.id GROUP BY 1, 2")
def import_replace(spark: SparkSession, d: str) -> DataFrame:
    """The live stock delivered again as a new snapshot: the only active one, beside the old ones."""
    t = load(spark, d, "tickets").select("id", "import_id", "est_vivant")
    tickets, imports = instantane.replaced(t, load(spark, d, "imports"), snapshot(spark, d, "est_vivant").where("est_vivant"), "stock.csv", "2025-11-01")
    sizes = tickets.groupBy(F.col("import_id").alias("id")).agg(F.count(F.lit(1)).alias("lignes"))
    return imports.select("id", "is_active").join(sizes, "id", "left").na.fill(0, ["lignes"])


@query("SELECT i.id, count(t.id) AS lignes FROM imports i LEFT JOIN tickets t ON t.import_id = i.id WHERE i.id <> (SELECT min(id) FROM imports) GROUP BY 1", newest=False)
def import_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows per import once the first import is deleted with its tickets."""
    first = load(spark, d, "imports").agg(F.min("id")).first()[0]
    tickets, imports = instantane.deleted(load(spark, d, "tickets").select("id", "import_id"), load(spark, d, "imports"), first)
    sizes = tickets.groupBy(F.col("import_id").alias("id")).agg(F.count(F.lit(1)).alias("lignes"))
    return imports.select("id").join(sizes, "id", "left").na.fill(0, ["lignes"])


@query("SELECT id, filename, import_date FROM imports WHERE filename = (SELECT max(filename) FROM imports)", newest=False)
def import_known_file(spark: SparkSession, d: str) -> DataFrame:
    """Imports that read a file of the same name as the one at hand."""
    imports = load(spark, d, "imports")
    return instantane.known_file(imports, imports.agg(F.max("filename")).first()[0])


@query("""WITH a AS (SELECT DISTINCT ON (id) * FROM (SELECT * FROM tickets WHERE import_id = (SELECT max(id) FROM imports WHERE is_active)) ORDER BY id, derniere_modification DESC NULLS LAST, date_resolution DESC NULLS LAST, nombre_suivis DESC NULLS LAST, statut DESC NULLS LAST)
 SELECT statut, count(*) AS n, count(*) FILTER (est_vivant) AS vivants FROM a GROUP BY 1""", newest=False)  # fmt: skip
def active_stock(spark: SparkSession, d: str) -> DataFrame:
    """Tickets of the active import by status: the import is a filter of the scan."""
    return instantane.active_snapshot(spark, d, "statut", "est_vivant").groupBy("statut").agg(F.count(F.lit(1)).alias("n"), F.count_if("est_vivant").alias("vivants"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_TEXTS = tuple(f for f, _ in HEADERS.values())


@query("SELECT " + ", ".join(f"nullif(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') AS {c}" for c in _TEXTS) + " FROM glpi_ticket_raw", newest=False)
def export_reread(spark: SparkSession, d: str) -> DataFrame:
    """All raw records written as export files (headers, semicolons, quoted fields with line breaks) and read again: decoding, header map, projection. Line ends come out as one line feed."""
    folder = _place(spark, "export")
    raw = load(spark, d, "glpi_ticket_raw").select(*[F.col(f).alias(h) for h, (f, _) in HEADERS.items()])
    raw.write.csv(folder, sep=";", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    back = read_export(spark, folder)
    return back.select(*[F.nullif(F.regexp_replace(c, "\r\n?", "\n"), F.lit("")).alias(c) for c in _TEXTS])


_REPORT = {"par_statut": "stock_by_status", "par_technicien": "stock_by_technician", "par_groupe": "stock_by_group"}


@query("SELECT 'par_statut' AS section, count(*) AS lignes FROM (SELECT DISTINCT statut, est_vivant FROM t) UNION ALL SELECT 'par_technicien', count(DISTINCT technicien_principal) FROM t WHERE est_vivant AND technicien_principal <> '' UNION ALL SELECT 'par_groupe', count(*) FROM (SELECT DISTINCT groupe_principal, groupe_niveau1, groupe_niveau2 FROM t WHERE est_vivant AND groupe_principal <> '')")
def report_stock(spark: SparkSession, d: str) -> DataFrame:
    """The three sections of the stock report, written in parallel and read again."""
    folder = _place(spark, "rapport")
    sorties.write_report({name: stock.query.queries[q](spark, d) for name, q in _REPORT.items()}, folder)
    return reduce(DataFrame.unionByName, [spark.read.csv(f"{folder}/{name}", header=True).agg(F.count(F.lit(1)).alias("lignes")).select(F.lit(name).alias("section"), "lignes") for name in _REPORT])


@query(r"SELECT regexp_replace(trim(technicien_principal), '[^\p{L}\p{N}_-]+', '_', 'g') AS technicien, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM t WHERE est_vivant AND technicien_principal <> '' GROUP BY 1")
def plan_files(spark: SparkSession, d: str) -> DataFrame:
    """One plan of live tickets per assignee, written as a folder each and read again."""
    folder = _place(spark, "plans")
    sorties.write_plans(snapshot(spark, d, "titre", "est_vivant", "technicien_principal", "anciennete_jours"), folder)
    return spark.read.schema("id long, technicien string").json(folder).groupBy("technicien").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", newest=False)
def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows over the event table read as a stream with a watermark, all of it available, written as it closes."""
    return flux_evenements.run_windows(spark, f"{d}/events.parquet", _place(spark, "flux")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
