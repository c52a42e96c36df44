"""Reading export files: delimited text in either encoding, workbooks; headers mapped by name."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers of an export, the field each fills, and whether it must be there.
HEADERS = {
    "ID": ("id", True), "Titre": ("titre", True), "Attribué à - Groupe de techniciens": ("groupe", False), "Statut": ("statut", True), "Attribué à - Technicien": ("technicien", True),
    "Demandeur - Demandeur": ("demandeur", True), "Date d'ouverture": ("date_ouverture", True), "Type": ("type_ticket", True), "Suivis - Description": ("suivis_description", True),
    "Suivis - Nombre de suivis": ("nombre_suivis", False), "Plugins - Intervention fourniseur : Intervention": ("intervention_fournisseur", False), "Solution - Solution": ("solution", True),
    "Priorité": ("priorite", False), "Tâches - Description": ("taches_description", False), "Urgence": ("urgence", False), "Date de résolution": ("date_resolution", True), "Dernière modification": ("derniere_modification", False),
    "Catégorie": ("categorie", True),
}


#: Characters of Windows-1252 whose code ISO-8859-1 gives to a control character.
_WESTERN = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


class MissingColumns(ValueError):
    """Names every required column that is missing."""

    def __init__(self, names: list[str]):
        super().__init__("missing columns: " + ", ".join(names))
        self.names = names


def decode(data: bytes) -> str:
    """UTF-8 without its mark, or else Windows-1252."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", errors="replace")


def encoding_of(spark: SparkSession, path: str) -> str:
    """``UTF-8`` if all bytes of the file are, else ``windows-1252``; a distributed scan that stops at the first bad line."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "windows-1252" if bad.limit(1).count() else "UTF-8"


def by_fields(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(the 18 fields as text, optional headers that are missing). Headers are trimmed; of equal ones the last counts.

    Missing required headers raise before any job runs.
    """
    place: dict[str, int] = {}
    for k, name in enumerate(df.columns):
        place[name.removeprefix("\ufeff").strip()] = k
    lost = [h for h, (_, needed) in HEADERS.items() if needed and h not in place]
    if lost:
        raise MissingColumns(lost)
    plain = df.toDF(*[f"_c{k}" for k in range(len(df.columns))])
    columns = [(F.col(f"_c{place[h]}").cast("string") if h in place else F.lit(None).cast("string")).alias(f) for h, (f, _) in HEADERS.items()]
    return plain.select(*columns), [h for h, (_, needed) in HEADERS.items() if not needed and h not in place]


def read_delimited(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """Raw records of a delimited export: quoted fields may hold separators and line breaks, short rows are filled with
    nulls, cells beyond the header are dropped. An empty file is an error."""
    western = encoding_of(spark, path) != "UTF-8"
    df = spark.read.csv(path, sep=separator, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="ISO-8859-1" if western else "UTF-8")
    if not df.columns:
        raise ValueError("empty file")
    if western:  # read byte by byte; the places where Windows-1252 differs are translated
        df = df.toDF(*[c.translate(_WESTERN) for c in df.columns])
        old, new = "".join(map(chr, _WESTERN)), "".join(_WESTERN.values())
        df = df.toDF(*[f"_{k}" for k in range(len(df.columns))]).select(*[F.translate(f"_{k}", old, new).alias(c) for k, c in enumerate(df.columns)])
    return by_fields(df)[0]


# Workbooks

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(_NS + "t"))


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(book: str | bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an .xlsx or .ods file (a path, or its bytes), cells as text: whole numbers without decimals, dates of .xlsx as day counts."""
    with zipfile.ZipFile(io.BytesIO(book) if isinstance(book, bytes) else book) as z:
        if "content.xml" in z.namelist():
            yield from _open_document_rows(z)
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == _NS + "si":
                        shared.append(_text(e))
                        e.clear()
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _NS + "row":
                    continue
                cells: list[str | None] = []
                for k, c in enumerate(row.iter(_NS + "c")):
                    at = _column(c.get("r")) if c.get("r") else k
                    cells += [None] * (at - len(cells))
                    value, kind = c.find(_NS + "v"), c.get("t")
                    if kind == "inlineStr":
                        cells.append(_text(c))
                    elif value is None or value.text is None:
                        cells.append(None)
                    elif kind == "s":
                        cells.append(shared[int(value.text)])
                    else:
                        cells.append(_plain_number(value.text))
                yield cells
                row.clear()


def _plain_number(text: str) -> str:
    number = re.fullmatch(r"(-?\d+)\.0*", text)
    return number[1] if number else text


def _open_document_rows(z: zipfile.ZipFile) -> Iterator[list[str | None]]:
    """Rows of the first table of an OpenDocument sheet; repeated cells are written out, trailing empty ones and empty rows left out."""
    office, table, words = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("office", "table", "text"))
    with z.open("content.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == table + "table":
                return
            if e.tag != table + "table-row":
                continue
            cells: list[str | None] = []
            for c in e:
                if c.tag not in (table + "table-cell", table + "covered-table-cell"):
                    continue
                kind, lines = c.get(office + "value-type"), ["".join(p.itertext()) for p in c.iter(words + "p")]
                value = _plain_number(c.get(office + "value")) if kind in ("float", "currency", "percentage") else c.get(office + "date-value") if kind == "date" else "\n".join(lines) or None
                times = int(c.get(table + "number-columns-repeated", 1))
                cells += [value] * (times if value is not None else min(times, 1024))
            while cells and cells[-1] is None:
                cells.pop()
            if cells:
                yield cells
            e.clear()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of the first sheet of .xlsx or .ods files of any file system Spark reads, one task per file; columns by the first file's header."""
    books = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column(1):
                rows = sheet_rows(book.as_py())
                header = next(rows, [])
                found = [header] if first else list(rows)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["cellules"])

    header = books.orderBy("path").limit(1).mapInArrow(lambda b: read(b, True), "cellules array<string>").first()
    if header is None or not header.cellules:
        raise ValueError("empty file")
    rows = books.mapInArrow(lambda b: read(b, False), "cellules array<string>")
    names = [(h or f"colonne{k}").strip() for k, h in enumerate(header.cellules)]
    wide = rows.select(*[F.get("cellules", F.lit(k)).alias(f"_w{k}") for k in range(len(names))])
    return by_fields(wide.toDF(*names))[0]


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of an export by its extension: workbooks, else delimited text. The binary formats .xls and .xlsb are an error."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind in ("xls", "xlsb"):
        raise ValueError(f".{kind} can't be read: save it as .xlsx or .ods")
    return read_workbook(spark, path) if kind in ("xlsx", "xlsm", "ods") else read_delimited(spark, path)
