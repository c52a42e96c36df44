"""Loading delimited records with the damaged ones set apart, each with its reason.

Records come one per row (a cell of text, or already split). Blocks of them are parsed in bulk by
Arrow's columnar CSV reader; a block that fails is bisected until the bad records stand alone, and
only those are diagnosed by the strict reader. Valid values are then checked in JVM expressions.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions.temps import BLANK, read_times
from guichet.operators.instants import resolve

# The 18 fields of an export record, in header order.
FIELDS = (
    "id", "titre", "groupe", "statut", "technicien", "demandeur", "date_ouverture", "type_ticket", "suivis_description",
    "nombre_suivis", "intervention_fournisseur", "solution", "priorite", "taches_description", "urgence", "date_resolution",
    "derniere_modification", "categorie",
)
# Priority labels, lower case, with their number.
PRIORITY_LABELS = {"très basse": 1, "basse": 2, "moyenne": 3, "haute": 4, "très haute": 5, "majeure": 6}
BLOCK = 1024
_FIELD = r'(?:"(?:[^"]|"")*"|[^";\r\n]*)'


def _well_formed(separator: str, more: str) -> str:
    return rf"^{_FIELD}(?:{separator}{_FIELD}){more}(?:\r\n|\n)?$"


def bulk(lines: list[str], width: int, separator: str = ";") -> pa.Table | None:
    """All records of a block as a table of strings, or None if any of them isn't well formed and of full width."""
    array = pa.array([x if x is not None else "" for x in lines], pa.large_string())
    pattern = r"\A" + _well_formed(separator, f"{{{width - 1}}}")[1:-1] + r"\z"
    if not pc.all(pc.match_substring_regex(array, pattern)).as_py():
        return None
    data = "\n".join(x[:-1] if x.endswith("\n") else x for x in array.to_pylist()).encode() + b"\n"
    names = [str(i) for i in range(width)]
    try:
        table = pcsv.read_csv(
            io.BytesIO(data),
            read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(data) + 1, 1 << 16)),
            parse_options=pcsv.ParseOptions(delimiter=separator, newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return table if table.num_rows == len(lines) else None


def strict(line: str | None, width: int, separator: str = ";") -> tuple[str | None, list[str] | None]:
    """(reason, fields) of one record by RFC 4180: ``quoting`` before ``column_count``; a null record has no field."""
    text = re.sub(r"\r?\n\Z", "", line or "")
    field = re.compile(r'"((?:[^"]++|"")*+)"|([^";\r\n]*+)' if separator == ";" else rf'"((?:[^"]++|"")*+)"|([^"{re.escape(separator)}\r\n]*+)')
    fields, at = [], 0
    while True:
        m = field.match(text, at)
        fields.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if at == len(text):
            break
        if text[at] != separator:
            return "quoting", None
        at += 1
    return (None, fields) if len(fields) == width else ("column_count", None)


def parse_block(lines: list[str], width: int, separator: str = ";") -> list[tuple[int, int, pa.Table | None, str | None]]:
    """Pieces (first, last, table, reason) that cover the block in order; a failing block is halved."""
    out, todo = [], [(0, len(lines))]
    while todo:
        a, b = todo.pop()
        if a == b:
            continue
        table = bulk(lines[a:b], width, separator)
        if table is not None:
            out.append((a, b, table, None))
        elif b - a == 1:
            reason, fields = strict(lines[a], width, separator)
            own = pa.table([pa.array([x], pa.string()) for x in fields], names=[str(i) for i in range(width)]) if fields else None
            out.append((a, b, own, reason))
        else:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return out


def split_records(df: DataFrame, key: str = "rec_id", line: str = "ligne", keep: tuple[str, ...] = FIELDS, separator: str = ";", block: int = BLOCK) -> DataFrame:
    """``key, motif, keep...``: the named fields of each record, or null fields with ``motif`` quoting or column_count."""
    at = [FIELDS.index(f) for f in keep]
    schema = pa.schema([(key, pa.int64()), ("motif", pa.string()), *((f, pa.string()) for f in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                keys, lines = part.column(0), part.column(1).to_pylist()
                for a, b, table, reason in parse_block(lines, len(FIELDS), separator):
                    columns = [table.column(k).combine_chunks() if table is not None else pa.nulls(b - a, pa.string()) for k in at]
                    columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).cast(pa.int64()), pa.array([reason] * (b - a), pa.string()), *columns], schema=schema)

    return df.select(F.col(key).cast("long"), line).mapInArrow(run, f"{key} long, motif string, " + ", ".join(f"{f} string" for f in keep))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{BLANK}+|{BLANK}+$", "")


def id_number(c: Column) -> Column:
    """Digits of an id once all white space is removed; null if anything else is in it."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), rf"{BLANK}+", "")
    return F.when(digits.rlike(r"^\d+$"), digits)


def priority_number(c: Column) -> Column:
    """1 to 6 from a number or label; null for a blank; -1 for anything else."""
    bare = F.lower(_bare(c))
    table = F.create_map(*[F.lit(x) for kv in PRIORITY_LABELS.items() for x in kv])
    return F.when(bare == "", None).when(bare.rlike("^[1-6]$"), bare.try_cast("int")).otherwise(F.coalesce(F.try_element_at(table, bare), F.lit(-1)))


def judged(raw: DataFrame, lines: DataFrame, keep: tuple[str, ...] = ("id", "date_ouverture", "priorite")) -> DataFrame:
    """All records of both tables: ``rec_id, motif, keep..., id_num (digits), ouverture_us, priorite_num``.

    ``motif`` is null for a record that can be loaded, else its first reason in the order quoting,
    column_count, id, date_ouverture, priorite. Null and blank values are judged as blanks; records
    sent twice are judged twice; empty tables give no rows. Only named columns are read.
    """
    both = split_records(lines, keep=keep).unionByName(raw.select(F.col("rec_id").cast("long"), F.lit(None).cast("string").alias("motif"), *keep))
    timed = resolve(read_times(both, "date_ouverture"), out="ouverture_us", status="_etat")
    typed = timed.withColumns({"id_num": id_number(F.col("id")), "priorite_num": priority_number(F.col("priorite"))})
    reason = (
        F.when(F.col("motif").isNotNull(), F.col("motif"))
        .when(F.col("id_num").isNull(), "id")
        .when(F.col("ouverture_us").isNull(), "date_ouverture")
        .when(F.col("priorite_num") == -1, "priorite")
    )
    return typed.select("rec_id", reason.alias("motif"), *keep, F.regexp_replace("id_num", r"^0+(?=\d)", "").alias("id_num"), "ouverture_us", "priorite_num")


def load_records(raw: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): typed records with all 18 fields, and ``rec_id, motif``.

    ``id`` is a long; one beyond 18 digits is null there and whole in ``id_texte``, which every valid record has.
    """
    every = judged(raw, lines, FIELDS)
    valid = every.where(F.col("motif").isNull()).select(
        "rec_id", F.col("id_num").try_cast("long").alias("id"), F.col("id_num").alias("id_texte"), F.timestamp_micros("ouverture_us").cast("timestamp_ntz").alias("date_ouverture"), F.col("priorite_num").alias("priorite"),
        *(f for f in FIELDS if f not in ("id", "date_ouverture", "priorite")),
    )
    return valid, every.where(F.col("motif").isNotNull()).select("rec_id", "motif")
