"""Reading dates and times written in many ways (text to parts), all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as written in French and English mails and exports.
MONTHS = {
    "janvier": 1, "janv": 1, "jan": 1, "january": 1,
    "février": 2, "fevrier": 2, "févr": 2, "fevr": 2, "fév": 2, "feb": 2, "february": 2,
    "mars": 3, "mar": 3, "march": 3,
    "avril": 4, "avr": 4, "apr": 4, "april": 4,
    "mai": 5, "may": 5,
    "juin": 6, "jun": 6, "june": 6,
    "juillet": 7, "juil": 7, "jul": 7, "july": 7,
    "août": 8, "aout": 8, "aug": 8, "august": 8,
    "septembre": 9, "sept": 9, "sep": 9, "september": 9,
    "octobre": 10, "oct": 10, "october": 10,
    "novembre": 11, "nov": 11, "november": 11,
    "décembre": 12, "decembre": 12, "déc": 12, "dec": 12, "december": 12,
}
# Zone abbreviations with one meaning, in minutes east of UTC.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120}
LAST_SERIAL = 2958465  # 9999-12-31 as a spreadsheet day

# The blanks Java's \s leaves out are listed.
BLANK = r"[\s\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF]"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:[ ]?(Z|UTC|GMT|CET|CEST|[+-]\d{2}:?\d{2}|[+-]\d{2})|[ ]([A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+)+))?(?:\[([A-Za-z_/+-]+)\])?"
_ISO = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[T ]{_TIME}{_ZONE})?$"
_DAY_FIRST = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?: {_TIME}{_ZONE})?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{4})?$"
_WORDS = r"^(?:\p{L}+\.?,? )?(\d{1,2})(?:er)? (\p{L}+)\.? (\d{4})(?:,? (?:à )?(\d{1,2})(?:h|:| h )(\d{2})?(?::(\d{2}))?(?: (Z|UTC|GMT|CET|CEST|[+-]\d{4}))?)?$"
_SERIAL = r"^\d{1,7}(?:[.,]\d+)?$"


# year, month, day, hour, minute, second, fraction, offset, zone of each form.
_FORMS = (
    (_ISO, "$1|$2|$3|$4|$5|$6|$7|$8|$9$10"),
    (_DAY_FIRST, "$3|$2|$1|$4|$5|$6|$7|$8|$9$10"),
    (_COMPACT, "$1|$2|$3|$4|$5|$6||$7|"),
    (_WORDS, "$3|$2|$1|$4|$5|$6||$7|"),
)


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def read_times(df: DataFrame, text: str, out: str = "lu") -> DataFrame:
    """Adds ``out``: struct(local_us, instant_us, zone) of a written time; all null if it names no day and time.

    ``instant_us``: the value names an instant by itself (epoch, offset, abbreviation).
    ``local_us``: civil time as if it were UTC, to be resolved in ``zone``.
    The day stands before the month unless the year stands first; two-digit years are 20xx;
    a spreadsheet's day count is rounded to the second. Every form is first rewritten to one
    delimited line, so the calendar arithmetic stands once in the generated code.
    """
    v = F.regexp_replace(F.regexp_replace(F.col(text), rf"^{BLANK}+|{BLANK}+$", ""), rf"{BLANK}+", " ")
    line = F.when(F.col("_v").rlike(_FORMS[0][0]), F.regexp_replace("_v", *_FORMS[0]))
    for form, order in _FORMS[1:]:
        line = line.when(F.col("_v").rlike(form), F.regexp_replace("_v", form, order))
    at = lambda i: F.get("_p", F.lit(i))
    number = lambda i: F.when(at(i) == "", 0).otherwise(at(i).try_cast("int"))
    year = F.when(F.length(at(0)) == 2, number(0) + 2000).otherwise(number(0))
    month = F.coalesce(number(1), _lookup(MONTHS, F.lower(at(1))))
    digits = F.regexp_replace(at(7), ":", "")
    h, m = F.substring(digits, 2, 2).try_cast("int"), F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    signed = F.when((h <= 18) & (m < 60), (h * 60 + m) * F.when(digits.startswith("-"), -1).otherwise(1))
    micros = F.rpad(at(6), 6, "0").substr(1, 6).try_cast("int")
    days = F.regexp_replace("_v", ",", ".").try_cast("decimal(38,12)")
    serial = F.when((days >= 1) & (days < LAST_SERIAL + 1), F.round((days - 25569) * 86400, 0).cast("long") * 1_000_000)  # 25569 days from 1899-12-30 to 1970-01-01
    epoch = F.col("_v").try_cast("long") * F.when(F.length("_v") == 10, 1_000_000).when(F.length("_v") == 13, 1_000).otherwise(1)
    is_epoch, is_serial = F.col("_v").rlike(r"^(\d{10}|\d{13}|\d{16})$"), F.col("_v").rlike(_SERIAL)
    civil = (F.unix_date("_jour").cast("long") * 86400 + number(3) * 3600 + number(4) * 60 + number(5)) * 1_000_000 + micros
    good = F.col("_jour").isNotNull() & (number(3) < 24) & (number(4) < 60) & (number(5) < 60)
    return (
        df.withColumn("_v", v)
        .withColumn("_p", F.split(line, r"\|"))
        .withColumns({"_jour": F.try_make_timestamp_ntz(year, month, number(2), F.lit(0), F.lit(0), F.lit(0)).cast("date"), "_dec": F.coalesce(_lookup(ABBREVIATIONS, at(7)), signed)})
        .withColumn("_us", F.when(good, civil).when(F.col("_p").isNull() & is_serial, serial))
        .withColumn(
            out,
            F.struct(
                F.when(F.col("_dec").isNull(), F.col("_us")).alias("local_us"),
                F.when(is_epoch, epoch).otherwise(F.col("_us") - F.col("_dec").cast("long") * 60_000_000).alias("instant_us"),
                F.when(F.col("_us").isNotNull() & F.col("_dec").isNull(), F.when(F.coalesce(at(8), F.lit("")) == "", "Europe/Paris").otherwise(at(8))).alias("zone"),
            ),
        )
        .drop("_v", "_p", "_jour", "_dec", "_us")
    )
