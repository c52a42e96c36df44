"""Raw records to typed tickets: trimmed texts, numbers, arrays of values, levels, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of a live ticket; a parameter of ``normalised``.
LIVE = ("Nouveau", "En cours (Attribué)", "En cours (Planifié)", "En attente")


def parts(c: Column, separator: str) -> Column:
    """Trimmed, non-empty parts in order; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def whole_days(late: Column, early: Column) -> Column:
    """Full days between, cut toward zero."""
    return ((F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / 86_400_000_000).cast("long")


def normalised(valid: DataFrame, as_of: str, live: tuple[str, ...] = LIVE) -> DataFrame:
    """Typed tickets of ``load_records``' valid rows. Rows without a status are left out.

    ``as_of`` dates the ages; nothing depends on the clock.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    number = lambda c: F.trim(F.col(c)).try_cast("int")
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    t = valid.withColumns(
        {
            "titre": text("titre"), "statut": text("statut"), "type_ticket": text("type_ticket"), "demandeur": text("demandeur"), "urgence": number("urgence"), "nombre_suivis": number("nombre_suivis"),
            "techniciens": parts(F.col("technicien"), r"\r?\n"), "groupes": parts(F.col("groupe"), r"\r?\n"), "categorie": F.nullif(F.trim("categorie"), F.lit("")),
        }
    ).where(F.col("statut") != "")
    t = t.withColumns({"technicien_principal": F.get("techniciens", F.lit(0)), "groupe_principal": F.get("groupes", F.lit(0)), "est_vivant": F.col("statut").isin(*live)})
    group, category = parts(F.col("groupe_principal"), " > "), parts(F.col("categorie"), " > ")
    return t.withColumns(
        {**{f"groupe_niveau{k + 1}": F.get(group, F.lit(k)) for k in range(3)}, **{f"categorie_niveau{k + 1}": F.get(category, F.lit(k)) for k in range(2)}, "anciennete_jours": whole_days(at, F.col("date_ouverture"))}
    ).drop("technicien", "groupe")
