"""DuckDB counterparts of the packed values, timestamps and damaged records.

They follow the definitions, not the operators, and share no constant with them: values by one pattern of
quoted or plain runs, times as a day and a rest, months by their first letters, Paris time by the rule of
the last Sundays of March and October, records by patterns of fields.
"""

from __future__ import annotations

_BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _bare(c: str) -> str:
    return rf"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


P4 = rf"""WITH x AS (SELECT rec_id, 'technicien' AS champ, technicien AS v FROM glpi_ticket_raw UNION ALL SELECT rec_id, 'groupe', groupe FROM glpi_ticket_raw),
 y AS (SELECT rec_id, champ, regexp_replace(regexp_replace(regexp_replace(v, '^\s*\[(.*)\]\s*$', '\1', 's'), '(?i)<br\s*/?>', chr(10), 'g'), '(\s)/(\s)', '\1' || chr(10) || '\2', 'g') AS v FROM x),
 z AS (SELECT rec_id, champ, list_filter(list_transform(regexp_extract_all(v, '"(?:[^"]|"")*"|[^;,|\r\n\t"]+'), lambda s: {_bare('s')}), lambda s: s NOT IN ('', '""')) AS l FROM y),
 u AS (SELECT rec_id, champ, unnest(l) AS s, generate_subscripts(l, 1) AS rang FROM z)
 SELECT rec_id, champ, CAST(rang AS BIGINT) AS rang, CASE WHEN s LIKE '"%' THEN replace(s[2:-2], '""', '"') ELSE s END AS valeur FROM u"""


# Months by their first letters without marks, French and English; only whole names and usual abbreviations are months.
_STARTS = {"jan": 1, "fe": 2, "mar": 3, "av": 4, "ap": 4, "mai": 5, "may": 5, "juin": 6, "jun": 6, "juil": 7, "jul": 7, "ao": 8, "au": 8, "s": 9, "o": 10, "n": 11, "d": 12}
_NAMES = "jan|janv|janvier|january|feb|fev|fevr|fevrier|february|mar|mars|march|avr|avril|apr|april|mai|may|juin|jun|june|juil|juillet|jul|july|aout|aug|august|sep|sept|septembre|september|oct|octobre|october|nov|novembre|november|dec|decembre|december"
_MONTH_OF = "CASE WHEN regexp_full_match(strip_accents(lower(mo.m)), '" + _NAMES + "') THEN CASE " + " ".join(f"WHEN starts_with(strip_accents(lower(mo.m)), '{k}') THEN '{n}'" for k, n in _STARTS.items()) + " END ELSE 'x' END"
_SUNDAY = "(make_date(y, {m}, 31) - CAST(dayofweek(make_date(y, {m}, 31)) AS INTEGER))::TIMESTAMP"


def instants(source: str) -> str:
    """CTEs from ``source(k, champ, texte)`` to ``inst(k, champ, us)``, us null where no real day and time is named."""
    return rf"""c AS (SELECT k, champ, regexp_replace({_bare('texte')}, '{_BLANK}+', ' ', 'g') AS v FROM {source}),
 e AS (SELECT *, regexp_extract(v, '^([0-9]{{4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})(|[T ][0-9].*)$', ['y', 'm', 'd', 'r']) AS an, regexp_extract(v, '^([0-9]{{1,2}})[./-]([0-9]{{1,2}})[./-]([0-9]{{2}}|[0-9]{{4}})(| [0-9].*)$', ['d', 'm', 'y', 'r']) AS jr,
 regexp_extract(v, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})(|Z|[+-][0-9]{{4}})$', ['y', 'm', 'd', 'h', 'i', 's', 'r']) AS co, regexp_extract(v, '^(?:\p{{L}}+\.?,? )?([0-9]{{1,2}})(?:er)? (\p{{L}}+)\.? ([0-9]{{4}})(|,? (?:à )?[0-9].*)$', ['d', 'm', 'y', 'r']) AS mo FROM c),
 f AS (SELECT *, CASE WHEN an.y <> '' THEN [an.y, an.m, an.d, an.r] WHEN jr.y <> '' THEN [CASE WHEN length(jr.y) = 2 THEN '20' || jr.y ELSE jr.y END, jr.m, jr.d, jr.r]
 WHEN co.y <> '' THEN [co.y, co.m, co.d, ' ' || co.h || ':' || co.i || ':' || co.s || co.r] WHEN mo.y <> '' THEN [mo.y, {_MONTH_OF}, mo.d, regexp_replace(mo.r, '^,? (?:à )?([0-9]{{1,2}})(?: h |h)', ' \1:')] END AS p FROM e),
 g AS (SELECT *, regexp_extract(p[4], '^(?:|[T ]|,? (?:à )?)([0-9]{{1,2}}):([0-9]{{2}}|)(?::([0-9]{{2}})(?:[.,]([0-9]{{1,9}}))?)?(?: ?(Z|UTC|GMT|CET|CEST|[+-][0-9]{{2}}:?[0-9]{{2}}|[+-][0-9]{{2}})| ([A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+)+))?(?:\[([A-Za-z_/+-]+)\])?$', ['h', 'i', 's', 'u', 'o', 'z', 'b']) AS t FROM f),
 n AS (SELECT *, p IS NOT NULL AS ecrit, coalesce(TRY_CAST(t.h AS INTEGER), 0) AS h, coalesce(TRY_CAST(t.i AS INTEGER), 0) AS mi, coalesce(TRY_CAST(t.s AS INTEGER), 0) AS sec, coalesce(TRY_CAST(rpad(t.u, 6, '0')[1:6] AS BIGINT), 0) AS us, t.o AS o, coalesce(t.z, '') || coalesce(t.b, '') AS z FROM g),
 r AS (SELECT *, CASE WHEN ecrit AND (p[4] = '' OR t.h <> '') AND h < 24 AND mi < 60 AND sec < 60 THEN TRY_CAST(lpad(p[1], 4, '0') || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') AS TIMESTAMP) + to_hours(h) + to_minutes(mi) + to_seconds(sec) + to_microseconds(us)
 WHEN NOT ecrit AND regexp_matches(v, '^[0-9]{{1,7}}([.,][0-9]+)?$') AND TRY_CAST(replace(v, ',', '.') AS DOUBLE) BETWEEN 1 AND 2958465.999999 THEN TIMESTAMP '1899-12-30' + to_seconds(CAST(round(CAST(replace(v, ',', '.') AS DECIMAL(20, 10)) * 86400, 0) AS BIGINT)) END AS loc,
 CASE WHEN o IN ('Z', 'UTC', 'GMT') THEN 0 WHEN o = 'CET' THEN 60 WHEN o = 'CEST' THEN 120 WHEN o <> '' THEN (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (CAST(replace(o, ':', '')[2:3] AS INTEGER) * 60 + coalesce(TRY_CAST(replace(o, ':', '')[4:5] AS INTEGER), 0)) END AS off FROM n),
 w AS (SELECT *, year(loc) AS y FROM r),
 q AS (SELECT *, {_SUNDAY.format(m=3)} + INTERVAL 2 HOUR AS ete, {_SUNDAY.format(m=10)} + INTERVAL 3 HOUR AS hiver FROM w),
 inst AS (SELECT k, champ, CASE WHEN regexp_matches(v, '^\d{{10}}$') THEN CAST(v AS BIGINT) * 1000000 WHEN regexp_matches(v, '^\d{{13}}$') THEN CAST(v AS BIGINT) * 1000 WHEN regexp_matches(v, '^\d{{16}}$') THEN CAST(v AS BIGINT)
 WHEN off IS NOT NULL THEN epoch_us(loc) - off * 60000000::BIGINT WHEN z = 'America/Guadeloupe' THEN epoch_us(loc) + 14400000000 WHEN z = 'Indian/Mayotte' THEN epoch_us(loc) - 10800000000 WHEN z = 'Indian/Reunion' THEN epoch_us(loc) - 14400000000
 WHEN z NOT IN ('', 'Europe/Paris') OR (loc >= ete AND loc < ete + INTERVAL 1 HOUR) THEN NULL WHEN loc >= ete AND loc < hiver THEN epoch_us(loc) - 7200000000 ELSE epoch_us(loc) - 3600000000 END AS us FROM q)"""


P5 = (
    "WITH src AS (SELECT rec_id AS k, unnest([{'champ': 'date_ouverture', 'texte': date_ouverture}, {'champ': 'date_resolution', 'texte': date_resolution}, {'champ': 'derniere_modification', 'texte': derniere_modification}], recursive := true) FROM glpi_ticket_raw), "
    + instants("src")
    + " SELECT k AS rec_id, champ, CAST(us AS BIGINT) AS instant_us FROM inst WHERE us IS NOT NULL"
)
_F = r'(?:"(?:[^"]|"")*"|[^";\r\n]*)'


def _field(k: int) -> str:
    raw = f"regexp_extract(ligne, '^(?:{_F};){{{k}}}({_F})', 1)"
    return f"CASE WHEN {raw} LIKE '\"%' THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


# Priority labels, and the places of the fields in a record, from 0.
_LABELS = "'très basse', 'basse', 'moyenne', 'haute', 'très haute', 'majeure'"
_ID, _OPENED, _PRIORITY = 0, 6, 12
P6 = (
    rf"""WITH l AS (SELECT rec_id, regexp_replace(coalesce(ligne, ''), '\r?\n$', '') AS ligne FROM glpi_lignes),
 j AS (SELECT rec_id, ligne, CASE WHEN NOT regexp_full_match(ligne, '{_F}(?:;{_F})*') THEN 'quoting' WHEN NOT regexp_full_match(ligne, '{_F}(?:;{_F}){{17}}') THEN 'column_count' END AS motif FROM l),
 a AS (SELECT rec_id, motif, CASE WHEN motif IS NULL THEN {_field(_ID)} END AS id, CASE WHEN motif IS NULL THEN {_field(_OPENED)} END AS date_ouverture, CASE WHEN motif IS NULL THEN {_field(_PRIORITY)} END AS priorite FROM j
 UNION ALL SELECT rec_id, NULL, id, date_ouverture, priorite FROM glpi_ticket_raw),
 src AS (SELECT rec_id AS k, 'd' AS champ, coalesce(date_ouverture, '') AS texte FROM a), """
    + instants("src")
    + rf""", b AS (SELECT a.rec_id, CASE WHEN motif IS NOT NULL THEN motif WHEN NOT regexp_full_match(regexp_replace(coalesce(id, ''), '{_BLANK}', '', 'g'), '\d+') THEN 'id' WHEN us IS NULL THEN 'date_ouverture'
 WHEN NOT (lower({_bare("coalesce(priorite, '')")}) IN ('', '1', '2', '3', '4', '5', '6', {_LABELS})) THEN 'priorite' END AS motif FROM a JOIN inst ON k = a.rec_id)
 SELECT rec_id, motif FROM b WHERE motif IS NOT NULL"""
)
P5_STATES = (
    P5.split(" SELECT k AS rec_id")[0]
    + """ SELECT champ, CASE WHEN regexp_matches(v, '^([0-9]{10}|[0-9]{13}|[0-9]{16})$') OR (loc IS NOT NULL AND off IS NOT NULL) THEN 'exact' WHEN loc IS NULL THEN 'illisible' WHEN z IN ('America/Guadeloupe', 'Indian/Mayotte', 'Indian/Reunion') THEN 'decale'
 WHEN z NOT IN ('', 'Europe/Paris') OR (loc >= ete AND loc < ete + INTERVAL 1 HOUR) THEN 'inexistant' WHEN loc >= hiver - INTERVAL 1 HOUR AND loc < hiver THEN 'ambigu' ELSE 'decale' END AS etat, count(*) AS n FROM q GROUP BY 1, 2"""
)
_NAMES_18 = "id titre groupe statut technicien demandeur date_ouverture type_ticket suivis_description nombre_suivis intervention_fournisseur solution priorite taches_description urgence date_resolution derniere_modification categorie".split()
_PLAIN = [n for n in _NAMES_18 if n not in ("id", "date_ouverture", "priorite")]
_NUMBERS = "CASE lower({p}) WHEN 'très basse' THEN 1 WHEN 'basse' THEN 2 WHEN 'moyenne' THEN 3 WHEN 'haute' THEN 4 WHEN 'très haute' THEN 5 WHEN 'majeure' THEN 6 ELSE TRY_CAST({p} AS INTEGER) END"
P6_VALID = (
    P6.replace("a AS (SELECT rec_id, motif, ", "a AS (SELECT rec_id, motif, " + ", ".join(f"CASE WHEN motif IS NULL THEN {_field(_NAMES_18.index(n))} END AS {n}" for n in _PLAIN) + ", ", 1)
    .replace("UNION ALL SELECT rec_id, NULL, id,", "UNION ALL SELECT rec_id, NULL, " + ", ".join(_PLAIN) + ", id,", 1)
    .replace("b AS (SELECT a.rec_id, CASE", "b AS (SELECT a.*, us, CASE", 1)
    .replace("END AS motif FROM a JOIN inst", "END AS faute FROM a JOIN inst", 1)
    .rsplit(" SELECT rec_id, motif FROM b", 1)[0]
    + f""", o AS (SELECT *, regexp_replace(regexp_replace(id, '{_BLANK}', '', 'g'), '^0+([0-9])', '\\1') AS id_texte, {_bare('priorite')} AS pr FROM b WHERE faute IS NULL)
 SELECT rec_id, TRY_CAST(id_texte AS BIGINT) AS id, id_texte, make_timestamp(CAST(us AS BIGINT)) AS date_ouverture, CAST({_NUMBERS.format(p='pr')} AS INTEGER) AS priorite, {', '.join(_PLAIN)} FROM o"""
)
ORACLES = {"p4_found": P4, "p5_found": P5, "p5_etats": P5_STATES, "p6_found": P6, "p6_valides": P6_VALID}
