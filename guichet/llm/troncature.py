"""Texts cut off before their end: hidden field limits, and endings.

Lengths are recomputed as storage systems count them (characters, UTF-8 bytes, UTF-16 units, with
HTML or JSON escapes, with CRLF). Per source and measure, a length far more frequent than its
neighbours exposes a limit. Endings are then inspected: a text is cut if it stops within a word,
sentence or tag; greetings, signatures, list entries, references and replies are whole although no
stop ends them. Customary closings are learned the way limits are: a last line that is far more
frequent among different texts than its own beginnings is a closing, for a text cut by chance stops
at a line's every letter alike. No threshold follows the number of texts, so a document is judged
alike in a small and in a large collection. All of it runs in JVM expressions over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guichet.session import cut

# Closings that end a text without a full stop, lower case; a seed for collections too small to show them.
CLOSINGS = (
    "cordialement", "bien cordialement", "bien à vous", "merci", "merci d'avance", "merci beaucoup", "bonne journée", "bonne réception", "sincères salutations",
    "à bientôt", "à tout de suite", "ok", "ok merci", "parfait", "nickel", "ça marche", "pas de souci", "je regarde", "je clos alors", "c'est bon pour moi",
    "regards", "kind regards", "best regards", "best wishes", "thanks", "thank you",
    "mit freundlichen grüßen", "viele grüße", "danke",
    "un saludo", "saludos", "gracias", "gracias de antemano",
)
# Words that announce more to come, so that an ellipsis after them cuts nothing.
CONTINUED = (r"\? suivre", "a suivre", "to be continued")  # accents as _line_key writes them
#: A last line of LINE_LEAST different texts, LINE_TIMES as many as each of its SHORTER forms has in the mean, is a closing.
LINE_LEAST, LINE_TIMES, SHORTER, LINE_CHARS = 4, 5.0, 8, 60
#: A length this many times as frequent as the mean of its 30 neighbours, and in LIMIT_LEAST texts, is a limit.
LIMIT_TIMES, LIMIT_LEAST = 5.0, 6
_AROUND = 15
#: A table of closings of at most so many rows (of 60 characters) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
_BLANK = r"[\s\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF]"
_TRAILING = " \t\n\r\x0b\x0c\u00a0\u1680\u2007\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"
_TAIL = 64  # characters of an ending: longer than any form looked for there
_BROKEN = "\u00e2\u0080?\u00a6"  # an ellipsis decoded wrongly, its control character lost or not
_ELLIPSIS = rf"(?:\[\.\.\.\]|\[…\]|…|\.\.\.|{_BROKEN}|â€¦)$"


MEASURES = ("caracteres", "utf8", "utf16", "entites", "json", "crlf", "utf8_crlf")


def _measures(text: Column) -> Column:
    """Lengths of a text in the order of ``MEASURES``; single characters are counted by byte replacement."""
    chars, utf8 = F.length(text), F.octet_length(text)

    def many(*found: str) -> Column:
        out = F.lit(0)
        for c in found:
            out = out + utf8 - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
        return out

    newlines = many("\n") - (utf8 - F.octet_length(F.replace(text, F.lit("\r\n"), F.lit("\n"))))
    return F.array(
        chars,
        utf8,
        (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"),
        chars + 4 * many("&") + 3 * many("<", ">") + 5 * many('"'),
        chars + many('"', "\\", "\n", "\t", "\r"),
        chars + newlines,
        utf8 + newlines,
    )


def inspected(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, source, longueurs`` and the ending flags of each text that isn't null or empty: one pass over the texts, written.

    ``dans_balise, entier, entree, entree_numerotee, cle_ligne, empreinte`` say what the end shows; a
    blank text is ``entier``. What is kept of a text is numbers, flags, the key of a short last line and a digest.
    """
    base = df.select(F.col(key), F.col(source).alias("source"), F.col(text).alias("_t")).where(F.col("_t").isNotNull() & (F.col("_t") != ""))
    return cut(_endings(base.withColumn("longueurs", _measures(F.col("_t"))), key), "textes")


def _lengths(seen: DataFrame, key: str) -> DataFrame:
    """``key, source, mesure (index), longueur`` of an inspected table."""
    return seen.select(key, "source", F.posexplode("longueurs").alias("_i", "longueur"))


def limits(seen: DataFrame, key: str) -> DataFrame:
    """``source, mesure, limite, textes, attendus`` of an inspected table: lengths at which a source's texts pile up, short ones included.

    The histogram is pre-aggregated on the map side; its rows are bounded by sources, measures and
    lengths.
    """
    names = F.array(*[F.lit(m) for m in MEASURES])
    histogram = _lengths(seen, key).groupBy("source", "_i", "longueur").agg(F.count(F.lit(1)).alias("textes")).withColumn("mesure", F.get(names, F.col("_i")))
    near = Window.partitionBy("source", "mesure").orderBy("longueur").rangeBetween(-_AROUND, _AROUND)
    neighbours = F.least(F.col("longueur") - 1, F.lit(_AROUND)) + _AROUND  # lengths begin at 1
    spiky = histogram.withColumn("attendus", (F.sum("textes").over(near) - F.col("textes")) / neighbours)
    found = spiky.where((F.col("textes") >= LIMIT_LEAST) & (F.col("textes") > LIMIT_TIMES * F.col("attendus") + LIMIT_LEAST))
    # A pile seen by one measure echoes in others; a limit whose texts mostly sit at a stronger one is such an echo.
    found = found.select(F.col("source").alias("_s"), F.col("_i").alias("_m"), "mesure", F.col("longueur").alias("limite"), "textes", "attendus")
    hits = _lengths(seen, key).join(found, (F.col("source") == F.col("_s")) & (F.col("_i") == F.col("_m")) & (F.col("longueur") == F.col("limite")))
    strength = F.struct("textes", F.when(F.col("mesure") == "caracteres", 1).otherwise(0).alias("c"), (-F.col("_m")).alias("o"))
    strongest = hits.withColumn("_k", strength == F.max(strength).over(Window.partitionBy(key)))
    own = strongest.groupBy("source", "mesure", "limite").agg(F.first("textes").alias("textes"), F.first("attendus").alias("attendus"), F.avg(F.col("_k").cast("int")).alias("_part"))
    return own.where(F.col("_part") >= 0.5).select("source", "mesure", "limite", "textes", F.round("attendus", 3).alias("attendus"))


def _line_key(line: Column) -> Column:
    """A line without regard to case and to how its accents are written, wrongly decoded ones included."""
    return F.regexp_replace(F.lower(line), r"\u00e3[\u0080-\u2122]|[a-z]\p{M}+|[^\x00-\x7F]", "?")


def _bare(c: Column) -> Column:
    """Without trailing blanks of any kind; looks at the end only."""
    return F.rtrim(c, F.lit(_TRAILING))


def _endings(d: DataFrame, key: str) -> DataFrame:
    """Flags of the end of text ``_t``."""
    d = d.withColumn("_t", _bare(F.col("_t")))
    mark = F.when(F.col("_t").rlike(r"\[(?:\.\.\.|…)\]\z"), F.regexp_replace("_t", r"\[(?:\.\.\.|…)\]\z", "")).when(F.endswith("_t", F.lit("…")), F.expr("left(_t, length(_t) - 1)")).when(F.col("_t").rlike(rf"(?:\.\.\.|{_BROKEN}|â€¦)\z"), F.regexp_replace("_t", rf"(?:\.\.\.|{_BROKEN}|â€¦)\z", ""))
    d = d.withColumns({"_m": F.when(F.right("_t", F.lit(5)).rlike(_ELLIPSIS), mark)}).withColumn("_x", F.coalesce(_bare(F.col("_m")), F.col("_t")))
    d = d.withColumns({"_fin": F.right("_x", F.lit(_TAIL)), "_ligne": F.trim(F.substring_index("_x", "\n", -1))})
    d = d.withColumns({"_ligne": F.trim(F.element_at(F.split("_ligne", r"<br\s*/?>"), -1)), "_ouvert": F.substring_index("_x", "<", -1)})
    end, line, opened = F.col("_fin"), F.col("_ligne"), F.col("_ouvert")
    in_tag = F.contains("_x", F.lit("<")) & ~F.contains(opened, F.lit(">")) & opened.rlike(r"^(?:[A-Za-z/]|$)")
    open_tag = in_tag | end.rlike(r"(?i)<(?:p|div|li|span|td)>$")
    part_number = end.rlike(r"(?:\bv\d+(?:\.\d+)?|(?<![\w.])10\.\d{1,3}(?:\.\d{1,3})?)\.$")  # version or address with parts missing
    stopped = end.rlike(r"[.!?]['\"»)\]]{0,8}$") | end.rlike(r"(?i)</[a-z0-9]+>$") | end.rlike(r"(?i)<br\s*/?>$")
    stopped = stopped & ~line.rlike(r"^\d+[.)]$")  # a list number without its entry
    entry = line.rlike(r"^[-*•] \S")
    reference = line.rlike(r"^[^\s\d]{2,12} [A-Z]{1,5}-\d+$")
    framed = line.rlike(r"^\[.*\]$|^\(.*\)$")
    closing = F.lower(F.regexp_replace(line, r"[,;:]$", "")).isin(*CLOSINGS)
    announced = F.col("_m").isNotNull() & _line_key(end).rlike("(?:" + "|".join(CONTINUED) + ")$")
    short = F.length(line).between(1, LINE_CHARS)
    blank = F.col("_x") == ""
    return d.select(
        key, "source", "longueurs", blank.alias("vide"), (open_tag & ~blank).alias("dans_balise"), (blank | (stopped & ~part_number) | reference | framed | closing | announced).alias("entier"), entry.alias("entree"), (entry & line.rlike(r"\d$")).alias("entree_numerotee"), F.when(short, _line_key(line)).alias("cle_ligne"), F.xxhash64("_x").alias("empreinte")
    )


def customary(ends: DataFrame) -> DataFrame:
    """``_usuelle``: last lines that end many different texts, but whose own beginnings end few.

    A closing ends texts as a whole; a line that texts were cut in ends them at each of its letters
    alike. A line counts if its different texts are ``LINE_LEAST`` and more than ``LINE_TIMES`` the mean of
    its ``SHORTER`` forms with one to eight characters less. Both sides of the comparison grow with the texts.
    """
    lines = ends.where(F.col("cle_ligne").isNotNull()).select("cle_ligne", "empreinte").distinct().groupBy("cle_ligne").agg(F.count(F.lit(1)).alias("_n"))
    often = lines.where((F.col("_n") >= LINE_LEAST) & (F.length("cle_ligne") > 1))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(SHORTER)), lambda k: F.left(F.col("cle_ligne"), F.length("cle_ligne") - k))
    forms = often.select(F.col("cle_ligne").alias("_usuelle"), F.explode(F.filter(cuts, lambda x: x != "")).alias("cle_ligne"))
    shorter = forms.join(lines, "cle_ligne").groupBy("_usuelle").agg(F.sum("_n").alias("_s"))
    every = often.select(F.col("cle_ligne").alias("_usuelle"), "_n", F.least(F.length("cle_ligne") - 1, F.lit(SHORTER)).alias("_k")).join(shorter, "_usuelle", "left")
    return every.where(F.col("_n") > LINE_TIMES * F.coalesce("_s", F.lit(0)) / F.col("_k")).select("_usuelle")


def at_limit(seen: DataFrame, key: str) -> DataFrame:
    """``key`` (distinct) of the texts whose length, counted in some way, is a hidden limit of their source.

    A byte limit that would split a character leaves the text up to three bytes shorter.
    """
    index = F.create_map(*[F.lit(x) for k, m in enumerate(MEASURES) for x in (m, k)])
    known = limits(seen, key).select(F.col("source").alias("_s"), F.element_at(index, F.col("mesure")).alias("_m"), "limite", F.when(F.startswith("mesure", F.lit("utf8")), 3).otherwise(0).alias("_moins"))
    hit = _lengths(seen, key).join(known, (F.col("source") == F.col("_s")) & (F.col("_i") == F.col("_m")))
    return hit.where(F.col("longueur").between(F.col("limite") - F.col("_moins"), F.col("limite"))).select(key).distinct()


def _judged(seen: DataFrame, key: str) -> DataFrame:
    """The inspected rows with ``coupe``."""
    known = cut(customary(seen), "usuelles")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    suspects = at_limit(seen, key).select(F.col(key).alias("_cle"))
    joined = seen.join(known, F.col("cle_ligne") == F.col("_usuelle"), "left").join(suspects, F.col(key) == F.col("_cle"), "left")
    entry = F.col("entree") & (F.col("_cle").isNull() | F.col("entree_numerotee"))
    return joined.select(key, "source", "vide", (F.col("dans_balise") | ~(F.col("entier") | entry | F.col("_usuelle").isNotNull())).alias("coupe"))


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key``: documents whose text stops within a word, sentence or tag.

    Lengths first: texts as long as a hidden limit of their source are suspects, of which a last list
    entry must also be complete. Then endings: a text that isn't finished by a stop, tag, closing,
    reference or entry was cut. Null, empty and blank texts aren't cut. A cut mark (``...``) counts only
    where the text before it is unfinished. Repeated texts are judged alike, each row for itself; null
    sources have no limits.
    """
    return _judged(inspected(df, key, text, source), key).where("coupe").select(key)


def rates(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``source, textes, coupes, taux``: how often each source truncates (over texts that aren't blank)."""
    by = _judged(inspected(df, key, text, source), key).where(~F.col("vide")).groupBy("source").agg(F.count(F.lit(1)).alias("textes"), F.count_if("coupe").alias("coupes"))
    return by.withColumn("taux", F.round(F.col("coupes") / F.col("textes"), 6))
