"""Personal data in free text: find it, list it, replace it by typed placeholders.

Numbers and dates are found by form and confirmed by their own checks (phone plan, the key of
social-security numbers, the month of cards, the calendar); addresses and names by their grammar in
the text around them. Replacements are linked: a keyed Feistel network permutes the index of a
validated value among all valid values of its format (a phone number becomes another phone number
written alike, a social-security number another one with a right key, Corsican ones included, a
date another real day), so equal values get equal pseudonyms in every document, different numbers
different ones, and the text stays readable. What has no number format (e-mails, addresses, names)
gets a keyed token of 80 bits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import secrets
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt, prod

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting of the session that holds the secret of the pseudonyms.
KEY_SETTING = "spark.guichet.pseudonym.key"
KINDS = ("courriel", "telephone", "identite", "adresse", "nom")
#: Given names are a closed vocabulary of this many entries at most (all languages' together are fewer).
GIVEN_MOST = 200_000
#: Masked like ``KINDS``, but not listed by ``find``: dates of birth, told by the words before them.
BIRTH = "naissance"
# Forms of address before a name.
TITLES = ("M.", "MM.", "Mr", "Mr.", "Mme", "Mmes", "Mlle", "Me", "Dr", "Dr.", "Pr", "Pr.", "Monsieur", "Madame", "Mademoiselle", "Maître", "Docteur", "Professeur")
# Kinds of streets, with usual abbreviations.
STREETS = (
    "rue", "avenue", "av.", "av", "boulevard", "bd", "bd.", "boul.", "allée", "allee", "allées", "impasse", "imp.", "place", "pl.", "chemin", "ch.", "che.", "quai", "route", "rte",
    "cours", "square", "sq.", "passage", "sentier", "ruelle", "faubourg", "fbg", "esplanade", "promenade", "venelle", "montée", "traverse", "sente", "villa", "cité",
)
# Words after which a single letter or a name is that of a place or thing.
PLACES = frozenset("bâtiment batiment bat. bât. salle bloc hall aile zone niveau étage porte site annexe serveur machine imprimante poste baie rue place projet module logiciel version option plan".split())

# Words that open a sentence before a name.
OPENERS = frozenset("voir vu selon avec pour par chez contacter appeler rappeler joindre prévenir demander transmettre merci bonjour bonsoir cher chère signé contact copie suite attn de à et ou le la les un une".split())

_SP = r"[ \u00A0\u202F]"
_UP = "A-ZÀ-ÖØ-ÞŒ"
EMAIL = re.compile(r"(?<![\w.+%])(?<!\w-)[A-Za-zÀ-ÿ0-9][\w.+%-]*(?:@| ?(?:\((?:at|a|arobase)\)|\[(?:at|a|arobase)\]) ?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.IGNORECASE)
PHONE = re.compile(
    rf"(?<![\w+.-])(?<!\d[ ,])(?:(?:\+|00)33(?:{_SP}|[.-])?(?:\(0\){_SP}?)?[1-9](?:(?P<s>{_SP}|[.-]|)\d\d(?:(?P=s)\d\d){{3}}|\d\d(?P<t>{_SP}|[.-])\d{{3}}(?P=t)\d{{3}})|0[1-9](?P<u>{_SP}|[.-]|)\d\d(?:(?P=u)\d\d){{3}})(?![\w]|[.-]?\d)"
)
NIR = re.compile(rf"(?<![\w.-])(?<!\d[ ,])[1-478](?P<s>{_SP}|[.-]|)\d\d(?P=s)\d\d(?P=s)(?:\d\d|2[AB])(?P=s)\d{{3}}(?P=s)\d{{3}}(?:(?P=s)|{_SP})\d\d(?![\w]|[.-]?\d)")
CARD = re.compile(r"(?<![\w.-])(?<!\d[ ,])\d{4} ?\d{2}[A-Z] ?\d{5}(?![\w]|[.-]?\d)")
# French months, as dates of birth write them.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
BORN = re.compile(
    rf"(?i)(?<!\w)(?:née?(?:\(e\))? le|date de naissance(?: ?:| est le)?|ddn ?:?)(?:{_SP})*(?P<d>\d{{1,2}}(?P<s>[/.-])\d{{1,2}}(?P=s)(?:\d{{4}}|\d{{2}})|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:er)? (?:{'|'.join(MONTHS)}) \d{{4}})(?![\w/-]|\.\d)"
)
_WORD = rf"[{_UP}][\w’'-]*"
_STREET = "|".join(sorted((re.escape(s) for s in STREETS), key=len, reverse=True))
_PART = r"(?i:de la|de l['’]|des|du|de|d['’]|la|le|les|l['’]|aux|au)(?: |(?<=['’]))"
_NAME = rf"(?!(?:M|Mr|Mme|Mlle|Me|Dr|Pr|Monsieur|Madame)\b){_WORD}"
ADDRESS = re.compile(
    rf"(?<![\w.,/-])\d{{1,4}}(?: ?(?i:bis|ter|quater)\b| ?[A-F]\b)?,? (?i:{_STREET}) (?:{_PART})*{_NAME}(?:[ -](?:{_PART})*{_NAME})*"
    rf"(?:(?:,? ?(?:- |– )?|,?\s*(?:<br\s*/?>|\n|\r\n)\s*)\d{{5}} {_WORD}(?:[ -]{_NAME})*| à {_WORD}(?:-{_WORD})*)?"
)
_RUN = re.compile(rf"(?<![\w@.’-])[{_UP}][\w’'-]*\.?(?:{_SP}[{_UP}][\w’'-]*\.?)+")
_TOKEN = re.compile(rf"[{_UP}][\w’'-]*\.?")
_LOWER = re.compile(r"(?<![\w@.’'/-])([a-zà-ÿœ]+(?:-[a-zà-ÿœ]+)?) ([a-zà-ÿœ][a-zà-ÿœ'-]{3,})(?![\w@])")
_INITIAL = re.compile(rf"[{_UP}](?:-[{_UP}])?\.$")


#: Months a social-security number may hold: real ones, and those of unknown or foreign births.
NIR_MONTHS = tuple(f"{m:02d}" for m in (*range(1, 13), *range(20, 43), *range(50, 100)))


def nir_key(number: str) -> int:
    """The key of 13 characters: 97 - (number mod 97); Corsican departments 2A and 2B count as 19 and 18."""
    return 97 - int(number.replace("2A", "19").replace("2B", "18")) % 97


def nir_valid(digits: str) -> bool:
    """15 characters with a possible month and a right key."""
    return digits[3:5] in NIR_MONTHS and nir_key(digits[:13]) == int(digits[13:])


def card_valid(bare: str) -> bool:
    """12 characters of an identity card: year, month, department, letter, number; the month must be one."""
    return "01" <= bare[2:4] <= "12"


def day_of(text: str) -> tuple[date, str] | None:
    """(day, form) of a written date; None if the calendar has no such day. Two-digit years are of 19xx."""
    if m := re.fullmatch(r"(\d{1,2})([/.-])(\d{1,2})[/.-](\d{4}|\d{2})", text):
        parts, form = (int(m[4]) + 1900 * (len(m[4]) == 2), int(m[3]), int(m[1])), "court" if len(m[4]) == 2 else "jour"
    elif m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", text):
        parts, form = (int(m[1]), int(m[2]), int(m[3])), "annee"
    elif m := re.fullmatch(r"(\d{1,2})(?:er)? (\w+) (\d{4})", text):
        parts, form = (int(m[3]), MONTHS.index(m[2].lower()) + 1, int(m[1])), "mots"
    else:
        return None
    try:
        return date(*parts), form
    except ValueError:
        return None


def _bare(s: str) -> str:
    return re.sub(r"[^0-9A-Z+]", "", s)


def _names(text: str, given: frozenset[str], taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    for run in _RUN.finditer(text):
        tokens = [(m.start() + run.start(), m.end() + run.start(), m[0]) for m in _TOKEN.finditer(run[0])]
        i = 0
        while i < len(tokens):
            t = tokens[i][2]
            word = lambda k: tokens[k][2].rstrip(".") if k < len(tokens) else ""
            ended = lambda k: k >= len(tokens) or (tokens[k][2].endswith(".") and tokens[k][2] not in TITLES and not _INITIAL.match(tokens[k][2]))
            is_given = lambda k: k < len(tokens) and (word(k) in given or word(k).title() in given and word(k).isupper())
            family = lambda k: k < len(tokens) and len(word(k)) > 1 and tokens[k][2] not in TITLES and not _INITIAL.match(tokens[k][2])
            span = None
            if t in TITLES:
                if i + 1 < len(tokens) and _INITIAL.match(tokens[i + 1][2]) and tokens[i + 1][2] not in TITLES and family(i + 2):
                    span = (i + 1, i + 2)
                elif is_given(i + 1) and not ended(i + 1) and family(i + 2):
                    span = (i + 1, i + 2)
                elif family(i + 1) and not ended(i + 1) and is_given(i + 2):
                    span = (i + 1, i + 2)
                elif family(i + 1):
                    span = (i + 1, i + 1)
            elif _INITIAL.match(t):
                previous = re.findall(r"[\w.]+", text[: tokens[i][0]][-20:])
                if family(i + 1) and not (previous and previous[-1].lower() in PLACES) and not re.match(r"\s+(?:de|du|des|d['’]|suite|et|en)\b", text[tokens[i + 1][1] : tokens[i + 1][1] + 7]):
                    span = (i, i + 1)
            elif not ended(i) and is_given(i + 1) and family(i) and not is_given(i):
                given_first = not ended(i + 1) and family(i + 2) and not is_given(i + 2)
                caps = word(i).isupper() and len(word(i)) > 2
                opener = word(i).lower() in OPENERS or word(i).lower() in PLACES
                sentence = given_first and not opener and re.match(r"\s+(?:de|du|des|d['’]|suite|à|et|en)\b", text[tokens[i + 2][1] : tokens[i + 2][1] + 8])
                if given_first and not sentence and not (caps and not opener and not word(i + 2).isupper()):
                    span = (i + 1, i + 2)
                elif not opener:
                    span = (i, i + 1)
            elif is_given(i) and not ended(i) and family(i + 1):
                span = (i, i + 1)
            if span:
                a, b = tokens[span[0]][0], tokens[span[1]][1]
                if text[b - 1] == ".":
                    b -= 1
                previous = re.findall(r"[\w.]+", text[:a][-20:])
                place = bool(previous) and t not in TITLES and previous[-1].lower() in PLACES
                if not place and not any(a < y and x < b for x, y, _ in taken):
                    yield a, b, "nom"
                i = span[1] + 1
            else:
                i += 1


def _lower_names(text: str, given: frozenset[str], taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Names typed in small letters: a given name and the word after it, unless a place's or thing's name."""
    at = 0
    while m := _LOWER.search(text, at):
        at = m.end(1)
        if m[1].title() not in given:
            continue
        previous = re.findall(r"[\w.]+", text[: m.start()][-20:])
        if (previous and previous[-1].lower() in PLACES) or any(m.start() < y and x < m.end() for x, y, _ in taken):
            continue
        at = m.end()
        yield m.start(), m.end(), "nom"


def spans(text: str, given: frozenset[str], births: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in a text, in order, never overlapping.

    Kinds found first keep their place: e-mails, identity numbers, phones, addresses, names. With
    ``births`` also the dates of birth; other dates (of entries, of events) are no personal data.
    """
    found: list[tuple[int, int, str]] = []

    def add(pattern: re.Pattern, kind: str, good=lambda s: True) -> None:
        for m in pattern.finditer(text):
            if good(m[0]) and not any(m.start() < y and x < m.end() for x, y, _ in found):
                found.append((m.start(), m.end(), kind))

    if "@" in text or "(a" in text or "[a" in text:
        add(EMAIL, "courriel")
    add(NIR, "identite", lambda s: nir_valid(_bare(s)))
    add(CARD, "identite", lambda s: card_valid(_bare(s)))
    if births:
        found += [(m.start("d"), m.end("d"), BIRTH) for m in BORN.finditer(text) if day_of(m["d"])]
    add(PHONE, "telephone")
    add(ADDRESS, "adresse")
    found += list(_names(text, given, found))
    found += list(_lower_names(text, given, found))
    return sorted(found)


def given_names(df: DataFrame, columns: list[str]) -> frozenset[str]:
    """Given names: first words of two-word person names that occur with at least two family names.

    Learned from all rows of the person columns; only the vocabulary of given names reaches the
    driver, and a vocabulary beyond ``GIVEN_MOST`` is an error, not a cut.
    """
    name = F.split(F.trim("n"), " ")
    pairs = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("n")).where(F.col("n").isNotNull()).where(F.size(name) == 2).select(name[0].alias("p"), name[1].alias("f")).where(F.col("p").rlike(rf"^[{_UP}]") & F.col("f").rlike(rf"^[{_UP}]")).distinct()
    several = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("p")
    rows = several.limit(GIVEN_MOST + 1).collect()
    if len(rows) > GIVEN_MOST:
        raise ValueError(f"more than {GIVEN_MOST} given names: these columns don't hold persons")
    return frozenset(r.p for r in rows)


def find(df: DataFrame, key: str, columns: list[str], given: frozenset[str], secret: bytes) -> DataFrame:
    """``id, champ, genre, valeur, pseudonyme``: each different piece in each field of a record, and what it becomes.

    Null and empty texts give nothing; rows of one id give each piece once. Only ``key`` and
    ``columns`` are read. One narrow pass over whole texts, then a distinct of what was found.
    """
    known = df.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: set[tuple] = set()
            for c, name in enumerate(columns, 1):
                for i, text in zip(ids, batch.column(c).to_pylist()):
                    if text:
                        out.update((i, name, kind, text[a:b], pseudonym(kind, text[a:b], secret)) for a, b, kind in spans(text, known.value))
            rows = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.string()) for r in rows[1:])], ["id", "champ", "genre", "valeur", "pseudonyme"])

    return df.select(F.col(key).cast("long").alias("id"), *columns).mapInArrow(run, "id long, champ string, genre string, valeur string, pseudonyme string").distinct()


_OWN_SECRETS: dict[str, bytes] = {}


def secret_of(spark: SparkSession) -> bytes:
    """The secret of ``KEY_SETTING``. Unset, a random one for this application: pseudonyms are then linked
    within it and nowhere else, and no one can recompute them."""
    given = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None)
    if given:
        return hashlib.blake2b(given.encode(), digest_size=32).digest()
    return _OWN_SECRETS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


# Pseudonyms


def _round(key: bytes, tag: bytes, half: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(tag + half.to_bytes(16, "big"), key=key, digest_size=16).digest(), "big") % size


def permute(value: int, size: int, key: bytes, tweak: str = "", back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a ten-round Feistel network over two halves, walked until it falls inside."""
    a = max(1, isqrt(size - 1) + 1)
    b = -(-size // a)
    rounds = range(10)
    while True:
        left, right = divmod(value, b)
        for r in reversed(rounds) if back else rounds:
            tag = f"{tweak}/{r}/".encode()
            if r % 2 == 0:
                f = _round(key, tag, right, a)
                left = (left - f) % a if back else (left + f) % a
            else:
                f = _round(key, tag, left, b)
                right = (right - f) % b if back else (right + f) % b
        value = left * b + right
        if value < size:
            return value


class Format:
    """Texts made of fields one after the other, and their index among all such texts.

    A field is the number of its digits, or the tuple of its allowed texts (all of one length).
    """

    def __init__(self, name: str, *fields: int | tuple[str, ...]):
        self.name = name
        self.fields = [(f, 10**f) if isinstance(f, int) else (len(f[0]), len(f)) for f in fields]
        self.texts = [None if isinstance(f, int) else f for f in fields]
        self.places = [None if isinstance(f, int) else {t: i for i, t in enumerate(f)} for f in fields]
        self.size = prod(n for _, n in self.fields)

    def index(self, text: str) -> int:
        out, at = 0, 0
        for (width, n), place in zip(self.fields, self.places):
            part = text[at : at + width]
            out, at = out * n + (place[part] if place else int(part)), at + width
        return out

    def text(self, index: int) -> str:
        out = []
        for (width, n), texts in zip(reversed(self.fields), reversed(self.texts)):
            index, part = divmod(index, n)
            out.append(texts[part] if texts else f"{part:0{width}d}")
        return "".join(reversed(out))

    def permuted(self, text: str, key: bytes) -> str:
        return self.text(permute(self.index(text), self.size, key, self.name))


_LETTERS = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SEX = ("1", "2", "3", "4", "7", "8")
# Numbers of mainland departments stay such, and Corsican ones Corsican: each format is permuted in itself.
NIR_FORMAT = Format("nir", _SEX, 2, NIR_MONTHS, 2, 3, 3)
NIR_CORSICA = Format("nir-corse", _SEX, 2, NIR_MONTHS, ("2A", "2B"), 3, 3)
CARD_FORMAT = Format("carte", 2, tuple(f"{m:02d}" for m in range(1, 13)), 2, _LETTERS, 5)
PHONE_FORMATS = {str(d): Format(f"tel{d}", 8) for d in range(1, 10)}  # the first digit tells the kind of line and stays
_CENTURIES = (date(1900, 1, 1), date(2100, 1, 1))  # dates of birth outside are permuted within their own year
_SHORT_DATES = (date(1900, 1, 1), date(2000, 1, 1))


def _refill(form: str, new: str, skip: int = 0) -> str:
    """``form`` with its digits and capitals from number ``skip`` on replaced in order."""
    it, out, n = iter(new), [], 0
    for c in form:
        if c.isdigit() or c in _LETTERS:
            n += 1
            out.append(next(it) if n > skip else c)
        else:
            out.append(c)
    return "".join(out)


def _date_pseudonym(value: str, key: bytes) -> str:
    day, form = day_of(value)
    first, end = _SHORT_DATES if form == "court" else _CENTURIES
    if not first <= day < end:
        first, end = date(day.year, 1, 1), date(day.year, 12, 31) + timedelta(day.year < 9999)
    new = first + timedelta(permute((day - first).days, (end - first).days, key, f"jour/{first}/{end}"))
    if form == "annee":
        return new.isoformat()
    if form == "mots":
        return f"{new.day}{'er' if new.day == 1 else ''} {MONTHS[new.month - 1]} {new.year}"
    separator = re.search(r"\D", value)[0]
    return separator.join((f"{new.day:02d}", f"{new.month:02d}", f"{new.year:04d}" if form == "jour" else f"{new.year % 100:02d}"))


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str:
    """A linked replacement in the value's own format; e-mails, addresses and names get a keyed token of their folded form."""
    if kind == "telephone":
        digits = re.sub(r"\D", "", value.replace("(0)", ""))[-9:]  # the national number: the same in every notation
        new = PHONE_FORMATS[digits[0]].permuted(digits[1:], key)
        return _refill(value, new, sum(c.isdigit() for c in value) - 8)
    if kind == "identite":
        bare = _bare(value)
        if len(bare) == 15:
            number = (NIR_CORSICA if bare[5:7] in ("2A", "2B") else NIR_FORMAT).permuted(bare[:13], key)
            return _refill(value, number + f"{nir_key(number):02d}")
        return _refill(value, CARD_FORMAT.permuted(bare, key))
    if kind == BIRTH:
        return _date_pseudonym(value, key)
    folded = re.sub(r"\s+", " ", value).casefold()
    return base64.b32encode(hashlib.blake2b(f"{kind}/{folded}".encode(), key=key, digest_size=10).digest()).decode().lower()


def mask_text(text: str | None, given: frozenset[str], key: bytes) -> str | None:
    """The text with each piece as ``[KIND:pseudonym]``; everything else unchanged. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in spans(text, given, births=True):
        out += [text[at:a], f"[{kind.upper()}:{pseudonym(kind, text[a:b], key)}]"]
        at = b
    return "".join([*out, text[at:]])


def mask(df: DataFrame, columns: list[str], given: frozenset[str], key: bytes) -> DataFrame:
    """``df`` with the columns masked in place; all other columns and all rows as they are."""
    known = df.sparkSession.sparkContext.broadcast(given)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: mask_text(t, known.value, key))

    return df.withColumns({c: run(F.col(c)) for c in columns})
