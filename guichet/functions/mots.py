"""Words of French texts: cleaning, splitting, stop words, stems, Jaro-Winkler."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Common French words left out of text mining, by kind.
FRENCH = (
    "le la les un une des du de au aux "
    "a à dans sur pour avec sans entre vers par en chez contre sous devant derrière après avant pendant depuis dès jusqu "
    "je tu il elle nous vous ils elles on "
    "ce cette ces celui celle ceux celles se me te lui leur y moi toi soi qui que quoi dont où lequel laquelle lesquels lesquelles "
    "et ou mais donc car ni si comme lorsque quand puisque parce pourtant cependant or tandis "
    "est sont ai ont était été eu fait faire être avoir peut doit va vont sera seront avait avaient serait soit faut "
    "ne pas plus très bien aussi encore même tout tous toute toutes autre autres trop peu beaucoup déjà alors ainsi ici là jamais toujours souvent parfois maintenant hier demain fois "
    "l d n s c qu j m t "
    "ça cela ceci oui non via"
).split()
# Words of service-desk mails and forms that say nothing.
SERVICE_DESK = (
    "bonjour bonsoir cordialement cdlt salutations merci svp veuillez madame monsieur cher chère "
    "objet ref référence ci-joint ci-dessous ci-dessus pj sujet info information "
    "reçu enregistré noté transmis transféré pris compte "
    "ticket incident demande numéro dossier urgent priorité date problème question aide besoin solution réponse "
    "système service utilisateur poste logiciel résolu clos resolu assigné"
).split()
# Phrases of forms and signatures removed before words are split.
PHRASES = (
    "suite contact avec", "l'incident ou la demande", "les actions suivantes ont été effectuées", "pièce jointe liée lors de la création",
    "assigné au groupe", "assigné au technicien", "changement de statut", "nouveau ticket créé", "ticket résolu", "ticket clos", "en attente de",
    "validation demandée à", "suivi ajouté par", "tâche ajoutée par", "solution ajoutée par", "mise à jour du ticket", "ce ticket a été créé automatiquement",
    "merci de ne pas répondre à ce message", "satisfaction demandée le", "planifié le", "problème résolu", "clôture automatique", "solution approuvée", "résolu par", "fermé automatiquement",
    "intervenant équipe support", "intervenant équipe réseau", "service desk", "support technique", "direction des systèmes d'information", "département des systèmes d'information",
    "une solution définitive a été mise en oeuvre pour répondre à votre attente", "une solution définitive a été mise en œuvre pour répondre à votre attente",
    "lister les actions", "application ou matériel", "est désormais résolu", "les actions suivantes ont été menées", "envoyé depuis", "ce message et ses pièces jointes", "n'imprimez ce mail que si nécessaire",
)
HTML = r"(?i)<[^>]*>|&amp;|&lt;|&gt;|&quot;|&apos;|&nbsp;|&#\d+;|&#x[0-9a-fA-F]+;"
TOKEN = r"[\p{L}][\p{L}\p{N}]*"
BYTES = (2, 30)  # a word's length in UTF-8 bytes


def cleaned(text: Column, phrases: tuple[str, ...] = ()) -> Column:
    """Lower case without tags, entities and the given phrases."""
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), HTML, " "))
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(" "))
    return out


def tokens(text: Column, stop: tuple[str, ...] | list[str] = (*FRENCH, *SERVICE_DESK), phrases: tuple[str, ...] = ()) -> Column:
    """Words of 2 to 30 bytes that aren't stop words, in order, repeats kept. Null gives an empty array."""
    words = F.regexp_extract_all(cleaned(text, phrases), F.lit(TOKEN), F.lit(0))
    good = lambda w: (F.octet_length(w) >= BYTES[0]) & (F.octet_length(w) <= BYTES[1])
    return F.filter(words, lambda w: good(w) & ~w.isin(*stop) if stop else good(w))


def bigrams(words: Column) -> Column:
    """Neighbours joined by ``_``."""
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit("_"), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))


# The published Snowball algorithm for French.

_VOWELS = "aeiouyâàëéêèïîôûù"


def _regions(w: str) -> tuple[int, int, int]:
    def after(start: int) -> int:
        for i in range(start, len(w) - 1):
            if w[i] in _VOWELS and w[i + 1] not in _VOWELS:
                return i + 2
        return len(w)

    if w[:3] in ("par", "col", "tap") or (len(w) > 1 and w[0] in _VOWELS and w[1] in _VOWELS):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _VOWELS), len(w))
    r1 = after(0)
    return min(rv, len(w)), r1, after(r1)


_STEP1 = (
    (("ances", "iqUes", "ismes", "ables", "istes", "ance", "iqUe", "isme", "able", "iste", "eux"), "supprime"),
    (("atrices", "ateurs", "ations", "atrice", "ateur", "ation"), "ic"),
    (("logies", "logie"), "log"),
    (("usions", "utions", "usion", "ution"), "u"),
    (("ences", "ence"), "ent"),
    (("issements", "issement"), "iss"),
    (("ements", "ement"), "ement"),
    (("ités", "ité"), "ite"),
    (("ives", "ive", "ifs", "if"), "if"),
    (("eaux",), "eau"), (("aux",), "al"), (("euses", "euse"), "eux"),
    (("amment",), "ant"), (("emment",), "ent2"), (("ments", "ment"), "ment"),
)
_STEP1_ORDER = sorted(((s, kind) for suffixes, kind in _STEP1 for s in suffixes), key=lambda x: -len(x[0]))
_I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """French stem of a lower-case word."""
    w = list(word)
    for i, c in enumerate(w):
        before, behind = (w[i - 1] if i else ""), (word[i + 1] if i + 1 < len(word) else "")
        if c in "ui" and before and before.lower() in _VOWELS and behind in _VOWELS and behind:
            w[i] = c.upper()
        elif c == "y" and ((before and before.lower() in _VOWELS) or (behind and behind in _VOWELS)):
            w[i] = "Y"
        elif c == "u" and before == "q":
            w[i] = "U"
    s = "".join(w)
    rv, r1, r2 = _regions(s)
    start, done, special = s, False, False

    def inside(suffix: str, region: int) -> bool:
        return len(s) - len(suffix) >= region

    for suffix, kind in _STEP1_ORDER:
        if not s.endswith(suffix):
            continue
        base = s[: -len(suffix)]
        if kind == "supprime" and inside(suffix, r2):
            s, done = base, True
        elif kind == "ic" and inside(suffix, r2):
            s, done = base, True
            if s.endswith("ic"):
                s = s[:-2] if len(s) - 2 >= r2 else s[:-2] + "iqU"
        elif kind in ("log", "u", "ent") and inside(suffix, r2):
            s, done = base + kind, True
        elif kind == "iss" and inside(suffix, r1) and base and base[-1] not in _VOWELS:
            s, done = base, True
        elif kind == "ement" and inside(suffix, rv):
            s, done = base, True
            if s.endswith("iv") and len(s) - 2 >= r2:
                s = s[:-2]
                if s.endswith("at") and len(s) - 2 >= r2:
                    s = s[:-2]
            elif s.endswith("eus"):
                s = s[:-3] if len(s) - 3 >= r2 else (s[:-3] + "eux" if len(s) - 3 >= r1 else s)
            elif s.endswith(("abl", "iqU")) and len(s) - 3 >= r2:
                s = s[:-3]
            elif s.endswith(("ièr", "Ièr")) and len(s) - 3 >= rv:
                s = s[:-3] + "i"
        elif kind == "ite" and inside(suffix, r2):
            s, done = base, True
            if s.endswith("abil"):
                s = s[:-4] if len(s) - 4 >= r2 else s[:-4] + "abl"
            elif s.endswith("ic"):
                s = s[:-2] if len(s) - 2 >= r2 else s[:-2] + "iqU"
            elif s.endswith("iv") and len(s) - 2 >= r2:
                s = s[:-2]
        elif kind == "if" and inside(suffix, r2):
            s, done = base, True
            if s.endswith("at") and len(s) - 2 >= r2:
                s = s[:-2]
                if s.endswith("ic"):
                    s = s[:-2] if len(s) - 2 >= r2 else s[:-2] + "iqU"
        elif kind == "eau":
            s, done = base + "eau", True
        elif kind == "al" and inside(suffix, r1):
            s, done = base + "al", True
        elif kind == "eux":
            if inside(suffix, r2):
                s, done = base, True
            elif inside(suffix, r1):
                s, done = base + "eux", True
        elif kind == "ant" and inside(suffix, rv):
            s, special = base + "ant", True
        elif kind == "ent2" and inside(suffix, rv):
            s, special = base + "ent", True
        elif kind == "ment" and len(base) - 1 >= rv and base and base[-1] in _VOWELS:
            s, special = base, True
        break
    if not done or special:
        verb = False
        for suffix in sorted(_I_VERBS, key=len, reverse=True):
            if s.endswith(suffix) and len(s) - len(suffix) >= rv:
                before = s[: -len(suffix)]
                if len(before) - 1 >= rv and before[-1] not in _VOWELS:
                    s, verb = before, True
                break
        if not verb:
            for suffix in sorted([*_VERBS, *_A_VERBS, "ions"], key=len, reverse=True):
                if s.endswith(suffix) and len(s) - len(suffix) >= rv:
                    before = s[: -len(suffix)]
                    if suffix == "ions":
                        if len(before) >= r2:
                            s, verb = before, True
                    else:
                        s, verb = before, True
                        if suffix in _A_VERBS and s.endswith("e") and len(s) - 1 >= rv:
                            s = s[:-1]
                    break
        if not verb and s == start:
            if s.endswith("s") and len(s) > 1 and s[-2] not in "aiouès":
                s = s[:-1]
            if s.endswith("ion") and len(s) - 3 >= r2 and len(s) - 4 >= rv and s[-4] in "st":
                s = s[:-3]
            else:
                for suffix in ("ière", "Ière", "ier", "Ier"):
                    if s.endswith(suffix) and len(s) - len(suffix) >= rv:
                        s = s[: -len(suffix)] + "i"
                        break
                else:
                    if s.endswith("e") and len(s) - 1 >= rv:
                        s = s[:-1]
    if s != start:
        if s.endswith("Y"):
            s = s[:-1] + "i"
        elif s.endswith("ç"):
            s = s[:-1] + "c"
    if s.endswith(("enn", "onn", "ett", "ell", "eill")):
        s = s[:-1]
    for i in range(len(s) - 1, -1, -1):
        if s[i] not in _VOWELS:
            continue
        if s[i] in "éè" and i < len(s) - 1:
            s = s[:i] + "e" + s[i + 1 :]
        break
    return s.lower()


def stems(words: Column) -> Column:
    """Stems of an array of words; a stem under two bytes is dropped."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: [x for x in map(stem, a) if len(x.encode()) >= 2] if a is not None else [])

    return run(words)


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Similarity 0..1 with a bonus for up to four equal first letters (from Jaro 0.7 on)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    common = 0
    while common < min(4, len(a), len(b)) and a[common] == b[common]:
        common += 1
    return jaro + common * scale * (1 - jaro) if jaro > 0.7 else jaro


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=1)))), np.uint32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out, lengths


def jaro_winkler_many(a: list[str], b: list[str], least: float = 0.0, scale: float = 0.1) -> np.ndarray:
    """Similarities of pairs; pairs that can't exceed ``least`` come as 0.

    An upper bound from the letters in common (positions disregarded) leaves most pairs out; the
    others are matched for all pairs of a block at once, letter by letter.
    """
    names, at = np.unique(np.array([*a, *b], object), return_inverse=True)
    codes, lengths = _codes(list(names))
    bins = np.zeros((len(names), 64), np.uint16)
    for k in range(codes.shape[1]):
        rows = np.nonzero(lengths > k)[0]
        np.add.at(bins, (rows, codes[rows, k] & 63), 1)
    x, y = at[: len(a)], at[len(a) :]
    la, lb = lengths[x], lengths[y]
    out = np.zeros(len(a))
    for begin in range(0, len(a), 2048):
        p, q = x[begin : begin + 2048], y[begin : begin + 2048]
        na, nb = np.maximum(lengths[p], 1), np.maximum(lengths[q], 1)
        head = np.cumprod((codes[p, :4] == codes[q, :4]) & (np.arange(min(4, codes.shape[1])) < np.minimum(lengths[p], lengths[q])[:, None]), 1).sum(1)
        most = np.minimum(bins[p], bins[q]).sum(1)
        bound = (most / na + most / nb + (most > 0)) / 3
        todo = np.nonzero((bound + head * scale * (1 - bound) > least) & (most > 0))[0]
        if not len(todo):
            continue
        out[begin + todo] = _jaro_winkler_block(codes[p[todo]], codes[q[todo]], lengths[p[todo]], lengths[q[todo]], head[todo], scale)
    same = (x == y) & (la >= 0) & (lb >= 0)
    out[same] = 1.0
    return out


def _jaro_winkler_block(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, head: np.ndarray, scale: float) -> np.ndarray:
    width_a, width_b = int(la.max()), int(lb.max())
    a, b = a[:, :width_a], b[:, :width_b]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    j = np.arange(width_b)
    free = j < lb[:, None]
    hit_a = np.zeros(a.shape, bool)
    hit_b = np.zeros(b.shape, bool)
    rows = np.arange(len(a))
    for i in range(width_a):
        can = (b == a[:, i : i + 1]) & free & (j >= i - reach) & (j <= i + reach) & (i < la)[:, None]
        first = can.argmax(1)
        got = can[rows, first]
        hit_a[:, i] = got
        free[rows[got], first[got]] = False
        hit_b[rows[got], first[got]] = True
    m = hit_a.sum(1)
    order_a, order_b = np.argsort(~hit_a, 1, kind="stable"), np.argsort(~hit_b, 1, kind="stable")
    k = np.arange(min(width_a, width_b))
    different = (np.take_along_axis(a, order_a, 1)[:, : len(k)] != np.take_along_axis(b, order_b, 1)[:, : len(k)]) & (k < m[:, None])
    moved = different.sum(1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la.clip(1) + m / lb.clip(1) + (m - moved) / some) / 3, 0.0)
    return np.where(jaro > 0.7, jaro + head * scale * (1 - jaro), jaro)


def jaro_winkler_column(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two text columns, nulls as empty; below ``least`` it may come as 0."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_many(list(x.fillna("")), list(y.fillna("")), least))

    return run(a, b)
