"""Several values packed in one field: split by the field's delimiter skeleton.

A field is cut into runs: ordinary text, blanks, line ends, quotes, delimiters. The symbols of
the runs are its skeleton. Few skeletons exist beside the many fields, so the splitting rule
(which runs form which value) is worked out once per distinct skeleton in Python; the fields
themselves are taken apart by position in JVM expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.session import cut

#: Runs, first match wins: HTML break, line ends, tab, quote, bracket or delimiter, anything else up to one of these.
#: Only single character classes repeat, so the longest field needs no deep match.
_BLANKS = r"[ \x0B\f\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF]"
RUNS = r"(?i:<br\s*/?>)|[\r\n]+|\t+|[\",;|/\[\]]|[^\t\r\n\",;|/\[\]<]+|(?s:.)"
#: Symbols of ordinary runs: without blanks at the ends, blank before, blank behind, both.
ORDINARY = ("X", "L", "R", "B")
RULE = "array<struct<debut:int,longueur:int,entre:boolean>>"
#: A rule table of at most so many rows (some 200 bytes each) is broadcast; beyond it the join shuffles in salted parts.
BROADCAST_ROWS, SALTS = 50_000, 64


def _symbol(run):
    first = F.substring(run, 1, 1)
    before, behind = run.rlike(rf"^{_BLANKS}"), run.rlike(rf"{_BLANKS}$")
    return (
        F.when(F.lower(run).rlike(r"^<br\s*/?>$"), "h")
        .when(first.isin("\r", "\n"), "n")
        .when(first == "\t", "t")
        .when(run.rlike(r'^[",;|/\[\]]$'), run)
        .when(before & run.rlike(rf"^{_BLANKS}+$"), "s")
        .when(before & behind, "B")
        .when(before, "L")
        .when(behind, "R")
        .otherwise("X")
    )


def split_rule(skeleton: str) -> list[dict]:
    """Values of a skeleton as (first run, number of runs, quoted), in written order.

    Delimiters: ``;`` ``,`` ``|``, line ends, tabs, ``<br>``, and ``/`` between blanks. Blanks around
    values don't count. A quote opens only where a value begins and closes at the next single
    quote before a delimiter or the end; a doubled quote stays inside. A quote that never closes
    is ordinary text. One pair of brackets around the whole field is dropped. Empty values are left out.
    """
    s, lo, hi = skeleton, 0, len(skeleton)
    core = s.strip("snt")
    if len(core) >= 2 and core[0] == "[" and core[-1] == "]":
        lo = s.index("[") + 1
        hi = s.rindex("]")
    out: list[dict] = []

    def ends(i: int) -> bool:
        """A delimiter, or the end, follows after blanks."""
        while i < hi and s[i] == "s":
            i += 1
        return i >= hi or s[i] in ";,|nth" or (s[i] == "/" and slash(i))

    def slash(i: int) -> bool:
        """A slash between blanks, line ends or the field's ends."""
        return (i == lo or s[i - 1] in "snthRB") and (i + 1 >= hi or s[i + 1] in "snthLB")

    def add(a: int, b: int) -> None:
        while a < b and s[a] == "s":
            a += 1
        while b > a and s[b - 1] == "s":
            b -= 1
        if b - a >= 2 and s[a] == "[" and s[b - 1] == "]":
            return add(a + 1, b - 1)
        quoted = b - a >= 2 and s[a] == '"' and s[b - 1] == '"'
        if quoted:
            a, b = a + 1, b - 1
        if b > a and any(c not in "snt" for c in s[a:b]):
            out.append({"debut": a + 1, "longueur": b - a, "entre": quoted})

    i = begin = lo
    fresh = True
    while i < hi:
        c = s[i]
        if fresh and c == "s":
            i += 1
            continue
        if fresh and c == '"':
            j = i + 1
            while j < hi:
                if s[j] == '"':
                    if j + 1 < hi and s[j + 1] == '"':
                        j += 2
                        continue
                    if ends(j + 1):
                        break
                j += 1
            if j < hi:
                i, fresh = j + 1, False
                continue
        fresh = False
        if c in ";,|nth" or (c == "/" and slash(i)):
            add(begin, i)
            begin, fresh = i + 1, True
        i += 1
    add(begin, hi)
    return out


def skeletons(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_runs`` and ``_squelette`` of a column."""
    runs = F.regexp_extract_all(F.col(column), F.lit(RUNS), F.lit(0))
    return df.withColumn("_runs", runs).withColumn("_squelette", F.array_join(F.transform("_runs", _symbol), ""))


def rule_table(keyed: DataFrame) -> DataFrame:
    """``_squelette`` (distinct) with ``_regle``; one row of work per skeleton, spread over executors."""

    @F.pandas_udf(RULE)
    def build(s: pd.Series) -> pd.Series:
        return s.map(split_rule)

    return keyed.select("_squelette").distinct().withColumn("_regle", build("_squelette"))


def split_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per value: ``keys, champ, rang, valeur`` (``rang`` from 1 in written order).

    Null, empty and blank fields give no row; repeated records give their rows again. Only ``keys``
    and ``columns`` are read, so other columns can't clash. One-run skeletons (by far the most
    frequent) are answered in place, so no join key is hot.
    """
    fields = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("champ"), F.col(c).alias("_texte")) for c in columns])).alias("_v")).select(*keys, "_v.champ", "_v._texte").where(F.col("_texte").isNotNull() & (F.col("_texte") != ""))
    keyed = skeletons(fields, "_texte").drop("_texte")
    alone = F.col("_squelette").isin(*ORDINARY)
    single, packed = keyed.where(alone), keyed.where(~alone)
    rules = cut(rule_table(packed), "regles")
    meets = ["_squelette"]
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    else:  # a frequent skeleton is no hot key
        meets.append("_sel")
        packed = packed.withColumn("_sel", F.pmod(F.xxhash64(*keys, "champ"), F.lit(SALTS)).cast("int"))
        rules = rules.withColumn("_sel", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = packed.join(rules, meets).select(*keys, "champ", "_runs", F.posexplode("_regle").alias("_i", "_r"))
    text = F.array_join(F.slice("_runs", F.col("_r.debut"), F.col("_r.longueur")), "")
    value = F.when(F.col("_r.entre"), F.regexp_replace(text, '""', '"')).otherwise(text)
    edge = _BLANKS[:-1] + r"\s]"
    bare = lambda c: F.regexp_replace(c, rf"^{edge}+|{edge}+$", "")
    several = found.select(*keys, "champ", (F.col("_i") + 1).cast("long").alias("rang"), bare(value).alias("valeur")).where(F.col("valeur") != "")
    one = single.select(*keys, "champ", F.lit(1).cast("long").alias("rang"), bare(F.get("_runs", F.lit(0))).alias("valeur"))
    return one.unionByName(several)
