"""Full-text search over several fields: an index of postings written once, queries that read their terms only.

Grammar: words (all wanted), ``OR``, ``NOT``, ``"a phrase"``, ``begin*``; NOT binds strongest, OR weakest. Case
and accents don't matter. Ranking is BM25 (k1 = 1.2, b = 0.75) over all fields of a document together.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.session import shared_folder

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6  # of a term in more than half of the documents
BUCKETS, SALTS = 64, 8
WORD = r"[\p{L}\p{N}]+"
SNIPPET, BEFORE = 64, 16  # runs (words and what is between them) of a snippet, and before its first hit


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with marks and the letters they fold to, by the character database."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if bare != c and len(bare) == 1:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case without marks, composed or not."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}", ""), *_folding())


def fold(s: str) -> str:
    """The same of a text at hand."""
    return "".join(x for x in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(x))


@dataclass
class Query:
    """A parsed query: ``leaves`` (word, prefix or phrase by their words), and ``rule``, nested lists of and / or / not over their numbers."""

    leaves: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    rule: object = None


def parse(text: str) -> Query:
    """A query of the grammar above; nothing to look for is an error, as are operators without a side."""
    parts = re.findall(r'"([^"]*)"|([^\W_]+\*?)', text)
    q, words = Query(), []
    for phrase, word in parts:
        if not phrase and word in ("OR", "NOT", "AND"):
            words.append(word)
            continue
        bare = tuple(re.findall(r"[^\W_]+", fold(phrase or word.rstrip("*"))))
        if not bare:
            continue
        leaf = ("phrase" if len(bare) > 1 else "prefixe" if word.endswith("*") else "mot", bare)
        if leaf not in q.leaves:
            q.leaves.append(leaf)
        words.append(q.leaves.index(leaf))
    either: list[list] = [[]]
    negate = False
    for w in words:
        if w == "OR":
            either.append([])
        elif w == "NOT":
            negate = True
        elif w != "AND":
            either[-1].append(("not", w) if negate else w)
            negate = False
    if negate or not all(any(not isinstance(x, tuple) for x in group) for group in either):
        raise ValueError(f"nothing to look for in {text!r}")
    q.rule = either
    return q


def build_index(df: DataFrame, key: str, fields: list[str], folder: str | None = None) -> str:
    """Writes ``postings`` (seau, terme, doc, champ, place) and ``documents`` (doc, longueur); the folder.

    One pass over whole texts; a term's occurrences are spread over ``SALTS`` files of its bucket, sorted by
    term, so a query opens its buckets and skips the row groups of other terms. Null fields are empty.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    words = [F.regexp_extract_all(folded(F.coalesce(F.col(c), F.lit(""))), F.lit(WORD), F.lit(0)) for c in fields]
    docs = df.select(F.col(key).cast("long").alias("doc"), F.array(*words).alias("_f"))
    docs.select("doc", F.aggregate("_f", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("longueur")).write.parquet(f"{folder}/documents")
    rows = docs.select("doc", F.posexplode("_f").alias("champ", "_w")).select("doc", "champ", F.posexplode("_w").alias("place", "terme"))
    bucket = F.pmod(F.xxhash64("terme"), F.lit(BUCKETS)).cast("int")
    placed = rows.withColumns({"seau": bucket, "_s": F.pmod(F.xxhash64("doc"), F.lit(SALTS))}).repartition("seau", "_s").sortWithinPartitions("seau", "terme", "doc").drop("_s")
    placed.write.partitionBy("seau").parquet(f"{folder}/postings")
    return folder


def _hits(spark: SparkSession, folder: str, q: Query) -> DataFrame:
    """``doc, feuille, n``: occurrences of each leaf."""
    postings = spark.read.schema("terme string, doc long, champ int, place int, seau int").parquet(f"{folder}/postings")
    out = []
    for k, (kind, words) in enumerate(q.leaves):
        if kind == "prefixe":
            end = words[0] + chr(sys.maxunicode)
            found = postings.where((F.col("terme") >= words[0]) & (F.col("terme") < end) & F.startswith("terme", F.lit(words[0])))
        else:
            buckets = [r[0] for r in spark.createDataFrame([(w,) for w in set(words)], "terme string").select(F.pmod(F.xxhash64("terme"), F.lit(BUCKETS)).cast("int")).collect()]  # one row per word asked
            found = postings.where(F.col("seau").isin(buckets) & F.col("terme").isin(*set(words)))
        if kind == "phrase":
            places = F.array_compact(F.array(*[F.when(F.col("terme") == w, F.lit(i)) for i, w in enumerate(words)]))
            starts = found.select("doc", "champ", "place", F.explode(places).alias("_i")).groupBy("doc", "champ", (F.col("place") - F.col("_i")).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
            found = starts.where(F.col("_c") == len(words))
        out.append(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).select("doc", F.lit(k).alias("feuille"), "n"))
    return reduce(DataFrame.unionByName, out)


def search(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """``doc, score`` of the documents that match a query."""
    q = parse(text)
    documents = spark.read.schema("doc long, longueur long").parquet(f"{folder}/documents")
    size = documents.agg(F.count(F.lit(1)).alias("n"), F.avg("longueur").alias("m")).first()
    counts = [F.coalesce(F.max(F.when(F.col("feuille") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(len(q.leaves))]
    by = _hits(spark, folder, q).groupBy("doc").agg(*counts)
    frequency = by.agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"d{k}") for k in range(len(q.leaves))]).first()
    true = lambda x: (F.col(f"n{x[1]}") == 0) if isinstance(x, tuple) else (F.col(f"n{x}") > 0)
    good = reduce(Column.__or__, [reduce(Column.__and__, [true(x) for x in group]) for group in q.rule])
    length = 1 - B + B * F.col("longueur") / F.lit(float(size["m"] or 1.0))
    score = F.lit(0.0)
    for k in range(len(q.leaves)):
        idf = F.greatest(F.ln((F.lit(float(size["n"])) - frequency[f"d{k}"] + 0.5) / (frequency[f"d{k}"] + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * F.col(f"n{k}") * (K1 + 1) / (F.col(f"n{k}") + K1 * length)
    return by.where(good).join(documents, "doc").select("doc", F.round(score + 1e-9, 6).alias("score"))


def _runs(text: Column, q: Query) -> tuple[Column, Column]:
    """(runs of words and what is between them, whether each is asked for)."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+"), F.lit(0))
    exact = sorted({w for kind, words in q.leaves if kind != "prefixe" for w in words}) or [""]
    begins = [words[0] for kind, words in q.leaves if kind == "prefixe"]
    asked = lambda r: reduce(Column.__or__, [folded(r).isin(*exact), *[F.startswith(folded(r), F.lit(b)) for b in begins]])
    return runs, F.transform(runs, asked)


def highlighted(text: Column, query: str) -> Column:
    """The text with the words asked for marked."""
    runs, hit = _runs(text, parse(query))
    return F.array_join(F.zip_with(runs, hit, lambda r, h: F.when(h, F.concat(F.lit("<mark>"), r, F.lit("</mark>"))).otherwise(r)), "")


def snippet(text: Column, query: str) -> Column:
    """About 32 words around the first word asked for (else the beginning), marked; ``...`` where the text goes on."""
    runs, hit = _runs(text, parse(query))
    first = F.greatest(F.array_position(hit, True).cast("int") - BEFORE, F.lit(1))
    marked = F.zip_with(runs, hit, lambda r, h: F.when(h, F.concat(F.lit("<mark>"), r, F.lit("</mark>"))).otherwise(r))
    body = F.array_join(F.slice(marked, first, F.lit(SNIPPET)), "")
    return F.concat(F.when(first > 1, "...").otherwise(""), body, F.when(first + SNIPPET <= F.size(runs), "...").otherwise(""))
