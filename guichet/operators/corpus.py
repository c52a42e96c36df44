"""Text mining on long tables (document, term, weight): TF-IDF, keywords, co-occurrence, mind map, full-text ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guichet.session import cut

K1, B = 1.2, 0.75


def counts(df: DataFrame, key: str, words: Column) -> DataFrame:
    """``doc, terme, n``: how often each word stands in each document."""
    return df.select(F.col(key).alias("doc"), F.explode(words).alias("terme")).groupBy("doc", "terme").agg(F.count(F.lit(1)).alias("n"))


def tfidf(tf: DataFrame, documents: int, min_df: int = 2) -> DataFrame:
    """``doc, terme, df, poids``: (1 + ln n) * ln(1 + N / (1 + df)), each document's vector of unit length.

    ``documents`` counts empty ones too. Terms in fewer than ``min_df`` documents are left out before
    the vectors are scaled. The document frequency is pre-aggregated; a hot term spreads over tasks
    in the join (skew-split by the engine), never in a window.
    """
    df = tf.groupBy("terme").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = tf.join(df, "terme").withColumn("_w", (1 + F.ln("n")) * F.ln(1 + F.lit(float(documents)) / (1 + F.col("df"))))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "terme", "df", (F.col("_w") / norm).alias("poids"))


def keywords(weights: DataFrame, top: int) -> DataFrame:
    """``terme, score, df``: the ``top`` terms by summed weight, ties by term."""
    by = weights.groupBy("terme").agg(F.round(F.sum("poids"), 6).alias("score"), F.first("df").alias("df"))
    return by.orderBy(F.desc("score"), "terme").limit(top)


def group_keywords(weights: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``groupe, terme, score, df, rang``; ``groups``: doc, groupe. ``df`` counts the group's documents."""
    by = weights.join(groups, "doc").groupBy("groupe", "terme").agg(F.round(F.sum("poids"), 6).alias("score"), F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("groupe").orderBy(F.desc("score"), "terme"))
    return by.withColumn("rang", rank.cast("long")).where(F.col("rang") <= top)


def cooccurrences(tf: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """``terme_a, terme_b, n``: documents that hold both of two chosen terms; ``terms`` is a short list (a top-k)."""
    chosen = tf.join(F.broadcast(terms.select("terme")), "terme").groupBy("doc").agg(F.array_sort(F.collect_set("terme")).alias("_t"))
    # A document holds at most as many terms as were chosen, so its pairs are bounded.
    left = chosen.select("_t", F.explode("_t").alias("terme_a"))
    pairs = left.select("terme_a", F.explode(F.filter("_t", lambda b: b > F.col("terme_a"))).alias("terme_b"))
    return pairs.groupBy("terme_a", "terme_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def mind_map(tf: DataFrame, word: str, branches: int = 12, leaves: int = 5, depth: int = 3, least: int = 2) -> DataFrame:
    """``chaine, parent, terme, profondeur, n``: terms that share documents with the chain of words before them.

    One join per level with the postings of the chains' documents, written so that no level repeats the one
    before; a level has at most branches * leaves^(depth-1) chains.
    """
    tf = tf.select("doc", "terme")
    chains = tf.where(F.col("terme") == word).select("doc", F.lit(word).alias("chaine"), F.array(F.lit(word)).alias("_mots"))
    out = None
    for level in range(1, depth + 1):
        width = branches if level == 1 else max(3, leaves - (level - 2))
        grown = cut(chains, "chaines").join(tf, "doc").where(~F.array_contains("_mots", F.col("terme")))
        by = grown.groupBy("chaine", "terme").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        rank = F.row_number().over(Window.partitionBy("chaine").orderBy(F.desc("n"), "terme"))
        kept = cut(by.withColumn("_r", rank).where(F.col("_r") <= width).select("chaine", "terme", "n"), "carte")
        nodes = kept.select(F.concat_ws("|", "chaine", "terme").alias("chaine"), F.col("chaine").alias("parent"), "terme", F.lit(level).cast("long").alias("profondeur"), "n")
        out = nodes if out is None else out.unionByName(nodes)
        if level < depth:
            chosen = F.broadcast(kept.select(F.col("chaine").alias("_c"), F.col("terme").alias("_t")))  # bounded, see above
            chains = grown.join(chosen, (F.col("chaine") == F.col("_c")) & (F.col("terme") == F.col("_t"))).select("doc", F.concat_ws("|", "chaine", "terme").alias("chaine"), F.concat("_mots", F.array("terme")).alias("_mots"))
    return out


def bm25(tf: DataFrame, lengths: DataFrame, query: list[str], prefixes: list[str] = (), every: bool = True) -> DataFrame:
    """``doc, score`` of documents that hold all (``every``) or any of the words and word beginnings.

    ``lengths``: doc, longueur of every document. k1 = 1.2, b = 0.75. The postings are filtered by
    the query before anything is joined.
    """
    size = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("longueur").alias("m")).first()
    asked = [(F.col("terme") == q, q) for q in query] + [(F.col("terme").startswith(p), p + "*") for p in prefixes]
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in asked]))
    rows = tf.where(F.size(hit) > 0).select("doc", "n", F.explode(hit).alias("q")).groupBy("doc", "q").agg(F.sum("n").alias("n"))
    df = rows.groupBy("q").agg(F.count(F.lit(1)).alias("df"))  # one row per query word
    scored = rows.join(F.broadcast(df), "q").join(lengths, "doc")
    idf = F.ln(1 + (F.lit(float(size["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("longueur") / F.lit(float(size["m"] or 1.0))))
    by = scored.groupBy("doc").agg(F.round(F.sum(part) + 1e-9, 6).alias("score"), F.count(F.lit(1)).alias("_q"))
    return (by.where(F.col("_q") == len(asked)) if every else by).select("doc", "score")
