"""Mixing sources to target weights by weighted fair queueing.

Each source's texts are put in a keyed random order; a text's virtual finish time is the source's
cumulative tokens up to and including it, divided by the source's weight. Served by finish time,
every source advances in proportion to its weight at every moment. Both orders are range sorts over
all partitions with offsets (``operators.ordre``), so no source, however large, meets in one task.
The virtual time at which the budget is spent follows from the totals of the sources: repetitions
and texts beyond it are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guichet.operators.ordre import running


def distinct_texts(documents: DataFrame, tokens) -> DataFrame:
    """``source, doc_id, jetons``: one row per different text, at its smallest doc_id and that row's source.

    A text repeated under other ids or in other sources is one text, so its uses are counted together.
    Null and empty texts (no token) and null sources are no candidates. Texts are shuffled as digests.
    """
    base = documents.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("source").isNotNull())
    counted = base.select("doc_id", "source", F.sha2("text", 256).alias("_h"), tokens(F.col("text")).alias("jetons"))
    first = counted.groupBy("_h").agg(F.min(F.struct("doc_id", "source", "jetons")).alias("_m"))
    return first.select("_m.source", "_m.doc_id", "_m.jetons").where(F.col("jetons") > 0)


def _goals(targets: DataFrame) -> DataFrame:
    """``source, poids, repetitions`` of the sources that take part; at least one use of each text."""
    return targets.where(F.col("poids") > 0).select("source", "poids", F.greatest(F.coalesce("repetitions_max", F.lit(1)), F.lit(1)).alias("repetitions"))


def end_of_service(texts: DataFrame, targets: DataFrame, budget: int) -> float | None:
    """The virtual time up to which uses can lie within the budget; None if all uses may.

    At time T a source has been served min(weight * T, all it has) tokens, but for a text not yet
    finished: the time is the least at which the budget and one longest text per source are served.
    Only one row per target source, a configuration table, reaches the driver.
    """
    totals = texts.groupBy("source").agg(F.sum("jetons").alias("j"), F.max("jetons").alias("plus_long"))
    rows = _goals(targets).join(totals, "source").collect()
    wanted = budget + sum(r["plus_long"] for r in rows)
    served, time = 0.0, 0.0
    running_, ends = sum(r["poids"] for r in rows), sorted((r["j"] * r["repetitions"] / r["poids"], r["poids"]) for r in rows)
    for end, weight in ends:
        step = (end - time) * running_
        if served + step >= wanted and running_ > 0:
            return (time + (wanted - served) / running_) * (1 + 1e-9)
        served, time, running_ = served + step, end, running_ - weight
    return None


def finish_times(texts: DataFrame, targets: DataFrame, seed: int = 42, until: float | None = None, partitions: int | None = None) -> DataFrame:
    """``source, doc_id, jetons, repetition, fin``: the virtual finish time of every allowed use that ends by ``until``.

    ``targets``: ``source, poids, repetitions_max`` (one row per source, a configuration table). A source's
    second pass begins when its first has ended. Sources without a target or with weight 0 take no part.
    """
    goal = _goals(targets).withColumnRenamed("source", "_s")
    placed = texts.join(goal, F.col("source") == F.col("_s")).drop("_s").withColumn("_o", F.xxhash64(F.lit(seed), "doc_id"))
    summed = running(placed, ["source"], ["_o", "doc_id"], "jetons", "_cumul", "_total", partitions)
    # The number of uses that can end in time is known before any is made.
    times = F.col("repetitions").cast("long")
    if until is not None:
        times = F.least(times, F.floor((F.lit(until) * F.col("poids") - F.col("_cumul")) / F.col("_total")) + 1)
    uses = summed.withColumn("_n", times).where(F.col("_n") >= 1).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    fin = ((F.col("repetition") - 1) * F.col("_total") + F.col("_cumul")) / F.col("poids")
    return uses.select("source", "doc_id", "jetons", "repetition", fin.alias("fin"))


def feasible_budget(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row ``budget``: the most tokens at which no source with texts runs out; sources without texts have no say."""
    capacity = texts.groupBy("source").agg(F.sum("jetons").alias("_j"))
    goal = _goals(targets).join(capacity, "source")
    share = F.col("poids") / F.sum("poids").over(Window.partitionBy(F.lit(1)))  # one row per source
    goal = goal.withColumn("_part", share)
    return goal.agg(F.floor(F.min(F.col("_j") * F.col("repetitions") / F.col("_part")) + 1e-6).cast("long").alias("budget"))


def wanted_budget(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row ``budget``: the tokens of all texts of sources with a target, the size of the mix whatever the scarcest source."""
    return texts.join(_goals(targets).select("source"), "source").agg(F.coalesce(F.sum("jetons"), F.lit(0)).alias("budget"))


def mix(texts: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``ordre_jetons, source, doc_id, repetition, jetons, fin``: uses in order of finish time until the budget is spent.

    ``ordre_jetons`` is the cumulative number of tokens, a gapless position in the mix. The last use is
    the last that fits whole. With no ``budget`` the largest one at which no source runs out is taken
    (a source without texts is as good as spent from the start); with a larger one, a spent source's
    share goes to the others in proportion. Equal finish times are ordered by doc_id, repetition. Empty
    inputs give an empty mix. ``texts`` is read several times: pass a written table.
    """
    if budget is None:
        budget = feasible_budget(texts, targets).first()["budget"] or 0
    uses = finish_times(texts, targets, seed, end_of_service(texts, targets, budget), partitions)
    placed = running(uses, [], ["fin", "doc_id", "repetition"], "jetons", "ordre_jetons", partitions=partitions)
    return placed.where(F.col("ordre_jetons") <= F.lit(budget)).select("ordre_jetons", "source", "doc_id", "repetition", "jetons", "fin")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, poids, part, jetons, textes, usages, repetition_max`` of a mix; sources that give nothing have part 0."""
    got = mixed.groupBy("source").agg(
        F.sum("jetons").alias("jetons"), F.countDistinct("doc_id").alias("textes"), F.count(F.lit(1)).alias("usages"), F.max("repetition").alias("repetition_max")
    )
    every = targets.select("source", "poids").join(got, "source", "left").na.fill(0, ["jetons", "textes", "usages", "repetition_max"])
    total = F.sum("jetons").over(Window.partitionBy(F.lit(1)))  # one row per source
    return every.withColumn("part", F.coalesce(F.col("jetons") / F.nullif(total, F.lit(0)), F.lit(0.0)))
