"""Clusters of similar records by Markov clustering (MCL).

A random walk on the similarity graph is squared (expansion), its strong steps are favoured
(inflation) and its smallest entries pruned (of a column of small entries only, all but its
``RECOVER`` largest), until it settles: the rows that keep flow are attractors, the columns that flow to them their cluster. The walk never leaves a connected block,
so the matrix is block-diagonal: blocks up to ``DENSE`` nodes are squared as stacked dense matrices
inside tasks, larger ones as distributed sparse matrices (a join and a sum per step; columns are
pruned before each squaring, so a hub's column is short). Both do the same arithmetic. Clusters are then
contracted to nodes and joined by the links between them: ``bloc`` is what hangs together through
clusters and links. A walk that hasn't settled after ``STEPS`` squarings is reported, never hidden.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guichet.session import cut

DENSE = 512  # nodes of a block that one task squares at once (2 MB a matrix)
INFLATION = 2.0
PRUNE = 1e-4
RECOVER = 100  # largest entries kept of a column whose entries are all below PRUNE
STEPS = 100  # a block that still moves then comes with stable = false
_SETTLED = 1e-6


def blocks(links: DataFrame) -> DataFrame:
    """``noeud, bloc``: connected blocks of the links, ``bloc`` the smallest node, by large and small stars.

    Each round hooks neighbours to smaller nodes and is written to the shared folder. A hub's links are
    minimised before the shuffle; joined with that one minimum they are one key, which the engine's
    skew join splits. Ends when nothing moves.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        kept = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(kept, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(kept.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "etoiles")
        # The stars stand still when their number and contents do.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("noeud"), F.col("v").alias("bloc")).unionByName(edges.select(F.col("v").alias("noeud"), F.col("v").alias("bloc")).distinct())


def _prune(m: np.ndarray, prune: float) -> np.ndarray:
    """Columns without their small entries and of sum 1 again; a column of small entries only keeps its largest."""
    small = m < prune
    if prune > 1 / m.shape[1]:  # else no column can be all small
        first = np.zeros_like(small)
        np.put_along_axis(first, np.argsort(-m.round(12), 1, kind="stable")[:, :RECOVER], True, 1)
        small &= ~(first & small.all(1, keepdims=True))
    m[small] = 0
    return m / np.maximum(m.sum(1, keepdims=True), 1e-300)


def _walk(m: np.ndarray, inflation: float, prune: float) -> tuple[np.ndarray, np.ndarray]:
    """MCL of stacked column-stochastic matrices (blocks, n, n), and which of them have settled."""
    m = _prune(m, prune)
    settled = np.zeros(len(m), bool)
    for _ in range(STEPS):
        last = m
        m = np.power(m @ m, inflation)
        m = _prune(m / np.maximum(m.sum(1, keepdims=True), 1e-300), prune)
        settled = np.abs(m - last).max((1, 2)) < _SETTLED
        if settled.all():
            break
    return m, settled


def _read(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster as a row index, flow) of each node of settled matrices; ties go to the first row."""
    top = m.argmax(1)
    support = (m > 0).argmax(1)  # first attractor of each column
    return np.take_along_axis(support, top, 1), m.sum(2)


def contracted(group: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The first node of what hangs together through clusters (``group``: blocks, n) and links between them (blocks, n, n)."""
    n = group.shape[1]
    label = np.broadcast_to(np.arange(n), group.shape).copy()
    while True:
        least = np.full(group.shape, n)
        np.minimum.at(least, (np.arange(len(group))[:, None], group), label)
        inside = np.take_along_axis(least, group, 1)
        after = np.minimum(inside, np.where(linked, inside[:, None, :], n).min(2))
        if (after == label).all():
            return label
        label = after


def _dense(links: DataFrame, inflation: float, prune: float) -> DataFrame:
    """``bloc, noeud, groupe, flux, lien, stable`` of blocks within ``DENSE``; input ``bloc, a, b, w`` sorted by block."""

    def solve(stack: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> pa.RecordBatch:
        m = np.stack([np.pad(w, ((0, n - len(w)), (0, n - len(w)))) for _, w in stack])
        linked, i = m > 0, np.arange(n)
        m[:, i, i] = 1.0
        strength = m.sum(1) - 1
        m, settled = _walk(m / m.sum(1, keepdims=True), inflation, prune)
        group, flow = _read(m)
        first = contracted(group, linked)
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for k, (nodes, w) in enumerate(stack):
            s = len(w)
            for c, v in zip(columns, (nodes[first[k, :s]], nodes, nodes[group[k, :s]], flow[k, :s], strength[k, :s], np.full(s, settled[k]))):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["bloc", "noeud", "groupe", "flux", "lien", "stable"])

    def matrix(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        m = np.zeros((len(nodes), len(nodes)))
        x, y = at[: len(a)], at[len(a) :]
        m[x, y] = w
        m[y, x] = w
        return nodes, m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        held: list[np.ndarray] | None = None

        def take(one) -> Iterator[pa.RecordBatch]:
            n = max(4, 1 << (len(one[0]) - 1).bit_length())
            waiting.setdefault(n, []).append(one)
            if len(waiting[n]) * n * n >= 1 << 19:
                yield solve(waiting.pop(n), n)

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            begin = 0
            for end in np.nonzero(held[0][1:] != held[0][:-1])[0] + 1:
                yield from take(matrix(*(c[begin:end] for c in held[1:])))
                begin = end
            held = [c[begin:] for c in held]
        if held is not None and len(held[0]):
            yield from take(matrix(*held[1:]))
        for n, stack in waiting.items():
            yield solve(stack, n)

    placed = links.select("bloc", "a", "b", "w").repartition("bloc").sortWithinPartitions("bloc")
    return placed.mapInArrow(run, "bloc long, noeud long, groupe long, flux double, lien double, stable boolean")


def _sparse(links: DataFrame, inflation: float, prune: float) -> DataFrame:
    """The same for any block size: entries (i, j, w) of the matrix, squared by a join on the inner index."""
    both = links.select("bloc", F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(links.select("bloc", F.col("b").alias("i"), F.col("a").alias("j"), "w"))
    nodes = both.groupBy("bloc", F.col("i").alias("noeud")).agg(F.sum("w").alias("lien"))
    m = both.unionByName(nodes.select("bloc", F.col("noeud").alias("i"), F.col("noeud").alias("j"), F.lit(1.0).alias("w")))

    def normal(x: DataFrame) -> DataFrame:
        return x.join(x.groupBy("bloc", "j").agg(F.sum("w").alias("_s")), ["bloc", "j"]).select("bloc", "i", "j", (F.col("w") / F.col("_s")).alias("w"))

    def pruned(x: DataFrame) -> DataFrame:
        # Flow spread evenly over many nodes has small entries only; its largest stay (of equals the first), so no column is lost.
        by = x.groupBy("bloc", "j").agg(F.sum("w").alias("_s"), F.max("w").alias("_m"))
        y = x.join(by, ["bloc", "j"]).withColumns({"w": F.col("w") / F.col("_s"), "_m": F.col("_m") / F.col("_s")})
        y = y.where((F.col("w") >= prune) | (F.col("_m") < prune))
        rank = F.row_number().over(Window.partitionBy("bloc", "j").orderBy(F.desc(F.round(F.ln("w"), 9)), "i"))
        return y.withColumn("_r", rank).where((F.col("w") >= prune) | (F.col("_r") <= RECOVER)).select("bloc", "i", "j", "w")

    m, settled = cut(normal(pruned(m)), "flux"), False
    for _ in range(STEPS):
        right = m.select("bloc", F.col("i").alias("k"), "j", F.col("w").alias("w2"))
        squared = m.withColumnRenamed("j", "k").join(right, ["bloc", "k"]).groupBy("bloc", "i", "j").agg(F.sum(F.col("w") * F.col("w2")).alias("w"))
        after = cut(normal(pruned(squared.withColumn("w", F.pow("w", F.lit(inflation))))), "flux")
        moved = after.join(m.withColumnRenamed("w", "v"), ["bloc", "i", "j"], "full").agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))))).first()[0]
        m = after
        settled = (moved or 0.0) < _SETTLED
        if settled:
            break
    per = m.groupBy("bloc", "j").agg(F.min_by("i", F.struct(-F.col("w"), "i")).alias("_haut"), F.min("i").alias("_premier"))
    group = per.join(per.select("bloc", F.col("j").alias("_haut"), F.col("_premier").alias("groupe")), ["bloc", "_haut"]).select("bloc", F.col("j").alias("noeud"), "groupe")
    flow = m.groupBy("bloc", F.col("i").alias("noeud")).agg(F.sum("w").alias("flux"))
    # Nodes come from the links, not from the walk: none can get lost in it.
    every = nodes.join(group, ["bloc", "noeud"], "left").join(flow, ["bloc", "noeud"], "left").select("noeud", F.coalesce("groupe", "noeud").alias("groupe"), F.coalesce("flux", F.lit(0.0)).alias("flux"), "lien")
    every = cut(every, "noeuds")
    named = lambda side: every.select(F.col("noeud").alias(side), F.col("groupe").alias(f"g{side}"))
    between = links.join(named("a"), "a").join(named("b"), "b").where(F.col("ga") != F.col("gb")).select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
    joined = every.join(blocks(between).withColumnRenamed("noeud", "groupe"), "groupe", "left").withColumn("bloc", F.coalesce("bloc", "groupe"))
    least = joined.groupBy("bloc").agg(F.min("noeud").alias("_premier"))
    return joined.join(least, "bloc").select(F.col("_premier").alias("bloc"), "noeud", "groupe", "flux", "lien", F.lit(settled).alias("stable"))


def markov(links: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, dense: int = DENSE) -> DataFrame:
    """``bloc, noeud, groupe, flux, lien, stable`` of weighted links ``a, b, w`` (0 < w <= 1, each pair once).

    ``groupe`` is the cluster's first attractor, ``flux`` the flow a node keeps in the end (0 unless it
    is an attractor), ``lien`` its summed similarity, ``bloc`` the first node of all that hangs together
    through clusters and links between them, ``stable`` whether its walk has settled. No links, no rows.
    """
    where = cut(blocks(links), "blocs")  # only places the work
    sized = where.groupBy("bloc").count()
    placed = cut(links.join(where.withColumnRenamed("noeud", "a"), "a").join(sized, "bloc").select("bloc", "a", "b", F.col("w").cast("double").alias("w"), "count"), "blocs_liens")
    found = _dense(placed.where(F.col("count") <= dense), inflation, prune)
    large = placed.where(F.col("count") > dense)
    return found if large.isEmpty() else found.unionByName(_sparse(large.drop("count"), inflation, prune))


def clustered(members: DataFrame, links: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, dense: int = DENSE) -> DataFrame:
    """``id, classe, bloc, groupe, flux, lien, stable`` of every record: MCL of the classes, carried to their records.

    ``members``: ``id, classe``; ``links``: ``a, b, communs, total``. A class without links is its own block
    and cluster. Copies share a node, so they never make the matrix larger.
    """
    weighted = links.select("a", "b", (F.col("communs") / F.col("total")).alias("w"))
    found = markov(weighted, inflation, prune, dense).withColumnRenamed("noeud", "classe")
    return members.join(found, "classe", "left").select(
        "id", "classe", F.coalesce("bloc", "classe").alias("bloc"), F.coalesce("groupe", "classe").alias("groupe"), F.coalesce("flux", F.lit(1.0)).alias("flux"), F.coalesce("lien", F.lit(0.0)).alias("lien"),
        F.coalesce("stable", F.lit(True)).alias("stable"),
    )


def linked_groups(records: DataFrame, least: int) -> DataFrame:
    """``id, groupe_id``: the records of each block (Markov clusters merged where links join them) of at least ``least`` records; ``groupe_id`` is its smallest id."""
    sized = records.groupBy("bloc").agg(F.min("id").alias("groupe_id"), F.count_distinct("id").alias("_n")).where(F.col("_n") >= least)
    return records.join(sized, "bloc").select("id", "groupe_id").distinct()


def described(records: DataFrame, typical: int = 3, least: int = 1) -> DataFrame:
    """``groupe_id, taille, typiques, stable`` of each Markov cluster: size, its strongest-flow members' ids joined by commas, whether the walk settled.

    Members are ordered by flow, summed similarity, id; a rank up to ``typical``, which the engine applies
    before the shuffle too, so of a large cluster few rows per task travel.
    """
    k = F.struct((-F.col("flux")).alias("f"), (-F.round("lien", 9)).alias("l"), F.col("id").alias("i"))
    top = records.groupBy("bloc", "groupe").agg(F.min("id").alias("groupe_id"), F.count_distinct("id").alias("taille"), F.bool_and("stable").alias("stable")).where(F.col("taille") >= least)
    w = Window.partitionBy("bloc", "groupe").orderBy(k)
    first = records.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= typical)
    names = first.groupBy("bloc", "groupe").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"].cast("string")), ",").alias("typiques"))
    return top.join(names, ["bloc", "groupe"]).select("groupe_id", "taille", "typiques", "stable")
