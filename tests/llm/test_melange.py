"""Mixing: shares, caps, order."""

import duckdb
import pytest
from pyspark.sql import functions as F

from guichet.llm.melange import distinct_texts, end_of_service, feasible_budget, finish_times, mix, shares, wanted_budget

SIZE = lambda text: F.length(text).cast("long")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"texte numero {i:05d} " + "x" * (i % 50), "gros") for i in range(900)] + [(1000 + i, f"petit {i:03d}", "petit") for i in range(40)] + [(2000, None, "gros"), (2001, "", "petit"), (2002, "seul", None), (2003, "petit 001", "gros"), (2004, "autre", "sans cible")]
    return spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, source string, jetons int, fin string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("gros", 0.75, 1), ("petit", 0.25, 4), ("vide", 0.0, 3)], "source string, poids double, repetitions_max int")


def test_shares_and_caps(docs, targets):
    texts = distinct_texts(docs, SIZE).cache()
    assert texts.count() == 941  # the text of 2003 counts with that of 1001
    mixed = mix(texts, targets).cache()
    parts = {r.source: r for r in shares(mixed, targets).collect()}
    assert abs(parts["gros"].part - 0.75) < 0.03 and abs(parts["petit"].part - 0.25) < 0.03 and parts["vide"].part == 0
    assert parts["petit"].repetition_max == 4 and parts["gros"].repetition_max == 1
    assert mixed.groupBy("doc_id", "repetition").count().where("count > 1").count() == 0
    rows = mixed.orderBy("ordre_jetons").collect()
    total = 0
    for r in rows:
        total += r.jetons
        assert r.ordre_jetons == total
    assert [(r.fin, r.doc_id, r.repetition) for r in rows] == sorted((r.fin, r.doc_id, r.repetition) for r in rows)
    for cut in (len(rows) // 3, len(rows) // 2):  # every prefix keeps the shares
        got = sum(r.jetons for r in rows[:cut] if r.source == "petit") / sum(r.jetons for r in rows[:cut])
        assert abs(got - 0.25) < 0.05


def test_budget_and_determinism(docs, targets):
    texts = distinct_texts(docs, SIZE)
    a = mix(texts, targets, budget=500)
    total = a.agg(F.sum("jetons")).first()[0]
    assert 440 < total <= 500
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, mix(texts.repartition(7), targets, budget=500).collect()))


def test_empty(docs, targets):
    assert mix(distinct_texts(docs.limit(0), SIZE), targets).count() == 0
    assert shares(mix(distinct_texts(docs.limit(0), SIZE), targets), targets).count() == 3


def test_target_source_without_texts(spark, docs, targets):
    more = targets.union(spark.createDataFrame([("absent", 0.25, 2)], targets.schema))
    texts = distinct_texts(docs, SIZE).cache()
    assert feasible_budget(texts, more).first()["budget"] == feasible_budget(texts, targets).first()["budget"] > 0
    parts = {r.source: r for r in shares(mix(texts, more), more).collect()}
    assert parts["absent"].part == 0 and abs(parts["gros"].part - 0.75) < 0.03 and abs(parts["petit"].part - 0.25) < 0.03


def test_source_of_copies_only(spark, targets):
    rows = [(i, f"texte {i:04d}", "gros") for i in range(200)] + [(1000 + i, f"texte {i:04d}", "petit") for i in range(20)]
    texts = distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, source string"), SIZE)
    assert mix(texts, targets).count() == 200


def test_scarce_source_falls_short(docs, targets):
    texts = distinct_texts(docs, SIZE).cache()
    budget = wanted_budget(texts, targets).first()["budget"]
    assert budget == texts.where("source IN ('gros', 'petit')").agg(F.sum("jetons")).first()[0]
    parts = {r.source: r for r in shares(mix(texts, targets, budget), targets).collect()}
    assert budget - 100 < sum(r.jetons for r in parts.values()) <= budget
    assert parts["petit"].textes == 40 and parts["petit"].usages == 160 and parts["petit"].part < 0.25


def test_order_and_shares_against_sql(spark, docs, targets):
    """The whole mix by plain windows over the table of token counts."""
    texts = distinct_texts(docs, SIZE).cache()
    placed = texts.withColumn("o", F.xxhash64(F.lit(42), "doc_id"))
    c = duckdb.connect()
    for name, df in (("textes", placed), ("cibles", targets)):
        c.register(name, df.toPandas())
    order = """WITH a AS (SELECT t.*, poids, greatest(repetitions_max, 1) AS r, sum(jetons) OVER (PARTITION BY source ORDER BY o, doc_id) AS cumul, sum(jetons) OVER (PARTITION BY source) AS total FROM textes t JOIN cibles USING (source) WHERE poids > 0),
     u AS (SELECT source, doc_id, jetons, unnest(generate_series(1, r)) AS repetition, poids, cumul, total FROM a), f AS (SELECT *, ((repetition - 1) * total + cumul) / poids AS fin FROM u)
     SELECT * FROM (SELECT sum(jetons) OVER (ORDER BY fin, doc_id, repetition) AS ordre_jetons, source, doc_id, repetition FROM f) WHERE ordre_jetons <= {b} ORDER BY 1"""
    for budget in (0, 17, 500, 9_000, 25_000, 10**9):
        mixed = mix(texts, targets, budget, partitions=5)
        assert [(r.ordre_jetons, r.source, r.doc_id, r.repetition) for r in mixed.orderBy("ordre_jetons").collect()] == [(int(a), b, c_, d) for a, b, c_, d in c.execute(order.format(b=budget)).fetchall()]
        parts = c.execute(f"SELECT source, count(m.doc_id), coalesce(max(repetition), 0) FROM cibles LEFT JOIN ({order.format(b=budget)}) m USING (source) GROUP BY 1").fetchall()
        assert sorted((r.source, r.usages, r.repetition_max) for r in shares(mixed, targets).collect()) == sorted(parts)


def test_unequal_sources_make_no_spare_uses(spark, targets):
    """A source of many texts beside a small one of equal weight: what lies beyond the budget is never made, and partitions are even."""
    texts = spark.range(20_200).select(F.when(F.col("id") < 20_000, "gros").otherwise("petit").alias("source"), F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("jetons")).cache()
    goal = spark.createDataFrame([("gros", 0.5, 1000), ("petit", 0.5, 1)], targets.schema)
    budget = feasible_budget(texts, goal).first()["budget"]
    assert budget == 4000
    uses = finish_times(texts, goal, until=end_of_service(texts, goal, budget)).cache()
    assert 400 <= uses.count() <= 410 and mix(texts, goal).count() == 400
    sizes = [r["count"] for r in uses.repartitionByRange(4, "fin", "doc_id", "repetition").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / 4
