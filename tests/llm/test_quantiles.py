"""Percentiles against numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from guichet.llm.quantiles import frequencies, merge, newest, percentiles

RANKS = [0.0, 0.1, 0.5, 0.9, 1.0]


def table(spark, rows):
    return frequencies(spark.createDataFrame(rows, "g string, h string, v long, valeur string, n int"), ["g", "h"], F.col("v"))


def rows(n=3000):
    rnd = random.Random(1)
    return [(rnd.choice(["hot", "hot", "hot", "b", "", None]), rnd.choice(["x", "y"]), rnd.choice([None, 5, 5, rnd.randrange(-50, 10**12)]), "z", 1) for _ in range(n)]


def want(data):
    out = {}
    for k, name in ((0, "g"), (1, "h")):
        by = {}
        for r in data:
            if r[2] is not None:
                by.setdefault(r[k] or None, []).append(r[2])
        for g, v in by.items():
            for q in RANKS:
                out[name, g, q] = (len(v), float(np.quantile(np.array(v, float), q)))
    return out


def check(found, data):
    got = {(r.dimension, r.groupe, r.rang): (r.n, r.valeur) for r in found.collect()}
    expect = want(data)
    assert got.keys() == expect.keys()
    for k, (n, v) in expect.items():
        assert got[k][0] == n and abs(got[k][1] - v) <= 1e-9 * max(1, abs(v))


def test_exact(spark):
    data = rows()
    check(percentiles(table(spark, data), RANKS, partitions=7), data)
    check(percentiles(table(spark, data), RANKS, partitions=1), data)


def test_merging_changes_nothing(spark):
    data = rows(600)
    check(percentiles(merge(*(table(spark, data[i::3]) for i in range(3))), RANKS), data)


def test_ties_single_and_empty(spark):
    data = [("a", "b", 7, None, None)] * 10
    check(percentiles(table(spark, data), RANKS, partitions=5), data)
    assert percentiles(table(spark, []), RANKS).count() == 0
    assert percentiles(table(spark, [("a", "b", None, "", 1)]), RANKS).count() == 0


def test_blank_groups_of_any_space(spark):
    blank = ["", " ", "\u00a0", " \u202f", "\u2003\u3000", None]
    names = ["\t", "\u00a0a", "a ", "\u200b"]
    data = [(g, "x", i, "", 1) for i, g in enumerate(blank + names)]
    check(percentiles(table(spark, data), RANKS), [(None if r[0] in blank else r[0], *r[1:]) for r in data])


def test_newest(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 2, 6), (2, None, 3), (2, 0, None)], "id long, k int, v int")
    assert sorted((r.id, r.v) for r in newest(df, "id", ["k"], ["v"]).collect()) == [(1, 6), (2, None)]
