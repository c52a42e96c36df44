"""The registered queries on the smallest data: columns fixed by contract, and SQL."""

import glob
import os

import duckdb
import pytest

from guichet.llm import catalogue, jetons

COLUMNS = {"p1_found": "id champ genre valeur", "p2_found": "id_a id_b", "p3_found": "id groupe_id", "p8_ids": "doc_id ids", "p10_found": "doc_id"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_runs(spark, data, name):
    if name[:2] in ("p8", "p9") and not os.path.isdir(jetons.FOLDER):
        pytest.skip("no vocabulary")
    df = catalogue.QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, " ".join(df.columns)).split() and df.count() >= 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, data, name):
    c = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    df = catalogue.QUERIES[name](spark, data)
    answer = c.execute(catalogue.ORACLES[name])
    names = [x[0] for x in answer.description]
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(names) and got == sorted(answer.fetchall(), key=repr)


def test_mix_has_the_size_of_its_texts(spark, data):
    if not os.path.isdir(jetons.FOLDER):
        pytest.skip("no vocabulary")
    rows = catalogue.p9_parts(spark, data).collect()
    whole = catalogue.load(spark, data, "documents").where("text <> ''").join(catalogue.load(spark, data, "cibles_melange"), "source").select("source").distinct().count()
    assert sum(r.jetons > 0 for r in rows) == whole < len(rows)
