"""Damaged records."""

import csv
import io
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from guichet.sources.enregistrements import FIELDS, bulk, judged, load_records, parse_block, split_records, strict


def line(**values):
    row = {"id": "1", "date_ouverture": "05-01-2026 16:24", "priorite": "3"} | values
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="").writerow([row.get(f, "") for f in FIELDS])
    return out.getvalue()


GOOD = line()
LINES = {
    GOOD: None, line(titre='a "b"; c\nd'): None, GOOD + "\r\n": None, '"' + GOOD: "quoting", GOOD.replace("3", 'x"y"', 1): "quoting", GOOD + "\nx": "quoting", GOOD + ";": "column_count",
    "Total : 3": "column_count", "": "column_count", line(id=""): "id", line(id="1 802 805 "): None, line(id="12A"): "id", line(id="-3"): "id", line(date_ouverture=" "): "date_ouverture",
    line(date_ouverture="31-04-2025 10:00"): "date_ouverture", line(date_ouverture="30/03/2025 02:30"): "date_ouverture", line(priorite=" TRÈS HAUTE "): None, line(priorite="7"): "priorite", line(priorite="2.0"): "priorite",
    line(priorite=" "): None, line(id="", date_ouverture="", priorite="x"): "id", line(titre="é" * 200_000): None,
}


def tables(spark, lines):
    raw = spark.createDataFrame([], "rec_id long, import_id long, " + ", ".join(f"{f} string" for f in FIELDS))
    return raw, spark.createDataFrame([(i, 1, x, "m") for i, x in enumerate(lines)], "rec_id long, import_id long, ligne string, motif string")


def test_reasons(spark):
    raw, lines = tables(spark, [*LINES, None])
    got = {r.rec_id: r.motif for r in judged(raw, lines).collect()}
    assert [got[i] for i in range(len(LINES))] == list(LINES.values()) and got[len(LINES)] == "column_count"


def test_valid_rows_come_typed(spark):
    raw, lines = tables(spark, [GOOD, line(id="1 802", priorite="Haute"), "x"])
    raw = spark.createDataFrame([(9, 1, *["7" if f == "id" else "2026-01-05" if f == "date_ouverture" else None for f in FIELDS])], raw.schema)
    valid, rejected = load_records(raw, lines)
    assert sorted((r.rec_id, r.id, r.priorite) for r in valid.collect()) == [(0, 1, 3), (1, 1802, 4), (9, 7, None)]
    assert [(r.rec_id, r.motif) for r in rejected.collect()] == [(2, "column_count")]


def test_empty_tables(spark):
    raw, lines = tables(spark, [])
    assert judged(raw, lines).count() == 0


def test_bisection_equals_strict():
    rnd = random.Random(3)
    pool = list(LINES)
    for _ in range(30):
        block = [rnd.choice(pool) for _ in range(rnd.randrange(1, 60))]
        pieces = parse_block(block, len(FIELDS))
        assert [a for a, *_ in pieces] + [len(block)] == [0] + [b for _, b, *_ in pieces]
        for a, b, table, reason in pieces:
            want = [strict(x, len(FIELDS)) for x in block[a:b]]
            assert all(r == reason for r, _ in want)
            if table is not None:
                assert [list(r.values()) for r in table.to_pylist()] == [f for _, f in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab";\n\r é', max_size=6), min_size=3, max_size=3), min_size=1, max_size=5))
def test_round_trip(rows):
    lines = []
    for r in rows:
        lines.append(";".join('"' + v.replace('"', '""') + '"' for v in r))
    table = bulk(lines, 3)
    assert table is not None and [list(r.values()) for r in table.to_pylist()] == rows


def test_split_keeps_every_record(spark):
    _, lines = tables(spark, [GOOD] * 2500 + ["x"] * 3)
    got = split_records(lines).groupBy("motif").count().collect()
    assert {r.motif: r["count"] for r in got} == {None: 2500, "column_count": 3}
