"""Packed values."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from guichet.operators.valeurs import split_rule, split_values

CASES = {
    "Solène Guénilot": ["Solène Guénilot"],
    "_DSI > _SUPPORT > _N1": ["_DSI > _SUPPORT > _N1"],
    '"Nélia Crenivel"\r\nNoé Jangrerolle': ["Nélia Crenivel", "Noé Jangrerolle"],
    'Oscar Morgrerin;"Maëlle ""Quoz"" Rosaurolle"': ["Oscar Morgrerin", 'Maëlle "Quoz" Rosaurolle'],
    '"Guésachet, Nélia", Bérénice Janchequier, , Tom ': ["Guésachet, Nélia", "Bérénice Janchequier", "Tom"],
    "Aurore Fouchesset / Kenza Naugrechet": ["Aurore Fouchesset", "Kenza Naugrechet"],
    "Pôle R/D": ["Pôle R/D"],
    '["Ilan Belsaquier", "Nolan Sauraville"]': ["Ilan Belsaquier", "Nolan Sauraville"],
    '["A"]': ["A"],
    "a<br>b<BR/>c": ["a", "b", "c"],
    " a \t| b ": ["a", "b"],
    '5" écran; "b"': ['5" écran', "b"],
    '"sans fin; b': ['"sans fin', "b"],
    '"a";;""': ["a"],
    "a < b": ["a < b"],
    " ": [],
    "": [],
    ";;|": [],
}


def found(spark, rows):
    df = spark.createDataFrame([(i, x, "z", 7) for i, x in enumerate(rows)], "rec_id long, technicien string, champ string, rang int")
    out = {}
    for r in split_values(df, ["rec_id"], ["technicien"]).collect():
        out.setdefault(r.rec_id, []).append((r.rang, r.valeur))
    return [[v for _, v in sorted(out.get(i, []))] for i in range(len(rows))], out


def test_cases(spark):
    got, raw = found(spark, [*CASES, None])
    assert got == [*CASES.values(), []]
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in raw.values())


def test_repeats_long_and_empty(spark):
    long = ";".join(f"v{i}" for i in range(5000))
    words, tags = "mot < " * 40_000 + "fin", "<a" * 30_000
    got, _ = found(spark, [long, long, words, tags, '"' + words + '"; b', "x" * 300_000])
    assert got[0] == got[1] == [f"v{i}" for i in range(5000)]
    assert got[2:] == [[words], [tags], [words, "b"], ["x" * 300_000]]
    assert split_values(spark.createDataFrame([], "rec_id long, technicien string"), ["rec_id"], ["technicien"]).count() == 0


@given(st.text(alphabet='XLRBs";,|/nth[]', max_size=30))
def test_rules_stay_inside(skeleton):
    """Whatever the skeleton: values are ordered, disjoint and within it."""
    at = 0
    for r in split_rule(skeleton):
        assert r["debut"] - 1 >= at and r["longueur"] > 0
        at = r["debut"] - 1 + r["longueur"]
    assert at <= len(skeleton)


@pytest.mark.parametrize("value", ["a,b;c|d", '"x, y"; z'])
def test_same_value_same_rule(spark, value):
    got, _ = found(spark, [value] * 3)
    assert got[0] == got[1] == got[2]
