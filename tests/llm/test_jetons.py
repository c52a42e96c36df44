"""Encoding: equal to the other library on whole texts, exact round trip."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guichet.llm import jetons

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{jetons.FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary")
TEXTS = ["", None, " ", "Bonjour, l'écran n'a plus rien.", "  deux  espaces \n\n\t fin  ", "😀🇫🇷 é ​ ", "don't we'll <|endoftext|>", "x" * 3000, "a b" * 5000, "12345678901234567890abc"]


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{jetons.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def encoder():
    with open(f"{jetons.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        return jetons._encoder(f.read(), jetons.PATTERN)


def test_against_the_other_library(spark, other):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in jetons.encode(df, "text", ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS * 2):
        assert got[i] == (other.encode(t, add_special_tokens=False).ids if t else [])


def test_round_trip_and_counts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    k = jetons.Tokenizer(spark)
    rows = df.withColumn("ids", k.ids(F.col("text"))).select("text", F.size("ids").alias("m"), k.count(F.col("text")).alias("n"), k.decode(F.col("ids")).alias("b")).collect()
    assert all(bytes(r.b).decode() == (r.text or "") and r.m == r.n for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1\n'é.  ", max_size=80), st.integers(1, 12))
def test_cuts_change_nothing(text, size):
    e = encoder()
    parts = list(jetons.cut_safely(text, size))
    assert "".join(parts) == text and [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


def test_empty(spark):
    assert jetons.encode(spark.createDataFrame([], "doc_id long, text string"), "text", ["doc_id"]).count() == 0
