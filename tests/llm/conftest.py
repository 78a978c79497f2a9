"""A small corpus with the awkward cases: nulls, empty, one word, long, exact and near copies, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import types as T

WORDS = [f"w{i}" for i in range(900)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 70)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base, "en", "a", "x"), (2, base, "en", "b", "x"), (3, " ".join(edited), "en", "b", None), (4, None, "en", None, "x"), (5, "", "de", "a", "x"),
        (6, "one", "de", "a", "x"), (7, "one", "de", "a", "x"), (8, "two words", None, "c", "x"), (9, " \t\n ", "fr", "c", "x"),
        (10, prose(3, 80) + "\n" + passage + " " + prose(4, 60), "en", "c", "x"), (11, prose(5, 40) + " " + passage + "\n" + prose(6, 90), "en", "d", "x"),
        (12, prose(7, 30) + " " + passage, "en", None, "x"), (13, prose(8, 6000), "en", "a", "x"), (14, "the " * 400, "en", "a", "x"), (15, "the " * 300, "en", "b", "x"),
        (16, prose(9, 200).upper(), "en", "b", "x"), (16, prose(9, 200).upper(), "en", "b", "x"), (None, prose(10, 90), "en", "d", "x"), (18, "Ünïcode “quoted” ß 漢字 \U0001f600 " * 20, "de", "d", "x"),
    ]
    return rows + [(i, prose(100 + i, 20 + i), "en", "abcde"[i % 5], "x") for i in range(20, 60)]


SCHEMA = "doc_id long, text string, lang string, source string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
