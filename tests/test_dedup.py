"""Duplicate flags, both modes, sorting."""

import random

import pytest

from refsieve.operators.dedup import FLAG_DOI, FLAG_TITLE, arrange, dedup, duplicate_flags, split_duplicates

SCHEMA = "ord bigint, doi string, title string, author string, year string"
GOLD = [
    (0, "10.1/A", "T one", "b", "2001"), (1, "10.1/a", "T two", "a", "2001"), (2, "10.1/c", "t TWO", "a", "2000"), (3, None, "x", None, "1999"), (4, None, "y", "z", None),
    (5, "10.1/d", "Straße", "q", "2"), (6, "10.1/e", "STRASSE", "q", "10"), (7, "10.1/f", None, "q", "3"), (8, "10.1/g", None, "é", "3"), (9, "", "T one", "Z", "3"), (10, "10.1/C", "X", "m", "5"),
]


def ords(df):
    return [r["ord"] for r in df.select("ord").collect()]


@pytest.mark.parametrize("window", [False, True])
def test_gold(spark, window):
    df = spark.createDataFrame(GOLD, SCHEMA)
    flags = {r["ord"]: (r[FLAG_DOI], r[FLAG_TITLE]) for r in duplicate_flags(df, window=window).collect()}
    assert {o for o, (d, _) in flags.items() if d} == {1, 4, 10}
    assert {o for o, (_, t) in flags.items() if t} == {2, 6, 8, 9, 10}
    assert ords(dedup(df, window=window)) == [0, 5, 7, 3]
    assert set(ords(dedup(df, get_dup=True, window=window))) == {1, 2, 4, 6, 8, 9, 10}
    assert set(ords(dedup(df, conserve=True, window=window))) == set(range(10))
    assert ords(dedup(df, True, True, window=window)) == [10]
    assert ords(arrange(df)) == [9, 0, 10, 1, 2, 5, 6, 7, 8, 4, 3]


def test_properties(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, "", "a", "A", "b", "c"]), r.choice([None, "t", "T", "u", "ß", "SS"]), None, None) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for conserve in (False, True):
        kept, removed = split_duplicates(df, conserve)
        assert sorted(ords(kept) + ords(removed)) == list(range(200))
        assert set(ords(dedup(df.repartition(7), conserve=conserve))) == set(ords(kept))
        again = dedup(dedup(df, conserve=conserve), conserve=conserve)
        assert set(ords(again)) == set(ords(kept))
    assert set(ords(dedup(df))) <= set(ords(dedup(df, conserve=True)))


def test_empty_and_extra_columns(spark):
    assert dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(*GOLD[0], True, 1), (*GOLD[1], False, 2)], SCHEMA + ", duplicates boolean, count int")
    out = dedup(df)
    assert out.columns == df.columns and ords(out) == [0]
