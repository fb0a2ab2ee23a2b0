"""Duplicates hidden by formatting, against a dictionary."""

import random

import pytest

import refsieve.llm.formatting_duplicates as fd


def brute(rows):
    groups = {}
    for i, k in rows:
        groups.setdefault(k or "", []).append(i)
    return {(min(v), i, len(v)) for v in groups.values() for i in v}


@pytest.mark.parametrize("limit", [3, 20, 100_000])
def test_against_brute_force(spark, limit):
    r = random.Random(limit)
    keys = [None, "", "a", "aaaaaa", "aaaaaab", "aaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaab", "é", "éé", "x" * 5000, "x" * 5000 + "y", "a\0", "a\0\0"] + [f"10{r.randint(0, 30)}" for _ in range(30)]
    rows = [(k, r.choice(keys) if r.random() < 0.6 else "aaaaaab") for k in range(300)]
    df = spark.createDataFrame(rows, "id bigint, key string")
    assert {tuple(x) for x in fd.collapse(df, "key", "id", limit).select("keep", "id", "copies").collect()} == brute(rows)


def test_formatting(spark):
    rows = [
        (1, "Straße und Maß: eine  Studie.", "10.5555/AB.c"), (2, " STRASSE UND MASS eine_Studie", "https://doi.example/10.5555/ab.C"), (3, "doi: 10.5555/ab.c", "Straße und Maß eine Studie"), (4, "Straße und Maß", "10.5555/ab.c"),
        (5, None, None), (6, " ", ""), (7, None, "10.5555/x"), (8, "<10.5555/X>", None),
    ]
    out = fd.formatting_duplicates(spark.createDataFrame(rows, "ord bigint, title string, doi string"))
    assert {(r["ord"], r["keep_ord"], r["copies"]) for r in out.collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 2), (6, 5, 2), (7, 7, 2), (8, 7, 2)}


def test_empty_and_clashing_names(spark):
    assert fd.formatting_duplicates(spark.createDataFrame([], "ord bigint, title string, doi string")).count() == 0
    df = spark.createDataFrame([(1, "k", 2, "x"), (2, "k", 9, "y")], "id bigint, key string, keep int, copies string")
    assert {tuple(r) for r in fd.collapse(df, "key", "id").collect()} == {(1, 1, 2), (1, 2, 2)}
