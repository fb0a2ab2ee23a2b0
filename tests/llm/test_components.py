"""Connected groups against a union of sets."""

import random

from refsieve.llm.components import components, match_groups


def brute(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(v, find(v)) for v in root}


def check(spark, pairs, names=("a", "b")):
    df = spark.createDataFrame(pairs, f"{names[0]} bigint, {names[1]} bigint")
    assert {tuple(r) for r in components(df, *names).collect()} == brute(pairs)


def test_random_graph(spark):
    r = random.Random(1)
    check(spark, [(r.randint(0, 150), r.randint(0, 150)) for _ in range(120)] + [(5, 5), (None, 3), (7, None), (3, 9), (9, 3), (3, 9)])


def test_chain_star_and_negative_ids(spark):
    check(spark, [(k, k + 1) for k in range(60)])
    check(spark, [(-1, k) for k in range(200)] + [(-7, -9)])


def test_columns_may_be_called_as_the_helpers(spark):
    for names in (("u", "v"), ("v", "u"), ("v", "c"), ("x", "y")):
        check(spark, [(1, 2), (3, 2), (9, 8), (8, 7)], names)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, 1), (None, None)])


def test_match_groups(spark):
    pairs = [(1, 2, "match"), (2, 3, "match"), (3, 4, "no match"), (5, 99, "match"), (6, None, "match"), (7, 7, "match"), (2, 1, "match"), (None, 8, "match"), (8, 9, None)]
    m = spark.createDataFrame(pairs, "left_ord bigint, right_ord bigint, verdict string")
    a = spark.createDataFrame([(k,) for k in range(1, 10)], "ord bigint")
    assert {tuple(r) for r in match_groups(m, a).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_hot_vertex_is_joined_by_broadcast(spark, monkeypatch):
    import refsieve.llm.components as c
    from refsieve.runtime import join_hot

    monkeypatch.setattr(c, "join_hot", lambda a, b, k, how: join_hot(a, b, k, how, share=0.05, least=5))
    check(spark, [(0, k) for k in range(1, 80)] + [(100, 101), (101, 102)])
