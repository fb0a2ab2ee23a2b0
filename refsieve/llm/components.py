"""Connected groups of pairwise matches by random graph contraction.

Each round gives every vertex a fresh pseudo-random rank, hooks it to the neighbour (or itself) of the smallest rank,
relabels both ends of every edge and drops loops and repeated edges. The vertices of a chain shrink by a constant
factor a round whatever the shape of the graph. The mappings of the rounds are expanded backwards at the end. Every
round is written to the shared checkpoint folder, so a lost executor costs one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, join_hot


def _rank(v: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(v, F.lit(salt)).alias("r"), v.alias("v"))


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 200) -> DataFrame:
    """(vertex, component) of every vertex with an edge to another one; component is the smallest vertex of its group.

    ``left`` and ``right`` are bigint columns. Rows with a null end and loops link nothing; repeated and reversed pairs
    count once; extra columns are ignored; no edges give an empty result. A vertex with any share of the edges is
    reduced map-side before the shuffle, and joins on such a vertex are broadcast (``join_hot``).
    """
    a, b = F.col(f"`{left}`").cast("bigint"), F.col(f"`{right}`").cast("bigint")
    linked = edges.filter(a.isNotNull() & b.isNotNull() & (a != b))  # before the renaming: columns may be called u or v
    edges = cut(linked.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    mappings: list[DataFrame] = []
    for salt in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        hook = both.groupBy("x").agg(F.min(_rank(F.col("y"), salt)).alias("m"))
        hook = cut(hook.select("x", F.least("m", _rank(F.col("x"), salt)).alias("w")).select("x", F.col("w.v").alias("to")))
        mappings.append(hook)
        moved = join_hot(edges, hook.select(F.col("x").alias("u"), F.col("to").alias("u2")), "u", "inner").select("v", "u2")
        moved = join_hot(moved, hook.select(F.col("x").alias("v"), F.col("to").alias("v2")), "v", "inner").select("u2", "v2")
        edges = cut(moved.filter("u2 != v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct())
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    if not mappings:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    root = mappings[-1]
    for step in reversed(mappings[:-1]):  # step: x -> to; root: to -> its representative, where to was still linked
        deeper = root.select(F.col("x").alias("to"), F.col("to").alias("far"))
        root = cut(join_hot(step, deeper, "to", "left").select("x", F.coalesce("far", "to").alias("to")))
    # The representative of a group need not be its smallest vertex.
    least = root.groupBy("to").agg(F.min("x").alias("least"))
    out = join_hot(root, least, "to", "inner")
    return out.select(F.col("x").alias("vertex"), F.least("least", "to").alias("component"))


def match_groups(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """(ord, group_ord) of every reference linked by a ``match`` of two different references that are still present."""
    known = articles.select(F.col("ord").alias("o"))
    m = pairs.filter((F.col("verdict") == "match") & F.col("left_ord").isNotNull() & F.col("right_ord").isNotNull() & (F.col("left_ord") != F.col("right_ord")))
    m = m.select(F.least("left_ord", "right_ord").alias("a"), F.greatest("left_ord", "right_ord").alias("b")).distinct()
    for side in "ab":
        m = join_hot(m, known.withColumnRenamed("o", side), side, "inner").select("a", "b")
    return components(m, "a", "b").select(F.col("vertex").alias("ord"), F.col("component").alias("group_ord"))
