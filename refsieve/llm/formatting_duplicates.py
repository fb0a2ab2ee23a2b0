"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, tries with terminal counters.

Buckets are byte prefixes of the canonical text. A bucket with more rows than fit is split by further bytes, level by
level and past what all its texts share, until each fits. A bucket of one text cannot be split: all its rows are one
terminal, whose counter is built by a map-side combined count, so a text that holds a third of all rows never gathers in a task. Every other bucket
goes whole to one task (several small ones share it), where a trie over eight-byte edges is grown for all its rows at
once; its terminal nodes count their rows and keep the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, join_checked, join_hot
from .canonical import pair_key

#: Rows of a bucket that one task takes, and bytes by which a bucket is split at each level.
BUCKET_ROWS, STEP = 100_000, 6


def _trie(keys: pa.Array) -> tuple[np.ndarray, int]:
    """Terminal node of every key in a trie whose edges are eight bytes, grown breadth first; the number of nodes."""
    raw = keys.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    node, terminal = np.zeros(len(raw), np.int64), np.full(len(raw), -1, np.int64)
    alive, depth, nodes = np.arange(len(raw)), 0, 1
    while len(alive):
        left = size[alive] - depth
        edge = np.zeros((len(alive), 9), np.uint8)
        for k in range(8):
            has = left > k
            edge[has, k] = data[start[alive[has]] + depth + k]
        edge[:, 8] = np.minimum(left, 8)  # a key that ends inside the edge differs from one that goes on with zeros
        word = np.ascontiguousarray(edge[:, :8]).view(np.uint64).ravel()
        order = np.lexsort((edge[:, 8], word, node[alive]))
        w, l, p = word[order], edge[order, 8], node[alive][order]
        new = np.r_[True, (w[1:] != w[:-1]) | (l[1:] != l[:-1]) | (p[1:] != p[:-1])]
        child = np.empty(len(alive), np.int64)
        child[order] = nodes + np.cumsum(new) - 1
        nodes += int(new.sum())
        node[alive] = child
        done = left <= 8
        terminal[alive[done]] = child[done]
        alive, depth = alive[~done], depth + 8
    return terminal, nodes


def _count(batch: pa.Table) -> pa.Table:
    """Smallest id and number of rows of the terminal of each row of a bucket."""
    batch = batch.combine_chunks()
    key = batch.column("__key")
    terminal, nodes = _trie(key.chunk(0) if key.num_chunks else pa.array([], pa.binary()))
    ids = batch.column("__id").to_numpy()
    first = np.full(nodes, np.iinfo(np.int64).max)
    np.minimum.at(first, terminal, ids)
    counter = np.bincount(terminal, minlength=nodes)
    return pa.table({"keep": pa.array(first[terminal], pa.int64()), "id": pa.array(ids, pa.int64()), "copies": pa.array(counter[terminal], pa.int64())})


def _next_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes by which an oversized bucket is split: a step behind what all its texts share; -1 if they are one text."""
    for b in batches:
        depth = []
        for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            shared = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            depth.append(-1 if x == y else shared + STEP)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depth, pa.int32())], names=["__prefix", "__next"])


def collapse(df: DataFrame, key: str, id: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``keep``, ``id``, ``copies`` of every row: rows with the same canonical text share the smallest id.

    ``key`` is a string column of canonical text (null counts as empty), ``id`` a unique bigint. All rows are kept;
    other columns are ignored, whatever their names. An empty table gives an empty result, a repeated text of any
    share is counted before the shuffle, a text of any length is compared as a whole.
    """
    rows = df.select(F.encode(F.coalesce(F.col(f"`{key}`"), F.lit("")), "utf-8").alias("__key"), F.col(f"`{id}`").cast("bigint").alias("__id"))
    rows = rows.persist()
    open_, fitting, hot, level = rows.withColumn("__depth", F.lit(STEP)), [], [], 0
    while True:
        level += 1
        open_ = open_.withColumn("__prefix", F.expr("substring(__key, 1, __depth)"))
        sized = open_.groupBy("__prefix").agg(F.count("*").alias("__n"), F.min("__key").alias("__min"), F.max("__key").alias("__max")).filter(F.col("__n") > bucket_rows)
        over = sized.select("__prefix", "__min", "__max").mapInArrow(_next_depth, "__prefix binary, __next int").persist()
        if over.isEmpty():
            fitting.append(open_.select("__key", "__id", "__prefix"))
            break
        marked = join_checked(open_, over, "__prefix")  # at most rows / bucket_rows prefixes
        if level % 3 == 0:
            marked = cut(marked)
        fitting.append(marked.filter(F.col("__next").isNull()).select("__key", "__id", "__prefix"))
        hot.append(marked.filter(F.col("__next") < 0).select("__key", "__id"))
        open_ = marked.filter(F.col("__next") > 0).select("__key", "__id", F.col("__next").alias("__depth"))
    todo = reduce(DataFrame.unionByName, fitting)
    # Buckets share a task's group; a group holds about bucket_rows rows, and a bucket at most that many more.
    groups = max(1, -(-rows.count() // bucket_rows))
    out = todo.groupBy(F.pmod(F.xxhash64("__prefix"), F.lit(groups)).alias("__group")).applyInArrow(_count, "keep bigint, id bigint, copies bigint")
    for h in hot:  # every bucket here is one text of more than bucket_rows rows
        counted = h.groupBy("__key").agg(F.min("__id").alias("keep"), F.count("*").alias("copies"))
        out = out.unionByName(join_hot(h, counted, "__key", "inner").select("keep", F.col("__id").alias("id"), "copies"))
    return out


def formatting_duplicates(articles: DataFrame) -> DataFrame:
    """(ord, keep_ord, copies) of every reference: same title and DOI but for white space, case, punctuation and order."""
    keyed = articles.select("ord", pair_key(F.col("title"), F.col("doi")).alias("__canonical"))
    return collapse(keyed, "__canonical", "ord").select(F.col("id").alias("ord"), F.col("keep").alias("keep_ord"), "copies")
