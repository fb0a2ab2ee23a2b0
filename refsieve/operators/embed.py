"""Text embedding: an interface for models and a hashing embedder that needs none.

The hashing embedder counts hashed character n-grams. It is deterministic and offline; its scores are not those of a
sentence model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, join_hot


#: Factors by which the code points of the three letters of a gram are mixed.
MIX = (31, 7, 1)


def hashing_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of hashed letter triples as array<double> of ``dims``, in one pass over the text. Null gives null, short texts zeros."""

    @F.pandas_udf("array<double>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                c = None if t is None else np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                out.append(None if c is None else np.bincount((c[:-2] * MIX[0] + c[1:-1] * MIX[1] + c[2:] * MIX[2]) % dims if len(c) > 2 else np.empty(0, np.int64), minlength=dims).astype(np.float64))
            yield pd.Series(out, index=texts.index, dtype=object)

    return count(text)


def embed_texts(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "embedding") -> DataFrame:
    """Embed with a model: ``load`` is called once per task and returns a function from texts to vectors."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            have = texts.notna()
            vectors = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if have.any():
                vectors[have] = pd.Series(list(model(texts[have].tolist())), index=texts.index[have])
            yield vectors

    return df.withColumn(out, encode(F.col(column)))


def embed_distinct(df: DataFrame, columns: list[str], embed: Callable[[Column], Column]) -> DataFrame:
    """Add ``<column>_vec`` for text columns, embedding each distinct text once: for costly embedders.

    Texts meet their vectors by a digest; null texts get keys of their own, and texts of any share are joined by
    broadcast, so that neither gathers in one task.
    """
    digest = lambda c: F.sha2(F.col(c), 256)
    texts = df.select(F.explode(F.array(*columns)).alias("__t")).filter("__t is not null").groupBy(digest("__t").alias("__k")).agg(F.first("__t").alias("__t"))
    vectors = cut(texts.select("__k", embed(F.col("__t")).alias("__v")))
    for c in columns:
        keyed = df.withColumn("__k", F.coalesce(digest(c), F.concat(F.lit("~"), F.monotonically_increasing_id())))
        df = join_hot(keyed, vectors.withColumnRenamed("__v", f"{c}_vec"), "__k").drop("__k")
    return df
