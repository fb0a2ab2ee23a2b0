"""Vector similarity: cosine, row-wise triples, query set against all rows, positional zip, joined texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, null for a null vector."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0)))


#: Queries of one block and rows of one chunk of a search; blocks of queries that are broadcast together.
QUERY_BLOCK, CHUNK, BROADCAST_BLOCKS = 1_000, 1_000, 20


def _packed(rows: DataFrame, number: int, prefix: str) -> DataFrame:
    """Rows of (id, v) as ``number`` rows of arrays, spread by hash."""
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias(f"{prefix}_no")).agg(F.collect_list(F.struct("id", F.col("v").alias("v"))).alias(prefix))


def _products(kind: pa.DataType, diagonal: bool):  # noqa: ANN202
    def side(cell: pa.Scalar) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        ids, lists = cell.values.field("id"), cell.values.field("v")
        valid = np.asarray(lists.is_valid())
        width = max((len(x) for x in lists.to_pylist() if x is not None), default=0)
        v = np.zeros((len(ids), width))
        if valid.any():
            v[valid] = np.array(lists.filter(pa.array(valid)).to_pylist(), np.float64)
        n = np.zeros(len(ids))
        for k in range(width):  # summed from the left
            n = n + v[:, k] * v[:, k]
        return ids, v, np.sqrt(n), valid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                (i, q, qn, ok_q), (j, v, vn, ok_v) = side(b.column("q")[row]), side(b.column("c")[row])
                width = min(q.shape[1], v.shape[1])
                dots = np.zeros((len(i), len(j)))
                for k in range(width):
                    dots += q[:, k, None] * v[None, :, k]
                norms = qn[:, None] * vn[None, :]
                sims = np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0).ravel()
                rows, columns = np.divmod(np.arange(len(i) * len(j)), max(1, len(j)))
                left, right = i.take(pa.array(rows)), j.take(pa.array(columns))
                out = pa.RecordBatch.from_arrays([left.cast(kind), right.cast(kind), pa.array(sims, pa.float64(), mask=~(ok_q[rows] & ok_v[columns]))], names=["i", "j", "sim"])
                yield out if diagonal else out.filter(pc.not_equal(out.column(0), out.column(1)))

    return run


def cosine_to_queries(df: DataFrame, id: str, vector: str, query: Column, diagonal: bool = False) -> DataFrame:
    """(i, j, sim) of a stated query set against all other rows (with ``diagonal``, also each query itself), in blocks.

    Queries and rows are packed into blocks of about QUERY_BLOCK and chunks of about CHUNK rows; every block meets every
    chunk in one join and is multiplied there in double precision. Blocks are broadcast up to BROADCAST_BLOCKS, else they
    meet the chunks by their number in a shuffle. 0 for a zero vector, null for a null vector; null ids are left out.
    """
    base = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v")).filter("id is not null")
    q = base.filter(query)
    counts = base.agg(F.count("*").alias("n"), F.count(F.when(query, 1)).alias("q")).first()
    blocks, chunks = max(1, -(-counts["q"] // QUERY_BLOCK)), max(1, -(-counts["n"] // CHUNK))
    left, right = _packed(q, blocks, "q"), _packed(base, chunks, "c")
    if blocks <= BROADCAST_BLOCKS:
        met = right.join(F.broadcast(left), F.lit(True))
    else:
        met = right.withColumn("q_no", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(left, "q_no")
    kind = df.schema[id].dataType
    return met.select("q", "c").mapInArrow(_products(to_arrow_type(kind), diagonal), f"i {kind.simpleString()}, j {kind.simpleString()}, sim double")


def triple_similarity(df: DataFrame, mc: Column, hc1: Column, hc2: Column, keep: list[str]) -> DataFrame:
    """The three pairwise similarities of each row."""
    return df.select(*keep, cosine(mc, hc1).alias("MC_HC1"), cosine(mc, hc2).alias("MC_HC2"), cosine(hc1, hc2).alias("HC1_HC2"))


def zip_pairs(df: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """Pairs of two arrays by position, cut to the shorter one: keep, pos (from 0), a, b."""
    n = F.least(F.size(a), F.size(b))
    z = F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))
    return df.filter((F.size(a) > 0) & (F.size(b) > 0)).select(*keep, F.posexplode(z).alias("pos", "z")).select(*keep, "pos", F.col("z.a").alias("a"), F.col("z.b").alias("b"))


def joined(c: Column) -> Column:
    """Texts of an array run together without a separator."""
    return F.array_join(c, "")


def zip_similarity(df: DataFrame, keep: list[str], a: str, b: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Similarity of two arrays of texts pair by pair, cut to the shorter one: keep, pos (from 0), a, b, sim."""
    pairs = zip_pairs(df, keep, a, b)
    return pairs.select(*keep, "pos", "a", "b", cosine(embed(F.col("a")), embed(F.col("b"))).alias("sim"))


def joined_similarity(df: DataFrame, keep: list[str], sides: dict[str, Column], embed: Callable[[Column], Column]) -> DataFrame:
    """Similarity of every two sides (arrays of texts run together): keep, left, right, sim."""
    vectors = df.select(*keep, *[embed(joined(c)).alias(f"__{n}") for n, c in sides.items()])
    names = list(sides)
    rows = [F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), cosine(F.col(f"__{x}"), F.col(f"__{y}")).alias("sim")) for k, x in enumerate(names) for y in names[k + 1 :]]
    return vectors.select(*keep, F.inline(F.array(*rows)))
