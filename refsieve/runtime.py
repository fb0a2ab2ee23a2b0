"""Session helpers: checkpoint folder, size-checked broadcast, parallelism."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may have at most; beyond it every operator takes a shuffle join.
BROADCAST_ROWS = 200_000
#: Bytes it may have at most, at 64 bytes a text and 16 a number.
BROADCAST_BYTES = 64 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one is set only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="refsieve-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows evenly before a costly Python step: small inputs would run in one task, since partitions are sized by bytes."""
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), 2 * spark.sparkContext.defaultParallelism))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_checked(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a right side that is usually small: broadcast it when its counted rows, of the width the plan expects, are at most ``rows`` and BROADCAST_BYTES, else shuffle."""
    width = max(16, sum(f.dataType.jsonValue() in ("string", "binary") and 64 or 16 for f in right.schema))
    small = right.limit(rows + 1).count() <= min(rows, BROADCAST_BYTES // width)
    return left.join(F.broadcast(right) if small else right, on, how)


def hot_keys(df: DataFrame, key: str, share: float = 1e-3, least: int = 10_000) -> list:
    """Keys that hold more than ``share`` of the rows (and ``least`` rows): at most 1/share of them, by construction.

    The count is combined map-side, so a hot key never gathers in one task. Null is no key. One job where nothing is hot.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    total, top = counts.agg(F.sum("count"), F.max("count")).first()
    most = max(least, int((total or 0) * share))
    return [r[0] for r in counts.filter(F.col("count") > most).select(key).collect()] if (top or 0) > most else []


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: float = 1e-3, least: int = 10_000) -> DataFrame:
    """Equi-join where ``left`` may be skewed on ``key`` and ``right`` holds each key once.

    Right rows of the hot keys (at most 1/share rows) are broadcast, all others meet in a shuffle join, so no task
    receives the rows of a hot key. Null keys match nothing.
    """
    found = hot_keys(left, key, share, least)
    if not found:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(found), F.lit(False))
    a = left.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(found))), key, how)
    return a.unionByName(left.filter(~is_hot).join(right, key, how))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path (once per Spark context)."""
    sc = spark.sparkContext
    if getattr(sc, "_refsieve_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="refsieve-zip-")) / "refsieve.zip"  # read by the driver's file server alone
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._refsieve_shipped = True
