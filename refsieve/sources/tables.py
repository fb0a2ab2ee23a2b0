"""Parquet tables, CSV, run metadata, tracked files, article files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import partitions

EXCERPT = "mc string, hc1 string, hc2 string"
META_COLUMNS = "name type data command depend seed path time size bytes format repository iteration parent children seconds warnings error".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_excerpts(spark: SparkSession, path: str, schema: str = EXCERPT) -> DataFrame:
    """CSV with a header and text cells by position; cells may hold commas, quotes and line breaks, empty cells are null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)


def write_csv(df: DataFrame, path: str, ord: str = "ord", keep_ord: bool = False, files: int | None = None) -> str:
    """CSV with a header, in the order of ``ord``; range-split parts, with ``files=1`` one file. Returns the path."""
    if files == 1:
        out = df.coalesce(1).sortWithinPartitions(ord)
    else:
        out = df.repartitionByRange(files or partitions(df.sparkSession), ord).sortWithinPartitions(ord)
    (out if keep_ord else out.drop(ord)).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False, emptyValue='""', lineSep="\n")
    return path


def read_run_meta(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited run metadata, 18 string columns."""
    return spark.read.schema(", ".join(f"{c} string" for c in META_COLUMNS)).csv(path, sep="|", header=True)


def meta_time(time: Column) -> Column:
    """Time of a run, from days since the epoch written like ``t19886.7257s``."""
    days = F.regexp_extract(time, r"^t([0-9.]+)s$", 1)
    return F.when(days != "", F.timestamp_micros(F.round(F.try_to_number(days, F.lit("999999999.99999999999999")).cast("double") * 86400e6).cast("bigint")))


def meta_paths(path: Column) -> Column:
    """Paths of a run; several are joined by an asterisk."""
    return F.when(path.isNotNull(), F.split(path, r"\*"))


def tracked_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, bytes, modified, sha256) of files."""
    b = spark.read.format("binaryFile").load(glob)
    return b.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def read_articles(spark: SparkSession, glob: str) -> DataFrame:
    """(article_no, slug, path, text) of Markdown files named ``<no>-<slug>/<no>-<slug>.md``."""
    t = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"(\d+)-([^/]+)\.md$", 1)
    return t.select(F.when(name != "", name.cast("int")).alias("article_no"), F.regexp_extract("path", r"(\d+)-([^/]+)\.md$", 2).alias("slug"), "path", "text")
