"""First-occurrence duplicate flags and the removal of duplicates by DOI and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Helper columns; reserved so that no input column can shadow a mask.
FLAG_DOI, FLAG_TITLE = "__dup_doi", "__dup_title"


def fold(c: Column) -> Column:
    """Upper case with full Unicode folding; nothing is trimmed or normalised."""
    return F.upper(c)


#: Keys whose first occurrences are looked up, with the bit that stands for each.
KEYS = {"doi": (FLAG_DOI, 1), "title": (FLAG_TITLE, 2)}


def first_occurrences(df: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    """(ord, bits): rows that are the first, by ``ord``, of a folded value; bit k is set for the k-th key. Null equals null.

    All keys are looked up in one scan: a row gives one (key number, value, ord) for each, the smallest ord of a value is
    combined map-side, so a value (or null) of any share is one row of each task.
    """
    value = lambda c: F.coalesce(F.concat(F.lit("="), fold(F.col(c))), F.lit(""))  # noqa: E731  null: ''
    long = df.select(F.col(ord).alias("ord"), F.explode(F.array(*[F.struct(F.lit(1 << k).alias("bit"), value(c).alias("value")) for k, c in enumerate(keys)])).alias("k"))
    return long.groupBy("k.bit", "k.value").agg(F.min("ord").alias("ord")).groupBy("ord").agg(F.bit_or("bit").alias("bits"))


def duplicate_flags(df: DataFrame, ord: str = "ord", window: bool = False) -> DataFrame:
    """Both masks, each on the whole input: true for the second and later rows, by ``ord``, of the folded value.

    ``ord`` is unique, so the join that brings the first occurrences back has no hot key; ``window=True`` takes one
    window for each key instead.
    """
    if window:
        for key, (flag, _) in KEYS.items():
            df = df.withColumn(flag, F.col(ord) > F.min(ord).over(Window.partitionBy(fold(F.col(key)))))
        return df
    first = first_occurrences(df, list(KEYS), ord).select(F.col("ord").alias("__ord"), F.col("bits").alias("__bits"))
    out = df.join(first, F.col(ord) == F.col("__ord"), "left")
    for flag, bit in KEYS.values():
        out = out.withColumn(flag, F.coalesce(F.col("__bits"), F.lit(0)).bitwiseAND(F.lit(bit)) == 0)
    return out.drop("__ord", "__bits")


def duplicate_mask(conserve: bool = False) -> Column:
    """Either key seen before; with ``conserve``, both (possibly on different rows)."""
    return (F.col(FLAG_DOI) & F.col(FLAG_TITLE)) if conserve else (F.col(FLAG_DOI) | F.col(FLAG_TITLE))


def arrange(df: DataFrame, ord: str = "ord") -> DataFrame:
    """Global sort by doi, author, year, nulls last, stable by ``ord``; binary order."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in ("doi", "author", "year")], F.col(ord))


def dedup(df: DataFrame, get_dup: bool = False, conserve: bool = False, ord: str = "ord", sort: bool = True, window: bool = False) -> DataFrame:
    """Rows kept, or with ``get_dup`` the rows removed; sorted by doi, author, year."""
    mask = duplicate_mask(conserve)
    out = duplicate_flags(df, ord, window).filter(mask if get_dup else ~mask).drop(FLAG_DOI, FLAG_TITLE)
    return arrange(out, ord) if sort else out


def split_duplicates(df: DataFrame, conserve: bool = False, ord: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(kept, removed), with the flags computed once and shared."""
    flagged = duplicate_flags(df, ord).persist()
    mask = duplicate_mask(conserve)
    kept, removed = flagged.filter(~mask), flagged.filter(mask)
    return kept.drop(FLAG_DOI, FLAG_TITLE), removed.drop(FLAG_DOI, FLAG_TITLE)
