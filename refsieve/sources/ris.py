"""RIS text: splittable reader, tag mapping, writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import join_checked

#: File splits whose counts are broadcast, beyond which they are joined by shuffle.
SPLIT_ROWS = 1_000_000
TAGS = "array<struct<tag:string,value:string>>"
#: Joins repeated values of a field into one string.
MULTI = " and "

# RIS tags of the fields, by preference.
FIELD_TAGS = {
    "title": ["TI", "T1"],
    "doi": ["DO"],
    "author": ["AU", "A1"],
    "year": ["PY", "Y1"],
    "abstract": ["AB", "N2"],
    "journal": ["JO", "T2", "JF"],
    "keywords": ["KW"],
    "notes": ["N1"],
    "type": ["TY"],
}
SINGLE = ("title", "doi", "year", "type")
_LINE = r"(?m)^([A-Z][A-Z0-9])  ?-[ \t]?(.*(?:\n(?![A-Z][A-Z0-9]  ?-).*)*)"


def parse_record(text: Column) -> Column:
    """Tags of one record in order; continuation lines are appended with a blank, line ends of any kind allowed."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    tags = F.regexp_extract_all(unix, F.lit(_LINE), F.lit(1))
    values = F.regexp_extract_all(unix, F.lit(_LINE), F.lit(2))
    pairs = F.zip_with(tags, values, lambda t, v: F.struct(t.alias("tag"), F.trim(F.regexp_replace(v, r"\s*\n\s*", " ")).alias("value")))
    return F.filter(pairs, lambda p: p["tag"] != "ER").cast(TAGS)


def numbered(records: DataFrame) -> DataFrame:
    """(ord, value) of records (value, _metadata) read from files, in the order of path and position.

    The rows of a file split stand together in one task and in order, so ``ord`` is the count of the splits before plus
    the place in the split: one row per split is summed up and joined back, the texts are not moved.
    """
    rec = records.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"))
    rec = rec.withColumn("mid", F.monotonically_increasing_id())
    splits = rec.groupBy("file", "block").agg(F.min("name").alias("name"), F.min("mid").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("name", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file split
    offsets = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    placed = join_checked(rec.drop("name"), offsets, ["file", "block"], "inner", SPLIT_ROWS)
    return placed.select((F.col("mid") + F.col("shift")).cast("bigint").alias("ord"), "value")


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """(ord, tags) of every record of RIS files, in the order of path and position.

    Files are split at the end-of-record line, so a large file is read by many tasks. A missing final end-of-record line
    is allowed; blank records give no row.
    """
    raw = spark.read.option("lineSep", "\nER  -").text(path).select("value", "_metadata")
    # what is left of the end-of-record line stands before the next record
    rec = raw.withColumn("value", F.regexp_replace("value", r"^(?:[ \t]*\r?\n)+", "")).filter(F.col("value").rlike(r"(?m)^[A-Z][A-Z0-9]  ?-"))
    return numbered(rec).select("ord", parse_record(F.col("value")).alias("tags"))


def _values(tags: Column, names: list[str]) -> Column:
    return F.transform(F.filter(tags, lambda p: p["tag"].isin(names) & p["value"].isNotNull()), lambda p: p["value"])


def to_table(records: DataFrame) -> DataFrame:
    """(ord, doi, title, author, year, extra): tags by field; repeated values joined, other tags kept in ``extra``.

    A single-valued field takes the first value of its most preferred tag; null where no tag has one. ``extra`` names
    tags by field where one is known; empty where nothing is left.
    """
    tags = F.col("tags")

    def field(name: str) -> Column:
        names = FIELD_TAGS[name]
        if name in SINGLE:
            return F.coalesce(*[F.get(_values(tags, [t]), F.lit(0)) for t in names])
        v = _values(tags, names)
        return F.when(F.size(v) > 0, F.array_join(v, MULTI))

    rest = F.filter(tags, lambda p: ~p["tag"].isin([t for n in ("title", "doi", "author", "year") for t in FIELD_TAGS[n]]) & (p["tag"] != "ER") & p["value"].isNotNull())
    names = F.array_distinct(F.transform(rest, lambda p: p["tag"]))
    label = lambda t: F.coalesce(*[F.when(t.isin(ts), F.lit(n)) for n, ts in FIELD_TAGS.items()], t)
    labels = F.array_distinct(F.transform(names, label))
    extra = F.map_from_arrays(labels, F.transform(labels, lambda n: F.transform(F.filter(rest, lambda p: label(p["tag"]) == n), lambda p: p["value"])))
    return records.select("ord", field("doi").alias("doi"), field("title").alias("title"), field("author").alias("author"), field("year").alias("year"), extra.alias("extra"))


_OTHER_TAGS = {name: tags[0] for name, tags in FIELD_TAGS.items() if name not in ("title", "doi", "author", "year", "type")}


def record_text(author: Column, title: Column, doi: Column, year: Column, extra: Column) -> Column:
    """One RIS record with every field, ``extra`` included: the inverse of ``to_table``.

    Null fields give no line, authors joined by ' and ' are one line each, line breaks are blanks. The record type is
    ``extra['type']``, else JOUR. Other fields of ``extra`` follow in the order of their names, one line a value: under
    the tag of the field, under the name itself where it is a tag, else in a note ``N1  - name: value``.
    """
    flat = lambda c: F.regexp_replace(c, r"\s*[\r\n]+\s*", " ")
    line = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(f"{tag}  - "), flat(c)))
    authors = F.when(author.isNotNull(), F.array_join(F.transform(F.split(flat(author), MULTI), lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    kind = F.concat(F.lit("TY  - "), F.coalesce(flat(F.get(extra["type"], F.lit(0))), F.lit("JOUR")))

    def front(name: Column) -> Column:
        known = F.coalesce(*[F.when(name == n, F.lit(f"{t}  - ")) for n, t in _OTHER_TAGS.items()])
        return F.coalesce(known, F.when(name.rlike("^[A-Z][A-Z0-9]$"), F.concat(name, F.lit("  - "))), F.concat(F.lit("N1  - "), flat(name), F.lit(": ")))

    lines = lambda e: F.transform(F.filter(e["value"], lambda v: v.isNotNull()), lambda v: F.concat(front(e["key"]), flat(v)))
    entries = F.filter(F.array_sort(F.map_entries(extra)), lambda e: (e["key"] != "type") & e["value"].isNotNull())
    rest = F.when(F.size(entries) > 0, F.array_join(F.flatten(F.transform(entries, lines)), "\n"))
    return F.concat_ws("\n", kind, line("TI", title), authors, line("DO", doi), line("PY", year), F.when(rest != "", rest), F.lit("ER  - "), F.lit(""))


def ris_lines(table: DataFrame, ord: str = "ord") -> DataFrame:
    """(ord, value): the text of each record; a table without ``extra`` has no other fields."""
    extra = F.col("extra") if "extra" in table.columns else F.lit(None).cast("map<string,array<string>>")
    return table.select(ord, record_text(F.col("author"), F.col("title"), F.col("doi"), F.col("year"), extra).alias("value"))


def write_ris(table: DataFrame, path: str, ord: str = "ord", files: int | None = None) -> str:
    """Write records in the order of ``ord`` and return the path; ``files=1`` gives one file, else range-split parts."""
    lines = ris_lines(table, ord)
    if files == 1:
        placed = lines.coalesce(1).sortWithinPartitions(ord)
    else:
        placed = lines.repartitionByRange(files or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), ord).sortWithinPartitions(ord)
    placed.select("value").write.mode("overwrite").text(path)
    return path
