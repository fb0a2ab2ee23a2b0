"""BibTeX and PubMed (MEDLINE) files: splittable readers that give the same (ord, tags) as RIS, and a BibTeX writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import partitions
from .ris import MULTI, TAGS, numbered, read_ris, write_ris

# Fields of BibTeX and tags of PubMed, as RIS tags; kinds of BibTeX entries, as RIS types.
BIBTEX_TAGS = {"title": "TI", "author": "AU", "doi": "DO", "year": "PY", "journal": "JO", "abstract": "AB", "keywords": "KW", "note": "N1"}
BIBTEX_TYPES = {"article": "JOUR", "book": "BOOK", "inbook": "CHAP", "incollection": "CHAP", "inproceedings": "CONF", "phdthesis": "THES", "mastersthesis": "THES", "techreport": "RPRT"}
PUBMED_TAGS = {"TI": "TI", "FAU": "AU", "DP": "PY", "AB": "AB", "JT": "JO", "OT": "KW", "MH": "KW", "GN": "N1"}

_BRACED = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_FIELD = rf"(?s)([A-Za-z][\w-]*)\s*=\s*({_BRACED}|\"[^\"]*\"|[\w.+-]+)"
_PUBMED = r"(?m)^([A-Z]{2,4}) *- ?(.*(?:\n {4,}.*)*)"


def _split(path: str, spark: SparkSession, start: str) -> DataFrame:
    """Records that begin with ``start`` on a line of its own, split there: (value, file, name, block)."""
    raw = spark.read.option("lineSep", "\n" + start).text(path)
    value = F.ltrim(F.regexp_replace("value", "^\\x{FEFF}", ""), F.lit(" \t\r\n"))
    return raw.select(F.when(value.startswith(start), value).otherwise(F.concat(F.lit(start), value)).alias("value"), "_metadata")


def parse_bibtex(text: Column) -> Column:
    """Tags of one entry: fields with a RIS tag under it, others under their names; braces around words are left out."""
    kind = F.lower(F.regexp_extract(text, r"^@\s*(\w+)", 1))
    body = F.regexp_replace(text, r"\r\n?", "\n")
    names, values = F.regexp_extract_all(body, F.lit(_FIELD), F.lit(1)), F.regexp_extract_all(body, F.lit(_FIELD), F.lit(2))
    clean = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r'^"|"$|[{}]', ""), r"\s+", " "))
    tag = lambda n: F.coalesce(*[F.when(F.lower(n) == k, F.lit(t)) for k, t in BIBTEX_TAGS.items()], F.lower(n))
    parts = lambda n, v: F.when(F.lower(n) == "author", F.split(v, r"\s+and\s+")).when(F.lower(n) == "keywords", F.split(v, r"\s*[,;]\s*")).otherwise(F.array(v))
    rows = F.flatten(F.zip_with(names, values, lambda n, v: F.transform(parts(n, clean(v)), lambda x: F.struct(tag(n).alias("tag"), F.trim(x).alias("value")))))
    first = F.array(F.struct(F.lit("TY").alias("tag"), F.coalesce(*[F.when(kind == k, F.lit(t)) for k, t in BIBTEX_TYPES.items()], F.lit("GEN")).alias("value")))
    return F.concat(first, F.filter(rows, lambda p: p["value"] != "")).cast(TAGS)


def parse_pubmed(text: Column) -> Column:
    """Tags of one record: full author names before short ones, the DOI of identifiers, the year of the date."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    names, values = F.regexp_extract_all(unix, F.lit(_PUBMED), F.lit(1)), F.regexp_extract_all(unix, F.lit(_PUBMED), F.lit(2))
    full = F.array_contains(names, "FAU")
    flat = lambda v: F.trim(F.regexp_replace(v, r"\s*\n\s*", " "))
    doi = lambda v: F.regexp_extract(v, r"(\S+) \[doi\]", 1)

    def row(n: Column, v: Column) -> Column:
        named = n.isin("LID", "AID") & (doi(v) != "")
        tag = F.when(named, F.lit("DO")).when(~full & (n == "AU"), F.lit("AU")).when(n == "AU", F.lit("ER"))
        known = F.coalesce(tag, *[F.when(n == k, F.lit(t)) for k, t in PUBMED_TAGS.items()], n)
        return F.struct(known.alias("tag"), F.when(named, doi(v)).when(n == "DP", F.regexp_extract(v, r"\d{4}", 0)).otherwise(v).alias("value"))

    rows = F.zip_with(names, values, lambda n, v: row(n, flat(v)))
    first = F.array(F.struct(F.lit("TY").alias("tag"), F.lit("JOUR").alias("value")))
    return F.concat(first, F.filter(rows, lambda p: (p["tag"] != "ER") & (p["value"] != ""))).cast(TAGS)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(ord, tags) of every entry of BibTeX files, in the order of path and position; comments and strings give no row."""
    rec = _split(path, spark, "@").filter(F.col("value").rlike(r"^@\s*\w+\s*\{") & ~F.lower("value").rlike(r"^@\s*(comment|string|preamble)\b"))
    return numbered(rec).select("ord", parse_bibtex(F.col("value")).alias("tags"))


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """(ord, tags) of every record of PubMed files, in the order of path and position."""
    rec = _split(path, spark, "PMID").filter(F.col("value").rlike(r"^PMID *-"))
    return numbered(rec).select("ord", parse_pubmed(F.col("value")).alias("tags"))


def entry_text(ord: Column, author: Column, title: Column, doi: Column, year: Column, extra: Column) -> Column:
    """One BibTeX entry; null fields give no line, other fields of ``extra`` follow by name, their values joined by '; '."""
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s*[\r\n]+\s*", " "), r"[{}]", "")
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {name} = {{"), flat(c), F.lit("},")))
    kinds = {t: k for k, t in reversed(BIBTEX_TYPES.items())}
    kind = F.coalesce(*[F.when(F.get(extra["type"], F.lit(0)) == t, F.lit(k)) for t, k in kinds.items()], F.when(F.get(extra["type"], F.lit(0)).isNull(), F.lit("article")), F.lit("misc"))
    names = {"notes": "note"}
    rest = F.filter(F.array_sort(F.map_entries(extra)), lambda e: (e["key"] != "type") & (F.size(e["value"]) > 0))
    label = lambda k: F.regexp_replace(F.coalesce(*[F.when(k == a, F.lit(b)) for a, b in names.items()], k), r"[^\w-]+", "_")
    more = F.transform(rest, lambda e: F.concat(F.lit("  "), label(e["key"]), F.lit(" = {"), flat(F.array_join(e["value"], "; ")), F.lit("},")))
    authors = F.when(author.isNotNull(), F.array_join(F.split(author, MULTI), MULTI))
    head = F.concat(F.lit("@"), kind, F.lit("{ref"), ord.cast("string"), F.lit(","))
    return F.concat_ws("\n", head, line("title", title), line("author", authors), line("doi", doi), line("year", year), F.when(F.size(more) > 0, F.array_join(more, "\n")), F.lit("}"), F.lit(""))


def write_bibtex(table: DataFrame, path: str, ord: str = "ord", files: int | None = None) -> str:
    """Write entries in the order of ``ord`` and return the path; ``files=1`` gives one file, else range-split parts."""
    extra = F.col("extra") if "extra" in table.columns else F.lit(None).cast("map<string,array<string>>")
    lines = table.select(ord, entry_text(F.col(ord), F.col("author"), F.col("title"), F.col("doi"), F.col("year"), extra).alias("value"))
    placed = lines.coalesce(1) if files == 1 else lines.repartitionByRange(files or partitions(table.sparkSession), ord)
    placed.sortWithinPartitions(ord).select("value").write.mode("overwrite").text(path)
    return path


READERS = {"ris": read_ris, "bib": read_bibtex, "bibtex": read_bibtex, "nbib": read_pubmed, "pubmed": read_pubmed}
WRITERS = {"ris": write_ris, "bib": write_bibtex, "bibtex": write_bibtex}


def read_references(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """(ord, tags) of a file in the named format, else in that of its ending (RIS where it tells none)."""
    return READERS.get((format or path.rstrip("/").rpartition(".")[2]).lower(), read_ris)(spark, path)


def write_references(table: DataFrame, path: str, format: str | None = None, files: int | None = None) -> str:
    """Write a table in the named format, else in that of the path's ending (RIS where it tells none)."""
    return WRITERS.get((format or path.rstrip("/").rpartition(".")[2]).lower(), write_ris)(table, path, files=files)
