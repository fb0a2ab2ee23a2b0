"""Queries of the operators for training data, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .components import match_groups
from .formatting_duplicates import formatting_duplicates
from .mixing import document_sizes, mixture
from .names import author_variants, same_entity_pairs
from .near_duplicates import near_duplicates
from .pii import find_items, redact
from .survivors import golden_records, survivor_fields
from .tokenizer import encode_documents

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of a reference that differ in title and DOI by formatting alone."""
    return formatting_duplicates(table(spark, d, "articles_ris")).filter("ord <> keep_ord").select("keep_ord", "ord")


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct reference, with its number of copies."""
    return formatting_duplicates(table(spark, d, "articles_ris")).filter("ord = keep_ord").select("keep_ord", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different spellings of one person or organisation."""
    return same_entity_pairs(author_variants(table(spark, d, "articles_ris")))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its frequency and the entity it belongs to."""
    return author_variants(table(spark, d, "articles_ris"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Group of every linked reference."""
    return match_groups(table(spark, d, "match_pairs"), table(spark, d, "articles_ris"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records of one publication."""
    return near_duplicates(table(spark, d, "articles_ris"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Record from which each field of a group survives."""
    return survivor_fields(table(spark, d, "articles_ris"), table(spark, d, "source_trust")).select("group_ord", "field", "from_ord")


def p6_golden(spark: SparkSession, d: str) -> DataFrame:
    """Surviving record of each group."""
    return golden_records(table(spark, d, "articles_ris"), table(spark, d, "source_trust"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(table(spark, d, "documents"))


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every document in the mixture."""
    return mixture(document_sizes(table(spark, d, "documents")).persist(), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by every source."""
    return mixture(document_sizes(table(spark, d, "documents")).persist(), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Items of personal information in every document."""
    return find_items(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with placeholders for its items."""
    return redact(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_copies": p2_copies,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_golden": p6_golden,
    "p7_ids": p7_ids,
    "p8_copies": p8_copies,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}



def _key(c: str) -> str:
    doi = rf"regexp_replace(nullif(regexp_extract(lower({c}), '10\.\d{{4,9}}/[^\s<>\[\]{{}}\"''“”«»]+'), ''), '[.,;:)\]>]+$', '')"
    return rf"coalesce(regexp_replace(lower(upper(replace(coalesce({doi}, {c}), 'ß', 'ss'))), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g'), '')"


_KEYED = f"""with k as (select ord, {_key("title")} as t, {_key("doi")} as d from articles_ris),
  g as (select ord, min(ord) over w as keep_ord, count(*) over w as copies from k window w as (partition by least(t, d), greatest(t, d)))"""

ORACLE: dict[str, str] = {
    "p2_found": f"{_KEYED} select keep_ord, ord from g where ord <> keep_ord",
    "p2_copies": f"{_KEYED} select keep_ord, copies from g where ord = keep_ord",
    "p4_found": """with recursive m as (select left_ord as a, right_ord as b from match_pairs where verdict = 'match' and left_ord <> right_ord
    and left_ord in (select ord from articles_ris) and right_ord in (select ord from articles_ris)),
  e as (select a, b from m union select b, a from m), r as (select a as ord, a as seen from e union select r.ord, e.b from r join e on e.a = r.seen)
  select ord, min(seen) as group_ord from r group by ord""",
}
