"""Queries of the core operators, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import FLAG_DOI, FLAG_TITLE, arrange, dedup, duplicate_flags, fold, split_duplicates
from ..operators.embed import hashing_embedding
from ..operators.packed import author_names
from ..operators.vectors import cosine_to_queries, joined, joined_similarity, triple_similarity, zip_pairs, zip_similarity
from ..runtime import checkpoint_dir
from ..sources.ris import MULTI, parse_record, read_ris, ris_lines, to_table, write_ris
from ..sources.tables import EXCERPT, meta_paths, meta_time, read_excerpts, table, write_csv

Query = Callable[[SparkSession, str], DataFrame]
BIB = ("ord", "doi", "title", "author", "year")

# The interpretations that are compared.
MC = [
    "Stress adversely affects mental health through emotional responses, leading to maladaptive coping strategies like substance use and social media engagement.",
    "Resilience acts as a protective buffer against stress, enabling active coping strategies and adaptation through personal attributes, ultimately fostering psychological well-being amid challenges.",
]
HC1 = [
    "Stressful life events decompensate psychological resources and cause a long-lasting mental health impact, which in turn incite reward-seeking behavior",
    "An adequate resource is necessary to circumvent stressful life event and develop resilience",
]
HC2 = (
    "Resilience plays a crucial role in mental health dynamics by acting as an adaptive function and coping mechanism that moderates the long-lasting impact of stress-induced strain and reward-seeking behavior, "
    "facilitating self-regulation, resource management, and the process of overcoming stress to enhance well-being and contribute to successful aging."
)


def _extra_text(c: Column) -> Column:
    """A map of lists as one text, in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")


def _bib(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles_ris").select(*BIB, "source_db", _extra_text(F.col("extra")).alias("extra"))


def _interpretations(spark: SparkSession) -> DataFrame:
    """The literal table of interpretations: one row."""
    return spark.createDataFrame([(MC, HC1, [HC2])], "mc array<string>, hc1 array<string>, hc2 array<string>")


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def find_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """Both masks of every record."""
    return duplicate_flags(_bib(spark, d)).select("ord", F.col(FLAG_DOI).alias("dup_doi"), F.col(FLAG_TITLE).alias("dup_title"))


def dedup_query(get_dup: bool, conserve: bool) -> Query:
    """Rows kept or removed, in either mode, in sorted order."""
    return lambda spark, d: dedup(_bib(spark, d), get_dup, conserve)


def keep_dup_partition(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both outputs together, from flags computed once."""
    kept, removed = split_duplicates(_bib(spark, d))
    return kept.select("ord", F.lit("keep").alias("part")).unionByName(removed.select("ord", F.lit("dup").alias("part")))


def arrange_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of each record in the global sort: offsets of range partitions plus the place within each."""
    placed = arrange(_bib(spark, d)).withColumn("__part", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id()).persist()
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__mid").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    offsets = parts.withColumn("before", before)
    return placed.join(F.broadcast(offsets), "__part").select("ord", (F.col("before") + F.col("__mid") - F.col("first") + 1).cast("bigint").alias("rank"))


def upper_fold(spark: SparkSession, d: str) -> DataFrame:
    """Folded title and author."""
    return _bib(spark, d).select("ord", fold(F.col("title")).alias("title"), fold(F.col("author")).alias("author"))


def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of every hundredth vector with all, itself included."""
    return cosine_to_queries(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, diagonal=True).withColumn("sim", F.round("sim", 9))


def vector_triples(spark: SparkSession, d: str) -> DataFrame:
    """Similarities within consecutive triples of vectors, by position."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("k"), (F.col("vec_id") % 3).alias("m"), "embedding")
    t = e.groupBy("k").agg(*[F.max_by("embedding", F.when(F.col("m") == i, F.lit(1))).alias(c) for i, c in enumerate(("mc", "hc1", "hc2"))])
    t = t.filter("mc is not null and hc1 is not null and hc2 is not null")
    return triple_similarity(t, F.col("mc"), F.col("hc1"), F.col("hc2"), ["k"])


def triple_text_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of the three texts of each coding excerpt; null where a text is null."""
    e = table(spark, d, "coding_excerpt").select("ord", *[hashing_embedding(F.col(c)).alias(c) for c in ("mc", "hc1", "hc2")])
    return triple_similarity(e, F.col("mc"), F.col("hc1"), F.col("hc2"), ["ord"])


def interpretation_literals(spark: SparkSession, d: str) -> DataFrame:
    """The interpretations as rows: side, place, text."""
    rows = [F.struct(F.lit(n).alias("side"), F.col(n).alias("texts")) for n in ("mc", "hc1", "hc2")]
    long = _interpretations(spark).select(F.inline(F.array(*rows)))
    return long.select("side", F.posexplode("texts").alias("pos", "text")).select("side", F.col("pos").cast("bigint").alias("pos"), "text")


def interpretation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the interpretations of two sides, pair by pair."""
    return zip_similarity(_interpretations(spark), [], "mc", "hc1", hashing_embedding).select(F.col("pos").cast("bigint").alias("pos"), "sim")


def interpretations(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every two sides of the interpretations, each run together."""
    return joined_similarity(_interpretations(spark), [], {n: F.col(n) for n in ("mc", "hc1", "hc2")}, hashing_embedding)


def joined_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every two texts of each excerpt with the third one run together behind both."""
    e = table(spark, d, "coding_excerpt")
    return joined_similarity(e, ["ord"], {"mc": F.array("mc", "hc2"), "hc1": F.array("hc1", "hc2"), "hc2": F.array("hc2")}, hashing_embedding)


def zip_word_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the sentences of the first two texts of each excerpt, pair by pair."""
    e = table(spark, d, "coding_excerpt").select("ord", F.split("mc", r"\. ").alias("a"), F.split("hc1", r"\. ").alias("b"))
    return zip_similarity(e, ["ord"], "a", "b", hashing_embedding).select("ord", F.col("pos").cast("bigint").alias("pos"), "sim")


def zip_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Words of the first two texts of each excerpt paired by position, cut to the shorter text."""
    e = table(spark, d, "coding_excerpt").select("ord", F.split("mc", " ").alias("a"), F.split("hc1", " ").alias("b"))
    return zip_pairs(e, ["ord"], "a", "b").select("ord", F.col("pos").cast("bigint").alias("pos"), "a", "b")


def joined_text(spark: SparkSession, d: str) -> DataFrame:
    """The three texts of each excerpt run together."""
    return table(spark, d, "coding_excerpt").select("ord", joined(F.array("mc", "hc1", "hc2")).alias("text"))


def _ris_columns(t: DataFrame) -> DataFrame:
    return t.withColumn("extra", _extra_text(F.col("extra")))


def ris_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the raw tags, those without a column of their own in ``extra``."""
    return _ris_columns(to_table(table(spark, d, "ris_records")))


def ris_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """References with all their fields written as RIS text and parsed again, record by record."""
    return _ris_columns(to_table(ris_lines(table(spark, d, "articles_ris")).select("ord", parse_record(F.col("value")).alias("tags"))))


def ris_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """References with all their fields written to RIS files and read back."""
    path = write_ris(table(spark, d, "articles_ris"), _scratch(spark))
    return _ris_columns(to_table(read_ris(spark, path))).drop("ord")


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts written to a CSV file and read back; empty cells come back as null."""
    path = write_csv(table(spark, d, "coding_excerpt").select("ord", "mc", "hc1", "hc2"), _scratch(spark), keep_ord=True)
    return read_excerpts(spark, path, f"ord bigint, {EXCERPT}")


def content_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Content hash and size of every document."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.length("text").cast("bigint").alias("n"))


def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Run metadata with time, size and paths parsed."""
    m = table(spark, d, "run_meta")
    return m.select("name", "type", F.unix_micros(meta_time(F.col("time"))).alias("time_us"), F.col("bytes").cast("bigint").alias("bytes"), F.size(F.coalesce(meta_paths(F.col("path")), F.array())).cast("bigint").alias("n_paths"), F.col("seconds").cast("double").alias("seconds"))


def run_outdated(spark: SparkSession, d: str) -> DataFrame:
    """Latest successful run of each command and dependency: what a manifest lookup finds."""
    m = table(spark, d, "run_meta").filter("type = 'stem'").withColumn("t", F.unix_micros(meta_time(F.col("time"))))
    g = m.groupBy("name", "command", "depend").agg(F.count("*").alias("runs"), F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("good"), F.max(F.when(F.col("error").isNull(), F.col("t"))).alias("last_us"))
    return g.select("name", "command", "depend", "runs", "good", "last_us")


def article_index(spark: SparkSession, d: str) -> DataFrame:
    """Number and slug of article files, from their paths."""
    f = table(spark, d, "article_files")
    return f.select("article_no", F.regexp_extract("path", r"/(\d+)-[^/]*\.md$", 1).alias("no_text"), F.regexp_extract("path", r"/\d+-([^/]*)\.md$", 1).alias("slug_text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Single authors of every author field."""
    return author_names(table(spark, d, "articles_ris"))


QUERIES: dict[str, Query] = {
    "find_duplicate": find_duplicate,
    "dedup_keep_or": dedup_query(False, False),
    "dedup_dup_or": dedup_query(True, False),
    "dedup_keep_and": dedup_query(False, True),
    "dedup_dup_and": dedup_query(True, True),
    "keep_dup_partition": keep_dup_partition,
    "arrange_doi_author_year": arrange_rank,
    "upper_fold": upper_fold,
    "similarity_matrix": similarity_matrix,
    "vector_triples": vector_triples,
    "triple_similarity": triple_text_similarity,
    "zip_pairs": zip_excerpts,
    "joined_text": joined_text,
    "interpretation_literals": interpretation_literals,
    "interpretation_pairs": interpretation_pairs,
    "interpretations": interpretations,
    "joined_similarity": joined_excerpts,
    "zip_similarity": zip_word_similarity,
    "ris_fields": ris_fields,
    "ris_roundtrip": ris_roundtrip,
    "ris_file_roundtrip": ris_file_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "content_manifest": content_manifest,
    "run_manifest": run_manifest,
    "run_outdated": run_outdated,
    "article_index": article_index,
    "p1_found": p1_found,
}

_UP = "upper(replace({0}, 'ß', 'SS'))"
_EXTRA = "array_to_string(list_transform(list_sort(map_entries(extra)), lambda e: e.key || '=' || array_to_string(e.value, '|')), ';')"
_FLAGS = f"""with f as (select ord, doi, title, author, year, source_db, {_EXTRA} as extra,
  ord > min(ord) over (partition by {_UP.format("doi")}) as dup_doi,
  ord > min(ord) over (partition by {_UP.format("title")}) as dup_title from articles_ris)"""
_ROWS = "select ord, doi, title, author, year, source_db, extra from f where"
_FLAT = r"trim(regexp_replace({0}, '\s*[\r\n]+\s*', ' ', 'g'), ' ')"
_AUTHORS = f"array_to_string(list_transform(string_split({_FLAT.format('author')}, '{MULTI}'), lambda x: trim(x, ' ')), '{MULTI}')"
_TYPED = """array_to_string(list_transform(list_sort(list_concat(coalesce(map_entries(extra), []), case when extra is null or not list_contains(map_keys(extra), 'type')
  then [{'key': 'type', 'value': ['JOUR']}] else [] end)), lambda e: e.key || '=' || array_to_string(e.value, '|')), ';')"""
_WRITTEN = f"{_FLAT.format('doi')} as doi, {_FLAT.format('title')} as title, {_AUTHORS} as author, {_FLAT.format('year')} as year, {_TYPED} as extra from articles_ris"
_GRAMS = "list_transform(range(1, length({0}) - 1), lambda i: (unicode(substr({0}, i, 1)) * 31 + unicode(substr({0}, i + 1, 1)) * 7 + unicode(substr({0}, i + 2, 1))) % 64)"
_FIRST = "list_filter(tags, lambda t: t.tag = '{0}')[1].value"


def _all(*tags: str) -> str:
    keep = " or ".join(f"t.tag = '{t}'" for t in tags)
    v = f"list_transform(list_filter(tags, lambda t: ({keep}) and t.value is not null), lambda t: t.value)"
    return f"case when len({v}) > 0 then array_to_string({v}, '{MULTI}') end"


def _vector(text: str, name: str) -> str:
    """SQL of the hashing embedder: the column ``name`` and whether its text is null."""
    grams = _GRAMS.format(f"lower(coalesce({text}, ''))")
    return f"list_transform(range(64), lambda d: len(list_filter({grams}, lambda g: g = d))::double) as {name}, ({text}) is null as {name}_no"


def _cosine(a: str, b: str) -> str:
    """SQL of the cosine of two count vectors; 0 for an empty one."""
    return f"case when {a}_no or {b}_no then null when list_sum({a}) = 0 or list_sum({b}) = 0 then 0.0 else list_cosine_similarity({a}, {b}) end"


def _quoted(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


_TRIPLES = [("mc", "hc1"), ("mc", "hc2"), ("hc1", "hc2")]
_LITERALS = f"select {_quoted(MC)} as mc, {_quoted(HC1)} as hc1, {_quoted([HC2])} as hc2"
_LITERAL_VECTORS = f"with t as (select array_to_string(mc, '') as mc, array_to_string(hc1, '') as hc1, array_to_string(hc2, '') as hc2 from ({_LITERALS})), v as (select {', '.join(_vector(c, c) for c in ('mc', 'hc1', 'hc2'))} from t)"

_LABEL = "case when t.tag in ('AB', 'N2') then 'abstract' when t.tag in ('JO', 'T2', 'JF') then 'journal' when t.tag = 'KW' then 'keywords' when t.tag = 'N1' then 'notes' when t.tag = 'TY' then 'type' else t.tag end"
_KEPT = f"list_transform(list_filter(tags, lambda t: t.tag not in ('TI', 'T1', 'DO', 'AU', 'A1', 'PY', 'Y1', 'ER') and t.value is not null), lambda t: {{'label': {_LABEL}, 'value': t.value}})"
_REST = f"array_to_string(list_transform(list_sort(list_distinct(list_transform({_KEPT}, lambda x: x.label))), lambda n: n || '=' || array_to_string(list_transform(list_filter({_KEPT}, lambda x: x.label = n), lambda x: x.value), '|')), ';')"

ORACLE: dict[str, str] = {
    "find_duplicate": f"{_FLAGS} select ord, dup_doi, dup_title from f",
    "dedup_keep_or": f"{_FLAGS} {_ROWS} not (dup_doi or dup_title)",
    "dedup_dup_or": f"{_FLAGS} {_ROWS} dup_doi or dup_title",
    "dedup_keep_and": f"{_FLAGS} {_ROWS} not (dup_doi and dup_title)",
    "dedup_dup_and": f"{_FLAGS} {_ROWS} dup_doi and dup_title",
    "keep_dup_partition": f"{_FLAGS} select ord, case when dup_doi or dup_title then 'dup' else 'keep' end as part from f",
    "arrange_doi_author_year": "select ord, row_number() over (order by doi nulls last, author nulls last, year nulls last, ord) as rank from articles_ris",
    "upper_fold": f"select ord, {_UP.format('title')} as title, {_UP.format('author')} as author from articles_ris",
    "similarity_matrix": "select a.vec_id as i, b.vec_id as j, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as sim from embeddings a, embeddings b where a.vec_id % 100 = 0",
    "vector_triples": """select a.vec_id // 3 as k, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as MC_HC1,
  list_cosine_similarity(a.embedding::double[], c.embedding::double[]) as MC_HC2, list_cosine_similarity(b.embedding::double[], c.embedding::double[]) as HC1_HC2
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join embeddings c on c.vec_id = a.vec_id + 2 where a.vec_id % 3 = 0""",
    "zip_pairs": """with s as (select ord, string_split(mc, ' ') a, string_split(hc1, ' ') b from coding_excerpt where mc is not null and hc1 is not null)
  select ord, i - 1 as pos, a[i] as a, b[i] as b from (select ord, a, b, unnest(range(1, least(len(a), len(b)) + 1)) as i from s)""",
    "joined_text": "select ord, coalesce(mc, '') || coalesce(hc1, '') || coalesce(hc2, '') as text from coding_excerpt",
    "triple_similarity": f"with v as (select ord, {', '.join(_vector(c, c) for c in ('mc', 'hc1', 'hc2'))} from coding_excerpt) select ord, " + ", ".join(f"{_cosine(a, b)} as {a.upper()}_{b.upper()}" for a, b in _TRIPLES) + " from v",
    "interpretation_literals": f"with l as ({_LITERALS}) " + " union all ".join(f"select '{c}' as side, i - 1 as pos, {c}[i] as text from (select {c}, unnest(range(1, len({c}) + 1)) as i from l)" for c in ("mc", "hc1", "hc2")),
    "interpretation_pairs": f"with l as (select mc[i] as a, hc1[i] as b, i from ({_LITERALS}), (select unnest([1, 2]) as i)), v as (select i, {_vector('a', 'a')}, {_vector('b', 'b')} from l) select i::bigint - 1 as pos, {_cosine('a', 'b')} as sim from v",
    "interpretations": _LITERAL_VECTORS + " union all ".join(f" select '{a}' as \"left\", '{b}' as \"right\", {_cosine(a, b)} as sim from v" for a, b in _TRIPLES),
    "joined_similarity": f"with v as (select ord, {_vector("coalesce(mc, '') || coalesce(hc2, '')", "mc")}, {_vector("coalesce(hc1, '') || coalesce(hc2, '')", "hc1")}, {_vector("coalesce(hc2, '')", "hc2")} from coding_excerpt)"
    + " union all ".join(f" select ord, '{a}' as \"left\", '{b}' as \"right\", {_cosine(a, b)} as sim from v" for a, b in _TRIPLES),
    "zip_similarity": f"""with s as (select ord, string_split(mc, '. ') a, string_split(hc1, '. ') b from coding_excerpt where mc is not null and hc1 is not null),
  p as (select ord, i - 1 as pos, a[i] as a, b[i] as b from (select ord, a, b, unnest(range(1, least(len(a), len(b)) + 1)) as i from s)),
  v as (select ord, pos, {_vector('a', 'a')}, {_vector('b', 'b')} from p) select ord, pos, {_cosine('a', 'b')} as sim from v""",
    "ris_fields": f"select ord, {_REST} as extra, {_FIRST.format('DO')} as doi, coalesce({_FIRST.format('TI')}, {_FIRST.format('T1')}) as title, {_all('AU', 'A1')} as author, coalesce({_FIRST.format('PY')}, {_FIRST.format('Y1')}) as year from ris_records",
    "ris_roundtrip": f"select ord, {_WRITTEN}",
    "ris_file_roundtrip": f"select {_WRITTEN}",
    "content_manifest": "select doc_id, sha256(text) as sha256, length(text) as n from documents",
    "csv_roundtrip": "select ord, nullif(mc, '') as mc, nullif(hc1, '') as hc1, nullif(hc2, '') as hc2 from coding_excerpt",
    "run_manifest": r"""select name, type, round(nullif(regexp_extract(time, '^t([0-9.]+)s$', 1), '')::double * 86400e6)::bigint as time_us, bytes::bigint as bytes,
  case when path is null then 0 else len(string_split(path, '*')) end as n_paths, seconds::double as seconds from run_meta""",
    "run_outdated": r"""select name, command, depend, count(*) as runs, sum(case when error is null then 1 else 0 end)::bigint as good,
  max(case when error is null then round(nullif(regexp_extract(time, '^t([0-9.]+)s$', 1), '')::double * 86400e6)::bigint end) as last_us from run_meta where type = 'stem' group by all""",
    "article_index": r"select article_no, regexp_extract(path, '/(\d+)-[^/]*\.md$', 1) as no_text, regexp_extract(path, '/\d+-([^/]*)\.md$', 1) as slug_text from article_files",
}
