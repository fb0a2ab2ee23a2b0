"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows, every normalised value collects the votes of its records, the value of the largest sum
wins by ``max_by`` and the winners are pivoted back. A vote is the record's trust weight times its recency decay, both
powers of two, measured from the strongest record that has a complete value of the field in the group (whose vote is 1,
so that no sum of interest underflows). With the default half-life, below the resolution of timestamps, copies of older
or less trusted records never outvote a newer or more trusted one; a longer half-life lets them.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare, doi_key, present
from ..runtime import cut, join_checked, join_hot
from .names import edits

FIELDS = ("author", "doi", "title", "year")
#: Microseconds in which a vote halves, and age in microseconds that a step of trust outweighs.
HALF_LIFE_US, TRUST_US = 1 / 40, 1e18
#: A title may be cut off if a title of its group that is longer than by this share starts with it, up to this share of typos.
CUT_SHARE, TYPO_SHARE = 0.9, 0.2
#: Letters by which a title finds longer titles of its group that start alike.
HEAD = 8

# Marks of cut-off values; words that small edits add, leave out or exchange.
CUT_TITLE = r"(?i)(\.{3}|…|\[\s*(truncated|\.{3}|…)\s*\])[\s\"'”’»\]]*$"
CUT_AUTHOR = r"(?i)(^|[\s,;&|/\"\[(])(et\.?\s+al(ii|ia)?\.?|(and|&)\s+(others|colleagues|coworkers)|u\.\s?a\.|\.{3}|…)[\s\"'\])”.;,]*$"
YEAR = r"(?<!\d)(\d{4})(?!\d)"
LIGHT = set(
    "the a an and of in on from with within among amongst during throughout to for by at as is are it its up post pre under between across role function study investigation "
    "model modelling modeling modelo effect effects impact impacts new early recent brief possible potential overall self reported selfreported adult "
    "und der die das den dem des ein eine einer bei auf mit aus zu im von et le la les l de du d un une chez au aux sur dans en entre auprès y e el los las una del con sobre".split()
)


def title_words(c: Column) -> Column:
    """Lower-case words of a title, joined by single blanks."""
    plain = F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "&", " and ")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}]+", " "))


def year_of(c: Column) -> Column:
    """The four-digit year inside a value; null if it has none."""
    y = F.regexp_extract(c, YEAR, 1)
    return F.when(y != "", y.cast("int"))


def authors_cut(c: Column) -> Column:
    """Whether further authors stay unnamed."""
    return c.rlike(CUT_AUTHOR)


def title_marked_cut(c: Column) -> Column:
    """Whether a title ends with a mark of omission."""
    return c.rlike(CUT_TITLE)


def _started(solid: Column, longer: Column) -> Column:
    size = F.length(solid)
    near = F.levenshtein(F.substring(longer, F.lit(1), size), solid) <= TYPO_SHARE * size
    return F.coalesce((size < CUT_SHARE * F.length(longer)) & near, F.lit(False))


@lru_cache(maxsize=200_000)
def word_edits(x: str, y: str, most: int) -> int:
    return edits(x, y, most)


def _typos(size: int) -> int:
    return 3 if size >= 8 else 2 if size >= 4 else 1 if size >= 3 else 0


def _filler(x: str) -> bool:
    return x in LIGHT or len(x) < 3 or len(x) >= 5 and not x.endswith("s") and any(len(w) >= 5 and word_edits(x, w, 1) <= 1 for w in LIGHT)


def lacks_tail(short: list[str], longer: list[str]) -> bool:
    """Whether words at the end of the longer title are what the shorter one lacks.

    That is, the longer title's last word with a meaning stands nowhere in the shorter title, or only its first letters
    end it, and the shorter title ends with a word, or the start of one, of the longer title. Words that were added to a
    whole title, moved or misspelt leave it its ending.
    """
    said = [w for w in longer if not _filler(w)]
    if not short or not said:
        return False
    tail, end = said[-1], short[-1]
    if tail != end and tail.startswith(end) and len(tail) - len(end) >= 2:
        return True
    if not any(w.startswith(end) or word_edits(end, w[: len(end)], _typos(len(end))) <= _typos(len(end)) or word_edits(end, w, _typos(len(end))) <= _typos(len(end)) for w in longer):
        return False
    if len(tail) >= 4 and "".join(short).count(tail) >= "".join(longer).count(tail):  # also written as one word with another
        return False
    left, lacking = list((Counter(short) - Counter(longer)).elements()), Counter(longer) - Counter(short)
    for x in said:  # misspelt words, first to last
        if lacking[x] > 0:
            most = _typos(max(4, len(x)))
            y = min(left, key=lambda y: word_edits(x, y, most), default=None)  # noqa: B023
            if y is not None and word_edits(x, y, most) <= most:
                left.remove(y)
                lacking[x] -= 1
    return lacking[tail] > 0


def _lacks_tail(short: pa.Array, longer: pa.Array) -> pa.Array:
    return pa.array([bool(x and y) and lacks_tail(x.split(), y.split()) for x, y in zip(short.to_pylist(), longer.to_pylist(), strict=True)], pa.bool_())


def with_cut_titles(rows: DataFrame, group: str, words: str, flag: str) -> DataFrame:
    """Add ``flag``: whether a longer title of the row's group goes on where its title ends (``words``: as of ``title_words``).

    A title is held against the longest of its group and the longest of its group that starts with the same letters, so
    that works sharing a DOI don't hide each other's whole titles. Null groups and titles are not flagged.
    """
    solid = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    size = F.length(solid(words))
    key = F.concat(F.col(group), F.lit("|"), F.substring(solid(words), 1, HEAD))
    keyed = rows.withColumn("__alike", key)
    whole = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.max_by(words, size).alias("__longest"))
    alike = keyed.filter("__alike is not null").groupBy("__alike").agg(F.max_by(words, size).alias("__longer"))
    out = join_hot(join_hot(keyed, whole, group, "left"), alike, "__alike", "left")
    for c in ("__longest", "__longer"):  # only titles that start a longer one go to Python
        out = out.withColumn(c, F.when(_started(solid(words), solid(c)), F.col(c)))
    lacks = F.arrow_udf(_lacks_tail, "boolean")
    cut_off = [lacks(F.when(F.col(c).isNotNull(), F.col(words)), F.col(c)) for c in ("__longest", "__longer")]
    return out.withColumn(flag, cut_off[0] | cut_off[1]).drop("__alike", "__longest", "__longer")


def survivor_fields(articles: DataFrame, trust: DataFrame, half_life_us: float = HALF_LIFE_US) -> DataFrame:
    """(group_ord, field, from_ord, value): the surviving value of each field of each group of records sharing a DOI.

    Needs ord, doi, title, author, year, source_db, exported_at; other columns are ignored. Records whose doi field
    holds no DOI belong to no group. A field without a complete value has no row; unknown sources have trust 0; null
    timestamps count as the oldest. The record of a value is its strongest one, of equals the one of the smallest ord;
    equal sums of votes are settled likewise. Groups of any size are combined map-side, hot ones joined by broadcast.
    """
    t = trust.groupBy("source_db").agg(F.max("trust").cast("double").alias("__trust"))
    rows = articles.select("ord", *FIELDS, "source_db", "exported_at", doi_key(F.col("doi")).alias("__doi")).filter(F.col("__doi").isNotNull())
    rows = cut(rows.withColumn("__solid", bare(F.col("title"))).withColumn("__words", title_words(F.col("title"))))
    groups = rows.groupBy("__doi").agg(F.min("ord").alias("group_ord"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    rows = with_cut_titles(join_hot(rows, groups, "__doi", "inner"), "__doi", "__words", "__cut")
    rows = join_checked(rows, t, "source_db").withColumn("__trust", F.coalesce("__trust", F.lit(0.0)))
    whole = {
        "author": present(F.col("author")).isNotNull() & ~authors_cut(F.col("author")),
        "doi": F.lit(True),
        "title": present(F.col("title")).isNotNull() & ~title_marked_cut(F.col("title")) & ~F.col("__cut") & doi_key(F.col("title")).isNull(),
        "year": year_of(F.col("year")).isNotNull(),
    }
    norm = {"author": bare(F.col("author")), "doi": F.col("__doi"), "title": F.col("__solid"), "year": year_of(F.col("year")).cast("string")}
    at = F.coalesce(F.unix_micros(F.col("exported_at").cast("timestamp")), F.lit(-(2**61)))
    strength = F.struct(F.col("__trust").alias("trust"), at.alias("at"))
    whole = {f: F.coalesce(w, F.lit(False)) for f, w in whole.items()}
    rows = cut(rows.select("group_ord", "ord", strength.alias("__s"), F.array(*[F.when(whole[f], F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), norm[f].alias("norm"))) for f in FIELDS]).alias("__f")))
    top = rows.groupBy("group_ord").agg(*[F.max(F.when(F.col("__f")[k].isNotNull(), F.col("__s"))).alias(f"__top{k}") for k in range(len(FIELDS))])
    rows = join_hot(rows, top, "group_ord", "inner")
    long = rows.select("group_ord", "ord", "__s", F.inline(F.filter(F.arrays_zip("__f", F.array(*[F.col(f"__top{k}") for k in range(len(FIELDS))]).alias("__top")), lambda x: x["__f"].isNotNull())).alias("c", "t"))
    behind = (F.col("t.trust") - F.col("__s.trust")) * TRUST_US + (F.col("t.at") - F.col("__s.at"))
    vote = F.pow(F.lit(2.0), -behind / half_life_us)
    best = F.struct(F.col("__s.trust").alias("trust"), F.col("__s.at").alias("at"), (-F.col("ord")).alias("back"))
    votes = long.groupBy("group_ord", F.col("c.field").alias("field"), F.col("c.norm").alias("norm")).agg(F.sum(vote).alias("votes"), F.max(best).alias("best"), F.max_by(F.col("c.value"), best).alias("value"))
    won = votes.groupBy("group_ord", "field").agg(F.max_by(F.struct((-F.col("best.back")).alias("from_ord"), "value"), F.struct("votes", "best")).alias("w"))
    return won.select("group_ord", "field", F.col("w.from_ord").alias("from_ord"), F.col("w.value").alias("value"))


def golden_records(articles: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_ord, author, doi, title, year): the surviving values of each group in one row."""
    return survivor_fields(articles, trust).groupBy("group_ord").pivot("field", list(FIELDS)).agg(F.first("value"))
