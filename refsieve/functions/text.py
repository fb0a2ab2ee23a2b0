"""Text expressions: missing values, DOI and title canonical forms (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A DOI anywhere in a value; formatting around it (label, resolver, brackets, final stop) is left out.
DOI_RE = r"(?i)10\.\d{4,9}/[^\s<>\[\]{}\"'“”«»]+"

#: White space of any kind, with the no-break and zero-width characters.
BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200E))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def present(c: Column) -> Column:
    """The trimmed value; null where it is null or blank."""
    t = trimmed(c)
    return F.when(t != "", t)


def doi_key(c: Column) -> Column:
    """The DOI inside a value in lower case, without label, resolver or enclosing marks; null if there is none."""
    raw = F.regexp_extract(F.lower(c), DOI_RE, 0)
    bare = F.rtrim(raw, F.lit(".,;:)]>"))
    return F.when(bare != "", bare)


def bare(c: Column) -> Column:
    """Letters and digits only, case folded (the sharp s equals ss): white space, case and punctuation are disregarded."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}\p{M}]+", "")
