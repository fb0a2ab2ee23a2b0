"""Canonical forms of titles and DOIs shared by the duplicate operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bare, doi_key, present


def field_key(c: Column) -> Column:
    """A title or DOI without white space, case, punctuation, DOI label and resolver; '' where nothing is left."""
    return F.coalesce(bare(F.coalesce(doi_key(c), c)), F.lit(""))


def pair_key(title: Column, doi: Column) -> Column:
    """Canonical text of a title and a DOI in either order; missing equals missing."""
    a, b = field_key(present(title)), field_key(present(doi))
    return F.concat(F.least(a, b), F.lit(" "), F.greatest(a, b))
