"""Company-name scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.text import col_of


def _without_noise(name: Column) -> Column:
    out = F.lower(name)
    for pattern in vocab.COMPANY_NOISE:
        out = F.regexp_replace(out, pattern, "")
    return out


def company_key(c) -> Column:
    """Name without legal suffixes, reduced to ``[a-z0-9]``."""
    return F.regexp_replace(_without_noise(F.trim(col_of(c))), "[^a-z0-9]", "")


def core_words(c) -> Column:
    """Distinct words of two or more characters after suffix removal."""
    return F.array_distinct(F.regexp_extract_all(_without_noise(col_of(c)), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def anglicize(c) -> Column:
    out = F.lower(col_of(c))
    for special, plain in vocab.SPELLING:
        out = F.replace(out, F.lit(special), F.lit(plain))
    return out
