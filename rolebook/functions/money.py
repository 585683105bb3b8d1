"""Money and number scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolebook.functions.text import col_of


def plain_number(c) -> Column:
    """A DOUBLE as text the way a page shows it: ``15000``, ``12.5``."""
    d = col_of(c).cast("double")
    whole = d == F.floor(d)
    return F.when(whole, d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))


def _grouped(c: Column) -> Column:
    return F.call_function("format_number", c.cast("double"), F.lit("#,##0.###"))


def format_salary(low, high) -> Column:
    """Yearly range text; zero counts as missing, NULL when neither is stated."""
    lo, hi = (F.when(F.coalesce(col_of(c).cast("double"), F.lit(0.0)) != 0, col_of(c).cast("double")) for c in (low, high))
    year = F.lit(" / year")
    return (
        F.when(lo.isNotNull() & hi.isNotNull() & (lo == hi), F.concat(F.lit("$"), _grouped(lo), year))
        .when(lo.isNotNull() & hi.isNotNull(), F.concat(F.lit("$"), _grouped(lo), F.lit(" - $"), _grouped(hi), year))
        .when(lo.isNotNull(), F.concat(F.lit("From $"), _grouped(lo), year))
        .when(hi.isNotNull(), F.concat(F.lit("Up to $"), _grouped(hi), year))
    )


def format_salary_currency(low, high, currency) -> Column:
    """``CUR a–b`` or ``CUR a``; zero is a stated figure here."""
    lo, hi = plain_number(low), plain_number(high)
    cur = F.when(F.coalesce(col_of(currency), F.lit("")) != "", F.concat(col_of(currency), F.lit(" "))).otherwise("")
    both = F.concat(cur, lo, F.lit("–"), hi)
    return F.when(lo.isNotNull() & hi.isNotNull(), both).otherwise(F.concat(cur, F.coalesce(lo, hi)))


def parse_salary(c) -> Column:
    """First figure of a salary text, times 1000 when it speaks of "k"."""
    t = col_of(c)
    figure = F.replace(F.regexp_extract(t, r"[\d,]+", 0), F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.lower(t).contains("k"), figure * 1000).otherwise(figure)


def parse_locale_number(c) -> Column:
    """Number of a localised cell; a lone separator before three digits is ambiguous."""
    t = F.regexp_replace(col_of(c), r"^\s+|\s+$|[ \u00a0]", "")
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    last_is_comma = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    european = F.translate(F.translate(t, ".", ""), ",", ".")
    text = (
        F.when(comma & dot & last_is_comma, european)
        .when(comma & dot, F.translate(t, ",", ""))
        .when(t.rlike(r"^[+-]?\d+[.,]\d{3}$"), F.lit(None))
        .when(comma, F.translate(t, ",", "."))
        .otherwise(t)
    )
    return F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double"))


def half_up(c: Column, epsilon: float = 0.0) -> Column:
    """Round half toward +infinity, on DOUBLE."""
    return F.floor(c + F.lit(0.5 + epsilon)).cast("int")
