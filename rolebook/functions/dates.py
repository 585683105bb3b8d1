"""Date scalars. Each returns NULL rather than guessing a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolebook.functions.text import col_of, let


def as_of_col(as_of) -> Column:
    """A DATE column from a Column, a ``date`` or an ISO string."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def _to_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def iso_date(c) -> Column:
    """Leading ISO date of a text, else NULL."""
    head = F.substring(col_of(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), _to_date(head))


def strict_iso(c) -> Column:
    """Date of a text that is exactly one ISO date; "ASAP" and the like are NULL."""
    t = F.trim(col_of(c))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), _to_date(t))


# fixed values: accepted spellings (shape -> pattern)
_SPELLINGS = (
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "d MMM yyyy HH:mm:ss Z"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$", "d MMM yyyy HH:mm:ss"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
)


def lenient_date(c) -> Column:
    """ISO datetimes, RFC-822 dates and month-name dates, read as UTC.

    Each pattern is tried only on texts of its shape: a failed parse costs an
    exception inside the JVM.
    """
    def read(t):
        bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3,9},\s+", ""), r"\s(?:GMT|UTC|Z)$", " +0000")
        out = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp").cast("date"))
        for shape, pattern in _SPELLINGS:
            out = out.when(bare.rlike(shape), _to_date(bare, pattern))
        return out

    return let(F.trim(col_of(c)), read)


def relative_date(c, as_of) -> Column:
    """"Posted 5 Days Ago" counted back from ``as_of``; ISO dates pass."""
    t = col_of(c)
    days = F.regexp_extract(t, r"(?i)(\d+)\s+day", 1).try_cast("int")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), iso_date(t)).when(
        days.isNotNull(), F.date_sub(as_of_col(as_of), days)
    )


def epoch_date(c, unit: str = "s") -> Column:
    """UTC date of epoch seconds (``s``) or milliseconds (``ms``)."""
    n = col_of(c).try_cast("double")
    seconds = n / F.lit(1000.0) if unit == "ms" else n
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86400.0)).cast("int"))


def epoch_or_iso_date(text) -> Column:
    """A feed date that is either unix seconds or an ISO text."""
    t = col_of(text)
    return F.when(t.rlike(r"^-?\d+(?:\.\d+)?$"), epoch_date(t)).otherwise(iso_date(t))


def age_days(posted, as_of) -> Column:
    """Whole days from posting to ``as_of``: NULL stays NULL, future is negative."""
    return F.datediff(as_of_col(as_of), col_of(posted))


def is_stale(posted, max_age_days, as_of, flag_undated: bool = True) -> Column:
    return F.coalesce(age_days(posted, as_of) > F.lit(max_age_days), F.lit(flag_undated))
