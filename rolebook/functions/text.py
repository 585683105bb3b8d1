"""Text scalars: whitespace, HTML, tokens, coercion, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolebook import vocab


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. Without it a long pattern
    chain that is used in a condition and in its branches runs several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c) -> Column:
    """Runs of (Unicode) whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(col_of(c), r"(?U)\s+", " "))


def blank_to_null(c) -> Column:
    """Trimmed text, or NULL when nothing is left: absent is never ``""``."""
    t = F.trim(col_of(c))
    return F.when(t != "", t)


def has_text(c) -> Column:
    return F.coalesce(col_of(c).rlike(r"(?U)\S"), F.lit(False))


def norm_key(c) -> Column:
    """Match key: lowercase, only ``[a-z0-9]`` kept; NULL becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(col_of(c), F.lit(""))), "[^a-z0-9]", "")


def contains_ci(hay: Column, needle) -> Column:
    n = F.lower(F.lit(needle)) if isinstance(needle, str) else F.lower(needle)
    return F.contains(F.lower(hay), n)


def tokens(c, min_len: int) -> Column:
    """Words of ``[a-z0-9+#.]`` with at least ``min_len`` characters, in order."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(r"[a-z0-9+#.]{%d,}" % min_len), F.lit(0))


def score_tokens(c) -> Column:
    return tokens(c, 3)


def pack_tokens(c) -> Column:
    return tokens(c, 4)


def strip_html(c) -> Column:
    """One-line text of an HTML fragment.

    Entities are decoded before tags go, ``&amp;`` first, so escaped markup
    and doubly escaped entities both resolve.
    """
    out = col_of(c)
    for entity, char in vocab.STRIP_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return squeeze(out)


def _code_point(cp: Column) -> Column:
    """The character of a code point; empty outside the Unicode scalar range."""
    ok = cp.between(0, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    safe = F.when(ok, cp).otherwise(F.lit(0))
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.when(ok, char).otherwise(F.lit(""))


def _decode_numeric(text: Column, pattern: str, radix: int) -> Column:
    """Replace each distinct numeric entity of the text by its character."""

    def step(acc, entity):
        digits = F.regexp_extract(entity, pattern, 1)
        cp = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, F.conv(digits, radix, 10)).otherwise("-1")
        return F.replace(acc, entity, _code_point(cp.try_cast("bigint")))

    def decode(t):
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        return F.when(F.contains(t, F.lit("&#")), F.aggregate(found, t, step)).otherwise(t)

    return let(text, decode)


def decode_entities(c) -> Column:
    out = col_of(c)
    for entity, char in vocab.TEXT_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = _decode_numeric(out, r"&#(\d+);", 10)
    out = _decode_numeric(out, r"&#[xX]([0-9a-fA-F]+);", 16)
    return F.replace(out, F.lit("&nbsp;"), F.lit(" "))


def html_to_text(c) -> Column:
    """Block-preserving text: paragraphs and headings keep their line breaks."""
    out = F.coalesce(col_of(c), F.lit(""))
    for pattern, repl in vocab.BLOCK_TAGS:
        out = F.regexp_replace(out, pattern, repl)
    out = decode_entities(out)
    out = F.regexp_replace(out, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")


def html_to_prose(c) -> Column:
    """Like :func:`html_to_text` with tags as spaces; NULL when nothing is left."""
    out = F.regexp_replace(col_of(c), r"(?i)<\s*br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(?:p|li|ul|ol|div|h\d)>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")
    return let(out, lambda t: F.when(t != "", t))


def as_text(variant: Column, fallback: str | None = "") -> Column:
    """Text of a VARIANT value: strings and finite numbers pass, else fallback."""
    kind = F.schema_of_variant(variant)
    is_scalar = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    text = F.try_variant_get(variant, "$", "string")
    return F.when(is_scalar, text).otherwise(F.lit(fallback))


def canon_status(c) -> Column:
    """Lowercase, trimmed, spaces as underscores: both spellings are one value."""
    return F.regexp_replace(F.lower(F.trim(col_of(c))), r"\s+", "_")


def is_open(status: Column) -> Column:
    """Open by exclusion: anything not final, unknown values included."""
    return ~F.coalesce(canon_status(status), F.lit("")).isin(*vocab.FINAL_STATUSES)


def canon_location(c) -> Column:
    """Lowercased place with the first hit of each spelling alias replaced."""
    out = F.lower(col_of(c))
    for alias, canon in vocab.LOCATION_ALIASES:
        at = F.instr(out, alias)
        out = F.when(at > 0, F.overlay(out, F.lit(canon), at, F.lit(len(alias)))).otherwise(out)
    return out


def normal_code(c) -> Column:
    return F.lower(F.replace(col_of(c), F.lit("_"), F.lit("-")))


def error_info(code) -> Column:
    """Struct(code, known, retryable) of an error code; unknown is not retryable."""
    c = col_of(code)
    known = [row[0] for row in vocab.ERROR_CODES]
    retry = [row[0] for row in vocab.ERROR_CODES if row[1]]
    return F.struct(
        normal_code(c).alias("code"),
        F.coalesce(c.isin(*known), F.lit(False)).alias("known"),
        F.coalesce(c.isin(*retry), F.lit(False)).alias("retryable"),
    )
