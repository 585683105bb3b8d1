"""Why a landed document could not be used: no document vanishes without a row.

The error texts here and in :mod:`rolebook.sources.tables` are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes past which a document is not parsed as one value but reported; such stores are
#: landed as lines, one entry each.
LARGEST = 64 * 1024 * 1024


def parsed(payload: Column) -> Column:
    """The document as VARIANT; NULL where :func:`unreadable` names a reason."""
    return F.when(F.octet_length(payload) <= LARGEST, F.try_parse_json(payload))


def kind(doc: Column) -> Column:
    """ARRAY, OBJECT, STRING ... of a parsed value; VOID for JSON null."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(doc), F.lit("VOID")), r"^[A-Z]+", 0)


def unreadable(payload: Column, doc: Column) -> Column:
    """The reason a payload gave no parsed document, else NULL."""
    return (
        F.when(payload.isNull(), "document is missing")
        .when(F.octet_length(payload) > LARGEST, "document is too large to parse: land one entry a line")
        .when(doc.isNull(), "document is not valid JSON")
    )


def part(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "variant")


def no_list(payload: Column, doc: Column, paths: Sequence[str]) -> Column:
    """The reason a document holds no list, itself or at one of the paths."""
    found = kind(doc) == "ARRAY"
    for p in paths:
        found = found | (kind(part(doc, p)) == "ARRAY")
    where = f"no list at {', '.join(paths)}" if paths else "document must be a list"
    return F.coalesce(unreadable(payload, doc), F.when(~found, F.concat(F.lit(f"{where}, got "), F.lower(kind(doc)))))


def no_object(payload: Column, doc: Column, objects: Sequence[str] = (), lists: Sequence[str] = ()) -> Column:
    """The reason a document is no object, or a stated part of it has the wrong kind."""
    out = F.coalesce(unreadable(payload, doc), F.when(kind(doc) != "OBJECT", F.concat(F.lit("top level must be an object, got "), F.lower(kind(doc)))))
    for name, want, noun in [(n, "OBJECT", "an object") for n in objects] + [(n, "ARRAY", "a list") for n in lists]:
        own = part(doc, name)
        out = F.coalesce(out, F.when(own.isNotNull() & (kind(own) != want), F.concat(F.lit(f"{name} must be {noun}, got "), F.lower(kind(own)))))
    return out
