"""URL scalars: canonical form, dedupe key, requisition id, board, refs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.text import col_of, squeeze

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/\s?#]+"


def _no_fragment(u: Column) -> Column:
    return F.substring_index(u, "#", 1)


def _authority(u: Column) -> Column:
    return F.regexp_extract(u, _ABSOLUTE, 0)


def is_url(c) -> Column:
    return F.coalesce(F.trim(col_of(c)).rlike(_ABSOLUTE), F.lit(False))


def host_of(c) -> Column:
    """Lowercased host without port or user info, NULL when not absolute."""
    auth = F.lower(F.regexp_extract(F.trim(col_of(c)), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/\s?#]+)", 1))
    host = F.regexp_replace(F.regexp_replace(auth, r"^.*@", ""), r":\d+$", "")
    return F.when(host != "", host)


def path_of(c) -> Column:
    """Path of an absolute URL; otherwise everything before ``?`` or ``#``."""
    u = F.trim(col_of(c))
    head = F.substring_index(_no_fragment(u), "?", 1)
    auth = _authority(head)
    path = F.substr(head, F.length(auth) + 1)
    return F.when(auth == "", head).when(path == "", F.lit("/")).otherwise(path)


def query_of(c) -> Column:
    base = _no_fragment(F.trim(col_of(c)))
    return F.when(F.instr(base, "?") > 0, F.substr(base, F.instr(base, "?") + 1))


def path_segments(c) -> Column:
    return F.filter(F.split(path_of(c), "/"), lambda s: s != "")


def normalize_url(c) -> Column:
    """Canonical URL: no fragment, no tracking parameters, no trailing slash.

    Scheme and host are lowercased and default ports dropped; the remaining
    parameters keep their order. Text that is no absolute URL is lowercased.
    """
    u = F.trim(F.coalesce(col_of(c), F.lit("")))
    auth = F.lower(_authority(u))
    auth = F.regexp_replace(F.regexp_replace(auth, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    kept = F.filter(
        F.split(F.coalesce(query_of(u), F.lit("")), "&"),
        lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*vocab.TRACKING_PARAMS),
    )
    kept = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    query = F.array_join(kept, "&")
    full = F.concat(auth, path_of(u), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    rough = F.lower(_no_fragment(u))
    return F.regexp_replace(F.when(auth != "", full).otherwise(rough), "/$", "")


def dedupe_key(url, company, title, location) -> Column:
    """Canonical URL, else ``company|title|location`` lowered and squeezed."""
    norm = normalize_url(url)
    parts = [F.lower(squeeze(F.coalesce(col_of(p), F.lit("")))) for p in (company, title, location)]
    return F.when(norm != "", norm).otherwise(F.concat_ws("|", *parts))


def req_id(url) -> Column:
    """Requisition id: first id-shaped path segment that is not a date."""
    candidates = F.filter(
        path_segments(url),
        lambda s: ~s.rlike(r"\d{4}-\d{2}-\d{2}") & s.rlike(r"(?i)[0-9a-f-]{8,}"),
    )
    runs = F.transform(candidates, lambda s: F.lower(F.regexp_extract(s, r"(?i)[0-9a-f-]{8,}", 0)))
    ids = F.filter(runs, lambda r: ~r.rlike(r"^(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])$"))
    return F.try_element_at(ids, F.lit(1))


def detect_board(url) -> Column:
    """Struct(board, slug) of a careers URL; ``unknown`` when no board owns it."""
    host = F.coalesce(host_of(url), F.lit(""))
    segs = path_segments(url)
    first, second = F.try_element_at(segs, F.lit(1)), F.try_element_at(segs, F.lit(2))
    instance = F.regexp_extract(host, r"\.wd(\d+)\.", 1)
    site = F.coalesce(F.when(F.lower(first) == "en-us", second).otherwise(first), F.lit(""))
    workday = F.concat_ws(
        "/",
        F.substring_index(host, ".", 1),
        site,
        F.when(instance != "", instance).otherwise(F.lit("3")),
    )
    board = (
        F.when(host.contains("amazon.jobs"), "amazon")
        .when(host.contains("greenhouse.io"), "greenhouse")
        .when(host.contains("lever.co"), "lever")
        .when(host.contains("smartrecruiters.com"), "smartrecruiters")
        .when(host.contains("myworkdayjobs.com"), "workday")
        .otherwise("unknown")
    )
    slug = F.when(board.isin("greenhouse", "lever"), first).when(board == "workday", workday)
    return F.struct(board.alias("board"), slug.alias("slug"))


def numeric_ref(ref, board: str) -> Column:
    """The numeric id a RemoteOK / Remotive reference carries, else the text."""
    r = F.trim(col_of(ref))
    tail = F.regexp_extract(r, r"(\d+)$", 1)
    if board == "remoteok":
        path = F.regexp_extract(r, r"/remote-jobs/(?:.*-)?(\d+)", 1)
        order = (path, tail)
    else:
        path = F.regexp_extract(r, r"remote-jobs/.*-(\d+)", 1)
        order = (tail, path)
    return F.when(order[0] != "", order[0]).when(order[1] != "", order[1]).otherwise(r)


def freehire_slug(ref) -> Column:
    r = F.trim(col_of(ref))
    from_path = F.regexp_extract(r, r"/jobs/([^/?#]+)", 1)
    return F.when(from_path != "", from_path).when(r.rlike(r"(?i)^[a-z0-9][a-z0-9-]*$"), r)


def workday_path(ref, site) -> Column:
    """Detail path: a full URL sheds its origin and ``/en-US/<site>``."""
    r = col_of(ref)
    path = F.regexp_replace(r, r"(?i)^https?://[^/]+", "")
    prefix = F.concat(F.lit("/en-us/"), F.lower(col_of(site)))
    path = F.when(F.startswith(F.lower(path), prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)
    full = F.when(r.rlike(r"(?i)^https?://"), path).otherwise(r)
    return F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))


def with_ref(df: DataFrame, column: str = "url") -> DataFrame:
    """Adds ``board``, ``slug`` and ``posting_id`` of a posting URL."""
    d = df.withColumn("_u", F.trim(F.col(column)))
    d = d.withColumns({"_host": F.coalesce(host_of("_u"), F.lit("")), "_found": detect_board("_u")})
    host, found, u = F.col("_host"), F.col("_found"), F.col("_u")
    board = (
        F.when(found["board"] != "unknown", found["board"])
        .when(host.contains("remoteok"), "remoteok")
        .when(host.contains("remotive"), "remotive")
        .when(host.contains("freehire"), "freehire")
        .otherwise("unknown")
    )
    d = d.withColumn("board", board)

    def first_group(pattern):
        got = F.regexp_extract(u, pattern, 1)
        return F.when(got != "", got).otherwise(u)

    last_seg = F.coalesce(F.try_element_at(F.filter(F.split(u, "/"), lambda s: s != ""), F.lit(-1)), u)
    hexid = F.regexp_extract(u, r"(?i)([0-9a-f-]{8,})", 1)
    kind = F.col("board")
    posting = (
        F.when(kind == "greenhouse", first_group(r"(\d+)(?!.*\d)"))
        .when(kind == "amazon", first_group(r"(\d{5,})"))
        .when(kind == "lever", last_seg)
        .when(kind == "smartrecruiters", F.when(hexid != "", hexid).otherwise(last_seg))
        .when(kind == "workday", workday_path(u, F.element_at(F.split(F.coalesce(found["slug"], F.lit("//")), "/"), 2)))
        .when(kind == "remoteok", numeric_ref(u, "remoteok"))
        .when(kind == "remotive", numeric_ref(u, "remotive"))
        .when(kind == "freehire", freehire_slug(u))
    )
    slug = F.when(
        kind == "smartrecruiters", F.regexp_extract(u, r"(?i)smartrecruiters\.com/([^/]+)", 1)
    ).otherwise(found["slug"])
    return d.withColumns({"slug": slug, "posting_id": posting}).drop("_u", "_host", "_found")
