"""Landed job-board payloads to postings.

A payload is one landed document: a DataFrame row with ``payload`` (text) and,
for company boards, ``slug`` and ``company``. Every mapper yields one row per
listed item, valid or not, with ``reject_reason`` naming the first rule an
item breaks; :func:`read_feed` splits the two.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolebook.functions.dates import epoch_date, iso_date, lenient_date, relative_date
from rolebook.functions.money import format_salary, format_salary_currency
from rolebook.functions.text import (
    as_text,
    blank_to_null,
    decode_entities,
    html_to_prose,
    html_to_text,
    strip_html,
)
from rolebook.operators.filters import reject_reason
from rolebook.sources import documents as D
from rolebook.sources import large

# --- fixed values: the boards' own addresses ------------------------------------
REMOTEOK_URL = "https://remoteok.com"
REMOTIVE_URL = "https://remotive.com"
UNSTOP_URL = "https://unstop.com/o/"
AMAZON_URL = "https://www.amazon.jobs"
SMARTRECRUITERS_URL = "https://jobs.smartrecruiters.com/"


def get(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{path}", kind)


def kind_of(item: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(get(item, path, "variant")), F.lit("VOID"))


def text_of(item: Column, path: str, fallback: str | None = "") -> Column:
    """Text or number of a field as text; anything else is the fallback."""
    return F.coalesce(as_text(get(item, path, "variant"), fallback), F.lit(fallback).cast("string"))


def only_string(item: Column, path: str) -> Column:
    return F.when(kind_of(item, path) == "STRING", get(item, path))


def string_array(item: Column, path: str) -> Column:
    return F.coalesce(get(item, path, "array<string>"), F.array().cast("array<string>"))


def pick_array(variant: Column, paths: Sequence[str]) -> Column:
    """The payload itself when it is an array, else the first array at any of
    the dot paths, else empty."""
    found = [F.try_variant_get(variant, "$", "array<variant>")]
    found += [F.try_variant_get(variant, f"$.{p}", "array<variant>") for p in paths]
    return F.coalesce(*found, F.array().cast("array<variant>"))


def items_of(payloads: DataFrame, paths: Sequence[str]) -> DataFrame:
    """One row per listed item: ``item`` (VARIANT) and its position ``item_no``; a
    document that cannot be used is one row with its ``document_error``."""
    parsed = payloads.withColumn("_doc", D.parsed(F.col("payload")))
    parsed = parsed.withColumn("_problem", D.no_list(F.col("payload"), F.col("_doc"), paths))
    keep = [c for c in payloads.columns if c != "payload"]
    nothing = F.lit(None)
    listed = F.transform(
        pick_array(F.col("_doc"), paths),
        lambda x, i: F.struct(i.alias("item_no"), x.alias("item"), nothing.cast("string").alias("document_error")),
    )
    lone = F.array(F.struct(nothing.cast("int").alias("item_no"), nothing.cast("variant").alias("item"), F.col("_problem").alias("document_error")))
    entries = F.when(F.col("_problem").isNull(), listed).otherwise(lone)
    return parsed.select(*keep, F.explode_outer(entries).alias("_e")).where("_e IS NOT NULL").select(*keep, "_e.*")


def encode_component(c: Column) -> Column:
    """Percent-encoding of one URL component."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def board_id(portal: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(portal), *parts)


def cut(c: Column, chars: int | None) -> Column:
    """Whole text by default; the boards' detail view cuts at a length."""
    return c if chars is None else F.substring(c, 1, chars)


def _posting(df: DataFrame, portal: str, rules: Sequence[tuple[str, Column]], **columns: Column) -> DataFrame:
    keep = [c for c in df.columns if c not in ("item", "slug", "company", "document_error")]
    shaped = {"portal": F.lit(portal), "source": F.lit("adapter"), **columns}
    reason = reject_reason(rules)
    if "document_error" in df.columns:
        reason = F.coalesce("document_error", reason)
    return df.select(*keep, *[c.alias(n) for n, c in shaped.items()], reason.alias("reject_reason"))


def body_text(item: Column) -> Column:
    """Text of an item's description, NULL when it states none."""
    body = get(item, "description")
    return F.when(body != "", html_to_text(body))


def _title(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("Untitled")))


def _company(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("Unknown")))


def map_greenhouse(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    d = items_of(payloads, ["jobs"])
    i = F.col("item")
    return _posting(
        d, "greenhouse", [],
        id=board_id("greenhouse", F.col("slug"), get(i, "id")),
        title=_title(get(i, "title")),
        company=F.col("company"),
        location=blank_to_null(get(i, "location.name")),
        posted_date=lenient_date(get(i, "updated_at")),
        url=get(i, "absolute_url"),
        description=cut(strip_html(F.coalesce(get(i, "content"), F.lit(""))), chars),
    )


def lever_description(item: Column, chars: int | None = None) -> Column:
    """Body, then each list as its heading and text. With ``chars`` the body
    and the lists are each cut to half of it, as the board's detail view does."""
    half = None if chars is None else chars // 2
    lists = F.coalesce(get(item, "lists", "array<struct<text:string,content:string>>"),
                       F.array().cast("array<struct<text:string,content:string>>"))
    sections = F.array_join(
        F.transform(
            lists,
            lambda s: F.concat(F.coalesce(s["text"], F.lit("")), F.lit("\n"), strip_html(F.coalesce(s["content"], F.lit("")))),
        ),
        "\n\n",
    )
    tail = F.when(sections != "", F.concat(F.lit("\n\n"), sections)).otherwise(F.lit(""))
    return F.concat(cut(strip_html(F.coalesce(get(item, "description"), F.lit(""))), half), cut(tail, half))


def map_lever(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    d = items_of(payloads, [])
    i = F.col("item")
    created = get(i, "createdAt", "bigint")
    return _posting(
        d, "lever", [],
        id=board_id("lever", F.col("slug"), get(i, "id")),
        title=_title(get(i, "text")),
        company=F.col("company"),
        location=blank_to_null(get(i, "categories.location")),
        posted_date=F.when(created != 0, epoch_date(created, "ms")),
        url=get(i, "hostedUrl"),
        description=lever_description(i, chars),
    )


def map_smartrecruiters(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    d = items_of(payloads, ["content"])
    i = F.col("item")
    city, country = (F.when(get(i, f"location.{p}") != "", get(i, f"location.{p}")) for p in ("city", "country"))
    place = F.concat_ws(", ", city, country)
    return _posting(
        d, "smartrecruiters", [],
        id=board_id("smartrecruiters", F.col("slug"), get(i, "id")),
        title=_title(get(i, "name")),
        company=F.col("company"),
        location=F.when(place != "", place),
        posted_date=iso_date(get(i, "releasedDate")),
        url=F.concat(F.lit(SMARTRECRUITERS_URL), encode_component(F.col("slug")), F.lit("/"), encode_component(get(i, "id"))),
        city=city,
        description=F.lit(None).cast("string"),
    )


_SECTION = "struct<title:string,text:string>"


def smartrecruiters_description(payload: Column, chars: int | None = None) -> Column:
    """Text of a detail document; ``sections`` is an array on some tenants and
    a keyed object, in its own order, on others."""
    raw = F.get_json_object(payload, "$.jobAd.sections")
    listed = F.when(F.startswith(F.trim(raw), F.lit("[")), F.from_json(raw, f"array<{_SECTION}>"))
    keyed = F.map_values(F.from_json(raw, f"map<string,{_SECTION}>"))
    sections = F.coalesce(listed, keyed, F.array().cast(f"array<{_SECTION}>"))
    texts = F.transform(
        sections,
        lambda s: F.regexp_replace(
            F.concat(F.coalesce(s["title"], F.lit("")), F.lit("\n"), strip_html(F.coalesce(s["text"], F.lit("")))),
            r"^\s+|\s+$", "",
        ),
    )
    return cut(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"), chars)


def map_amazon(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    d = items_of(payloads, ["jobs"])
    i = F.col("item")
    path = get(i, "job_path")
    body = F.concat(
        F.coalesce(get(i, "description"), F.lit("")), F.lit("\n\n"), F.coalesce(get(i, "qualifications"), F.lit(""))
    )
    return _posting(
        d, "amazon", [],
        id=board_id("amazon", get(i, "id")),
        title=_title(get(i, "title")),
        company=F.lit("Amazon"),
        location=blank_to_null(get(i, "location")),
        posted_date=lenient_date(get(i, "posting_date")),
        url=F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(AMAZON_URL), path)).otherwise(
            F.concat(F.lit(AMAZON_URL + "/en/jobs/"), get(i, "id"))
        ),
        description=cut(strip_html(body), chars),
    )


def map_workday(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    """``slug`` is tenant, or tenant/site/instance."""
    d = items_of(payloads, ["jobPostings"])
    i = F.col("item")
    tenant = F.substring_index("slug", "/", 1)
    ref = F.coalesce(
        get(i, "externalPath"), get(i, "bulletinId"), encode_component(F.coalesce(get(i, "title"), F.lit("untitled")))
    )
    return _posting(
        d, "workday", [],
        id=board_id("workday", tenant, ref),
        title=_title(get(i, "title")),
        company=F.col("company"),
        location=blank_to_null(get(i, "locationsText")),
        posted_date=relative_date(get(i, "postedOn"), as_of),
        url=F.concat(F.lit("https://"), tenant, F.lit(".myworkdayjobs.com/en-US/"), ref),
        description=F.lit(None).cast("string"),
    )


def map_workday_detail(payloads: DataFrame, as_of, chars: int | None = None) -> DataFrame:
    """One detail document per row, with ``slug`` (tenant/site/instance),
    ``company`` and ``ref``; a document without the record is rejected."""
    from rolebook.functions.urls import workday_path

    doc = D.parsed(F.col("payload"))
    parts = F.split("slug", "/")
    tenant, site, inst = parts[0], parts[1], F.concat(F.lit("wd"), parts[2])
    d = payloads.withColumn("item", F.try_variant_get(doc, "$.jobPostingInfo", "variant"))
    i, path = F.col("item"), workday_path("ref", site)
    body = cut(strip_html(F.coalesce(get(i, "jobDescription"), F.lit(""))), chars)
    out = _posting(
        d.drop("payload"), "workday", [("no-record", F.col("item").isNotNull())],
        id=board_id("workday", tenant, F.regexp_replace(path, "^/", "")),
        title=_title(get(i, "title")),
        company=F.col("company"),
        location=blank_to_null(get(i, "location")),
        posted_date=relative_date(F.coalesce(get(i, "postedOn"), get(i, "startDate")), as_of),
        url=F.concat(F.lit("https://"), tenant, F.lit("."), inst, F.lit(".myworkdayjobs.com/en-US/"), site, path),
        description=F.when(body != "", body).otherwise(F.lit("(no description returned)")),
    )
    return out


def map_remoteok(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    """The feed opens with a legal notice; it has no position and is rejected."""
    d = items_of(payloads, [])
    i = F.col("item")
    slug = F.trim(F.coalesce(only_string(i, "slug"), F.lit("")))
    stated = F.trim(F.coalesce(only_string(i, "url"), F.lit("")))
    url = F.when(stated != "", stated).when(slug != "", F.concat(F.lit(REMOTEOK_URL + "/remote-jobs/"), slug))
    apply_url = get(i, "apply_url")
    return _posting(
        d, "remoteok",
        [
            ("no-id", get(i, "id").isNotNull()),
            ("no-position", F.coalesce(get(i, "position"), F.lit("")) != ""),
            ("no-url", url.isNotNull()),
        ],
        id=board_id("remoteok", get(i, "id")),
        title=get(i, "position"),
        company=_company(F.when(get(i, "company") != "", get(i, "company"))),
        location=blank_to_null(get(i, "location")),
        posted_date=iso_date(get(i, "date")),
        url=url,
        slug=slug,
        salary=format_salary(get(i, "salary_min", "double"), get(i, "salary_max", "double")),
        tags=string_array(i, "tags"),
        apply_url=F.when(apply_url != "", apply_url).otherwise(url),
        description=body_text(i),
    )


def map_remotive(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    d = items_of(payloads, ["jobs"])
    i = F.col("item")

    def stated(path):
        return F.when(get(i, path) != "", get(i, path))

    company = blank_to_null(decode_entities(F.coalesce(get(i, "company_name"), F.lit(""))))
    return _posting(
        d, "remotive",
        [
            ("no-id", ~F.coalesce(get(i, "id"), F.lit("")).isin("", "0")),
            ("no-title", F.coalesce(get(i, "title"), F.lit("")) != ""),
        ],
        id=board_id("remotive", get(i, "id")),
        title=decode_entities(get(i, "title")),
        company=_company(company),
        location=blank_to_null(get(i, "candidate_required_location")),
        posted_date=iso_date(get(i, "publication_date")),
        url=F.coalesce(stated("url"), F.concat(F.lit(REMOTIVE_URL + "/remote-jobs/"), get(i, "id"))),
        salary=blank_to_null(get(i, "salary")),
        category=stated("category"),
        job_type=stated("job_type"),
        tags=string_array(i, "tags"),
        description=body_text(i),
    )


def map_freehire(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    """Search and detail fields in one row; absent enrichment stays NULL."""
    d = items_of(payloads, ["data"])
    i = F.col("item")

    def stated(path):
        return F.when(get(i, path) != "", get(i, path))

    company = text_of(i, "company")
    enrich = F.coalesce(get(i, "enrichment", "variant"), F.parse_json(F.lit("{}")))
    return _posting(
        d, "freehire",
        [
            ("no-title", F.trim(text_of(i, "title")) != ""),
            ("no-url", F.trim(text_of(i, "url")) != ""),
        ],
        id=board_id("freehire", F.coalesce(get(i, "public_slug"), get(i, "id"), F.lit(""))),
        title=get(i, "title"),
        company=_company(F.when(company != "", company)),
        location=stated("location"),
        posted_date=iso_date(F.coalesce(get(i, "posted_at"), get(i, "date"))),
        url=get(i, "url"),
        company_slug=stated("company_slug"),
        work_mode=stated("work_mode"),
        regions=string_array(i, "regions"),
        countries=string_array(i, "countries"),
        cities=string_array(i, "cities"),
        skills=string_array(i, "skills"),
        seniority=F.when(get(enrich, "seniority") != "", get(enrich, "seniority")),
        category=F.when(get(enrich, "category") != "", get(enrich, "category")),
        employment_type=F.when(get(enrich, "employment_type") != "", get(enrich, "employment_type")),
        salary=format_salary_currency(
            get(enrich, "salary_min", "double"), get(enrich, "salary_max", "double"), get(enrich, "salary_currency")
        ),
        description=html_to_prose(get(i, "description")),
    )


def map_arbeitnow(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    d = items_of(payloads, ["data"])
    i = F.col("item")
    remote = F.when(F.coalesce(get(i, "remote", "boolean"), F.lit(False)), F.lit("Remote"))
    title, company = blank_to_null(get(i, "title")), blank_to_null(get(i, "company_name"))
    return _posting(
        d, "arbeitnow",
        [
            ("no-slug", F.coalesce(get(i, "slug"), F.lit("")) != ""),
            ("no-url", F.coalesce(get(i, "url"), F.lit("")) != ""),
        ],
        id=board_id("arbeitnow", get(i, "slug")),
        title=F.coalesce(title, F.lit("Untitled")),
        company=F.coalesce(company, F.lit("Unknown")),
        location=F.coalesce(blank_to_null(get(i, "location")), remote),
        posted_date=F.when(kind_of(i, "created_at") == "STRING", iso_date(get(i, "created_at"))).otherwise(
            epoch_date(get(i, "created_at"))
        ),
        url=F.trim(get(i, "url")),
        description=body_text(i),
    )


def map_unstop(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    d = items_of(payloads, ["data.data", "opportunities"])
    i = F.col("item")

    def first(*paths):
        """Text of the first field that is present at all."""
        out = F.lit(None).cast("string")
        for p in reversed(paths):
            out = F.when(kind_of(i, p) != "VOID", text_of(i, p)).otherwise(out)
        return out

    title = first("title", "name")
    return _posting(
        d, "unstop",
        [("no-title", F.trim(F.coalesce(title, F.lit(""))) != "")],
        id=board_id("unstop", get(i, "id")),
        title=F.trim(title),
        company=F.trim(F.coalesce(get(i, "organisation.name"), F.lit("Unstop"))),
        location=blank_to_null(first("location", "locations[0]")),
        posted_date=iso_date(get(i, "start_date")),
        url=F.trim(F.coalesce(first("public_url", "url"), F.concat(F.lit(UNSTOP_URL), get(i, "id")))),
        description=F.lit(None).cast("string"),
    )


_ITEM_XML = (
    "title string, `dc:creator` string, author string, location string, pubDate string, link string, guid string"
)


def map_wwr(payloads: DataFrame, as_of=None, chars: int | None = None) -> DataFrame:
    """RSS items. Without an author the employer is read from "Company: Title"
    when the head is at most 60 characters and a title follows."""
    blocks = F.regexp_extract_all("payload", F.lit(r"(?is)<item(?:\s[^>]*)?>.*?</item>"), F.lit(0))
    keep = [c for c in payloads.columns if c != "payload"]
    d = payloads.select(*keep, F.posexplode(blocks).alias("item_no", "_xml"))
    return _wwr_items(d.withColumn("item", F.from_xml("_xml", _ITEM_XML)).drop("_xml"))


def _wwr_items(d: DataFrame) -> DataFrame:
    def field(name):
        return strip_html(F.coalesce(F.col("item").getField(name), F.lit("")))

    raw = field("title")
    author = F.when(field("dc:creator") != "", field("dc:creator")).otherwise(field("author"))
    head, tail = F.substring_index(raw, ":", 1), F.trim(F.substr(raw, F.instr(raw, ":") + 1))
    folded = (author == "") & F.contains(raw, F.lit(":")) & (F.length(head) <= 60) & (tail != "")
    company = F.when(folded, F.trim(head)).otherwise(author)
    return _posting(
        d, "weworkremotely",
        [("no-title", raw != ""), ("no-link", field("link") != "")],
        id=board_id("weworkremotely", F.when(field("guid") != "", field("guid")).otherwise(field("link"))),
        title=F.when(folded, tail).otherwise(raw),
        company=F.when(company != "", company).otherwise(F.lit("Unknown")),
        location=blank_to_null(field("location")),
        posted_date=lenient_date(field("pubDate")),
        url=field("link"),
        description=F.lit(None).cast("string"),
    )


@dataclass(frozen=True)
class Feed:
    """One board: how to map its payloads and which columns its search reads."""

    portal: str
    kind: str
    map: Callable[..., DataFrame]


#: The extension point: add a board by adding an entry.
FEEDS: dict[str, Feed] = {
    f.portal: f
    for f in (
        Feed("greenhouse", "company", map_greenhouse),
        Feed("lever", "company", map_lever),
        Feed("smartrecruiters", "company", map_smartrecruiters),
        Feed("amazon", "company", map_amazon),
        Feed("workday", "company", map_workday),
        Feed("remoteok", "aggregator", map_remoteok),
        Feed("remotive", "aggregator", map_remotive),
        Feed("freehire", "aggregator", map_freehire),
        Feed("arbeitnow", "aggregator", map_arbeitnow),
        Feed("unstop", "aggregator", map_unstop),
        Feed("weworkremotely", "aggregator", map_wwr),
    )
}

POSTING_COLUMNS = (
    "id", "title", "company", "location", "posted_date", "url", "portal", "source", "description",
)


def split_feed(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantined rows with ``reject_reason``)."""
    ok = F.col("reject_reason").isNull()
    return mapped.filter(ok).drop("reject_reason"), mapped.filter(~ok)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one file each, as ``payload``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def read_items(spark: SparkSession, path: str, part: str = "") -> DataFrame:
    """Documents of any size as one small ``payload`` for each listed item, and one that
    says what is wrong for a document that cannot be used."""
    entries, issues = large.entries_of(spark, path, part or None)
    told = F.concat(F.lit("["), "text", F.lit("]"))
    # no valid document: the feed's own reader quarantines it
    return entries.select("entry_no", told.alias("payload")).union(issues.select(F.lit(None).cast("long"), F.col("error").alias("payload")))


def read_feed(
    spark: SparkSession, portal: str, path: str, as_of=None, slug: str | None = None,
    company: str | None = None, chars: int | None = None, large_part: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantined) of the landed files under ``path``. With ``large_part``, the name of the
    member that lists the items (empty: the document lists them), files may have any size and each is
    read in several tasks; a file that cannot be used is a quarantined row."""
    payloads = read_payloads(spark, path) if large_part is None else read_items(spark, path, large_part)
    if FEEDS[portal].kind == "company":
        payloads = payloads.withColumns(
            {"slug": F.lit(slug or ""), "company": F.lit(company or slug or "")}
        )
    mapped = FEEDS[portal].map(payloads, as_of=as_of, chars=chars)
    if large_part is not None:
        mapped = mapped.withColumn("item_no", F.col("entry_no").cast("int")).drop("entry_no")
    return split_feed(mapped)


def _reader(portal: str):
    def read(spark: SparkSession, path: str, **options):
        return read_feed(spark, portal, path, **options)

    read.__name__ = f"read_{portal}"
    read.__doc__ = f"(postings, quarantined) of landed {portal} files."
    return read


read_greenhouse = _reader("greenhouse")
read_lever = _reader("lever")
read_smartrecruiters = _reader("smartrecruiters")
read_amazon = _reader("amazon")
read_workday = _reader("workday")
read_remoteok = _reader("remoteok")
read_remotive = _reader("remotive")
read_freehire = _reader("freehire")
read_arbeitnow = _reader("arbeitnow")
read_unstop = _reader("unstop")


def read_wwr_rss(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """RSS files, split by Spark's XML source: one row per item, any file size."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(_ITEM_XML).load(path)
    return split_feed(_wwr_items(rows.select(F.struct(*rows.columns).alias("item"))))


def payload_notes(payloads: DataFrame, portal: str, paths: Sequence[str] = ()) -> DataFrame:
    """One note per payload: unreadable documents are notes, not failures."""
    doc = D.parsed(F.col("payload"))
    return payloads.select(
        F.lit(portal).alias("portal"),
        doc.isNotNull().alias("ok"),
        F.size(pick_array(doc, paths)).alias("rows"),
        F.when(doc.isNull(), F.lit("payload is not valid JSON")).alias("error"),
    )


def envelope_issues(payloads: DataFrame) -> DataFrame:
    """Provider envelopes whose ``meta.count`` is not the number of results."""
    doc = D.parsed(F.col("payload"))
    stated, listed = F.try_variant_get(doc, "$.meta.count", "bigint"), F.size(pick_array(doc, ["results"]))
    return payloads.withColumns({"stated": stated, "listed": listed}).filter(
        F.coalesce(F.col("stated") != F.col("listed"), F.lit(True))
    )


_LD = r'(?s)<script type="application/ld\+json">(.*?)</script>'


def extract_jsonld(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``posting``: the first JSON-LD JobPosting of a page, else NULL."""
    scripts = F.regexp_extract_all(html, F.lit(_LD), F.lit(1))
    docs = F.transform(scripts, lambda s: F.try_parse_json(s))
    found = F.filter(docs, lambda d: F.coalesce(F.try_variant_get(d, "$['@type']", "string") == "JobPosting", F.lit(False)))
    d = pages.withColumn("_ld", F.try_element_at(found, F.lit(1)))
    i = F.col("_ld")
    low, high = get(i, "baseSalary.value.minValue"), get(i, "baseSalary.value.maxValue")
    currency = F.coalesce(F.when(get(i, "baseSalary.currency") != "", get(i, "baseSalary.currency")), F.lit("$"))
    has_salary = F.coalesce(F.nullif(low, F.lit("0")), F.nullif(high, F.lit("0"))).isNotNull()
    salary = F.when(low.eqNullSafe(high), F.concat(currency, low)).otherwise(
        F.concat(currency, F.coalesce(low, F.lit("")), F.lit(" - "), currency, F.coalesce(high, F.lit("")))
    )
    date = get(i, "datePosted")
    posting = F.struct(
        F.coalesce(get(i, "title"), F.lit("")).alias("title"),
        F.coalesce(get(i, "hiringOrganization.name"), F.lit("")).alias("company"),
        F.when(date != "", date).alias("date"),
        F.when(has_salary, salary).alias("salary"),
        html_to_text(get(i, "description")).alias("description"),
    )
    return d.withColumn("posting", F.when(i.isNotNull(), posting)).drop("_ld")
