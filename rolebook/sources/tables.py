"""Registry, seen store, tracker, salary data, batch lists and score results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.money import parse_locale_number
from rolebook.session import cut
from rolebook.sources import documents as D
from rolebook.sources import large
from rolebook.sources.feeds import get, items_of, kind_of, pick_array, read_payloads

# --- registry --------------------------------------------------------------------

REGISTRY_SCHEMA = "company string, board string, slug string, region string, category string"


def checked(c: Column, allowed: Sequence[str], name: str) -> Column:
    """The value, or a failure naming it when it is outside the vocabulary."""
    problem = F.concat(F.lit(f"unknown {name}: "), F.coalesce(c, F.lit("NULL")))
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(problem).cast("string"))


def check_registry(df: DataFrame) -> DataFrame:
    """Region and category default to india / startup; a typo in an enum fails."""
    return df.select(
        "company",
        checked(F.col("board"), vocab.BOARDS, "board").alias("board"),
        "slug",
        checked(F.coalesce("region", F.lit("india")), vocab.REGIONS, "region").alias("region"),
        checked(F.coalesce("category", F.lit("startup")), vocab.CATEGORIES, "category").alias("category"),
    )


def read_registry(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(REGISTRY_SCHEMA)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    return check_registry(df)


def resolve_targets(
    registry: DataFrame, company: str | None = None, board: str | None = None,
    category: str | None = None, region: str | None = None,
) -> DataFrame:
    """Registry rows for a company (any case) or slug, board, category, region."""
    out = registry
    if company:
        out = out.filter((F.lower("company") == company.lower()) | (F.col("slug") == company))
    for name, value in (("board", board), ("category", category), ("region", region)):
        if value:
            out = out.filter(F.col(name) == value)
    return out


def seed_url() -> Column:
    """First URL each board hits for a registry row."""
    part = F.split("slug", "/")
    site = F.coalesce(F.get(part, 1), F.lit(""))
    inst = F.coalesce(F.get(part, 2), F.lit("3"))
    return (
        F.when(F.col("board") == "greenhouse", F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), "slug", F.lit("/jobs")))
        .when(F.col("board") == "lever", F.concat(F.lit("https://api.lever.co/v0/postings/"), "slug", F.lit("?mode=json")))
        .when(
            F.col("board") == "smartrecruiters",
            F.concat(F.lit("https://api.smartrecruiters.com/v1/companies/"), "slug", F.lit("/postings")),
        )
        .when(
            F.col("board") == "workday",
            F.concat(
                F.lit("https://"), part[0], F.lit(".wd"), inst, F.lit(".myworkdayjobs.com/wday/cxs/"), part[0],
                F.lit("/"), site, F.lit("/jobs"),
            ),
        )
        .otherwise(F.lit("https://www.amazon.jobs/en/search.json"))
    )


# --- seen store ------------------------------------------------------------------

_SEEN_TEXT = (
    "title", "company", "location", "url", "portal", "first_seen", "posted_date", "status", "rank_verdict",
    "rank_date", "location_verdict", "language_gate", "language_note", "deadline",
)
_SEEN_KNOWN = (*_SEEN_TEXT, "scores", "rank_score", "rank_history", "strengths", "gaps")
HISTORY = "array<struct<score:int,verdict:string,date:string>>"


def parse_seen(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, bad keys) of store documents: ``{"seen": {...}}`` or a bare map.

    Fields outside the known ones are kept as JSON text in ``extra``. A document
    that cannot be used is a bad row without a key.
    """
    doc = D.parsed(F.col("payload"))
    problem = D.no_object(F.col("payload"), doc, objects=["seen"])
    unusable = payloads.select(problem.alias("error")).where("error IS NOT NULL").select(
        F.lit(None).cast("string").alias("key"), "error", F.lit(None).cast("string").alias("found")
    )
    wrapped = F.try_variant_get(doc, "$.seen", "map<string,variant>")
    bare = F.try_variant_get(doc, "$", "map<string,variant>")
    has_seen = F.map_contains_key(bare, "seen")
    entries = payloads.select(F.explode(F.when(has_seen, wrapped).otherwise(bare)).alias("key", "item"))
    is_object = F.startswith(F.coalesce(F.schema_of_variant("item"), F.lit("VOID")), F.lit("OBJECT"))
    i = F.col("item")
    fields = F.try_variant_get(i, "$", "map<string,variant>")
    extra = F.map_filter(fields, lambda k, _: ~k.isin(*_SEEN_KNOWN))
    good = entries.filter(is_object).select(
        "key",
        *[get(i, c).alias(c) for c in _SEEN_TEXT],
        get(i, "scores", "map<string,double>").alias("scores"),
        get(i, "rank_score", "int").alias("rank_score"),
        get(i, "rank_history", HISTORY).alias("rank_history"),
        get(i, "strengths", "array<string>").alias("strengths"),
        get(i, "gaps", "array<string>").alias("gaps"),
        F.transform_values(extra, lambda _, v: F.to_json(v)).alias("extra"),
    )
    bad = entries.filter(~is_object).select(
        "key", F.lit("entry is not an object").alias("error"), F.to_json("item").alias("found")
    )
    return good, bad.unionByName(unusable)


def read_seen_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stores landed as whole documents, or, for stores of any size, as ``lines``: one
    object of one or a few entries each, which Spark splits."""
    return parse_seen(spark.read.text(path).withColumnRenamed("value", "payload") if lines else read_payloads(spark, path))


def read_seen_large(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_seen` of whole documents of any size, each read in several tasks: its entries
    are cut out where they lie and parsed one by one. A document that does not close is a bad row
    without a key; one without ``seen`` is a bare map."""
    entries, issues = large.entries_of(spark, path, "seen")
    bare = issues.filter(F.startswith("error", F.lit("document has no")))
    if not bare.isEmpty():
        every, _ = large.entries_of(spark, path)
        entries = entries.union(every.join(bare.select("file"), "file", "left_semi").select(*entries.columns))
    good, bad = parse_seen(entries.select(F.concat(F.lit('{"seen":{'), "text", F.lit("}}")).alias("payload")))
    nothing = F.lit(None).cast("string")
    broken = issues.join(bare.select("file"), "file", "left_anti").select(nothing.alias("key"), "error", nothing.alias("found"))
    return good, bad.unionByName(broken)


def first_bad_keys(bad: DataFrame, show: int = 5) -> DataFrame:
    """Up to five of the bad keys, for the message of a failed import."""
    return bad.select("key", "error").orderBy("key").limit(show)


# --- tracker ---------------------------------------------------------------------


def conform_tracker(df: DataFrame) -> DataFrame:
    """The fourteen columns in order; a legacy header lacks ``deadline``."""
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
            for c in vocab.TRACKER_COLUMNS
        ]
    )


#: Cells of a tracker line that are read; a line may not be wider.
TRACKER_WIDTH = 64


def _tracker_files(spark: SparkSession, path: str, multiline: bool) -> tuple[DataFrame, DataFrame]:
    """(lines (file, at, cells), headers (file, first, names, error)) of tracker files. The first
    line of each file is its header, whatever its order; ``error`` tells why a file cannot be read."""
    schema = ", ".join(f"_c{i} string" for i in range(TRACKER_WIDTH))
    raw = spark.read.schema(schema).option("multiLine", multiline).option("escape", '"').option("header", False).csv(path)
    cells = F.array(*[F.col(f"_c{i}") for i in range(TRACKER_WIDTH)])
    meta = F.col("_metadata")
    # a file's parts are read in order, so ids grow with the place in it
    lines = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), cells.alias("cells"))
    first = lines.filter("block = 0").groupBy("file").agg(F.min(F.struct("at", "cells")).alias("h"))
    names = F.transform(F.filter("h.cells", lambda c: c.isNotNull()), lambda c: F.trim(F.replace(c, F.lit("\ufeff"), F.lit(""))))
    heads = first.select("file", F.col("h.at").alias("first"), names.alias("names"))
    error = F.when(~F.array_contains("names", "company") | ~F.array_contains("names", "role"), "no header with company and role").when(
        F.size(F.array_distinct("names")) < F.size("names"), "header names a column twice"
    )
    return lines.drop("block"), heads.withColumn("error", error)


def read_tracker(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Tracker CSV files, all text: each file's own header names its columns, in any order, so
    files of thirteen and of fourteen columns may lie in one folder.

    A column that a file lacks is NULL, as are cells that a short line lacks. Files without a usable
    header give no rows, and columns of other names are not read: both are rows of
    :func:`tracker_issues`. Empty files have neither. Without line breaks inside notes,
    ``multiline=False`` lets Spark split large files.
    """
    lines, heads = _tracker_files(spark, path, multiline)
    places = F.struct(*[(F.array_position("names", c) - 1).cast("int").alias(c) for c in vocab.TRACKER_COLUMNS])
    usable = heads.filter("error IS NULL").select("file", "first", places.alias("at_place"))
    rows = lines.join(usable, "file").filter("at <> first")
    cell = lambda c: F.when(F.col(f"at_place.{c}") >= 0, F.get("cells", F.col(f"at_place.{c}")))
    return rows.select(*[cell(c).alias(c) for c in vocab.TRACKER_COLUMNS])


def tracker_issues(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(file, error, lines) of what :func:`read_tracker` could not take: unusable headers,
    columns of other names, and lines with more cells than their header."""
    lines, heads = _tracker_files(spark, path, multiline)
    width = F.lit(TRACKER_WIDTH) - F.coalesce(F.array_position(F.transform(F.reverse("cells"), lambda c: c.isNotNull()), True) - 1, F.lit(TRACKER_WIDTH))
    both = lines.join(heads, "file")
    own = F.col("at") == F.col("first")
    other = F.filter("names", lambda n: ~n.isin(*vocab.TRACKER_COLUMNS))
    found = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(
        F.concat(
            F.transform(other, lambda n: F.concat(F.lit("column is not read: "), n)),
            F.when(~own & (width > F.size("names")), F.array(F.lit("line is longer than its header"))).otherwise(F.array().cast("array<string>")),
        )
    )
    # a file is told of even if its header is all it has
    issues = both.select("file", (~own | F.col("error").isNotNull()).cast("long").alias("n"), F.explode(found).alias("error"))
    return issues.groupBy("file", "error").agg(F.sum("n").alias("lines"))


# --- salary data -----------------------------------------------------------------


def parse_salary_data(payloads: DataFrame) -> DataFrame:
    """(company, city, category, count, index, baseline) from salary documents;
    ``index`` stays text because a data set may withhold it as text. Without
    ``categories`` the object-valued fields of an entry are its categories; an entry
    without any keeps its company, with NULL figures. Documents that cannot be used
    are in :func:`salary_issues`."""
    doc = D.parsed(F.col("payload"))
    rows = payloads.select(
        F.coalesce(F.try_variant_get(doc, "$.metadata.index_baseline", "double"), F.lit(100.0)).alias("baseline"),
        F.posexplode(pick_array(doc, ["companies"])).alias("pos", "item"),
    )
    i = F.col("item")
    simple = F.map_filter(F.try_variant_get(i, "$", "map<string,variant>"), lambda k, v: (D.kind(v) == "OBJECT") & (k != "categories"))
    cats = F.coalesce(get(i, "categories", "map<string,variant>"), F.when(kind_of(i, "categories") == "VOID", simple))
    return rows.select(
        "pos", "baseline", get(i, "company").alias("company"), get(i, "city").alias("city"),
        F.explode_outer(cats).alias("category", "_c"),
    ).select(
        "pos", "company", "city", "category",
        get(F.col("_c"), "count", "double").alias("count"),
        get(F.col("_c"), "index").alias("index"),
        "baseline",
    )


def read_salary(spark: SparkSession, path: str) -> DataFrame:
    return parse_salary_data(read_payloads(spark, path))


def salary_issues(payloads: DataFrame) -> DataFrame:
    """Hard problems of salary documents: (pos, error); pos is NULL where the document
    as a whole cannot be used or its metadata is wrong."""
    doc = D.parsed(F.col("payload"))
    whole = payloads.select(D.no_object(F.col("payload"), doc, objects=["metadata"], lists=["companies"]).alias("error"))
    whole = whole.where("error IS NOT NULL").select(F.lit(None).cast("int").alias("pos"), "error")
    entries_of = F.when(D.kind(doc) == "OBJECT", pick_array(doc, ["companies"]))
    rows = payloads.select(F.posexplode(entries_of).alias("pos", "item"))
    i = F.col("item")
    company, city, cats = kind_of(i, "company"), kind_of(i, "city"), kind_of(i, "categories")
    is_object = F.startswith(F.coalesce(F.schema_of_variant("item"), F.lit("VOID")), F.lit("OBJECT"))
    number = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$"
    entries = F.map_entries(get(i, "categories", "map<string,variant>"))

    def category_error(e):
        v = e["value"]
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        return (
            F.when(~F.startswith(kind, F.lit("OBJECT")), F.concat(F.lit("categories."), e["key"], F.lit(" must be an object")))
            .when(~kind_of(v, "count").rlike(number), F.concat(F.lit("categories."), e["key"], F.lit(".count must be a number")))
            .when(
                ~(kind_of(v, "index").rlike(number) | (kind_of(v, "index") == "STRING")),
                F.concat(F.lit("categories."), e["key"], F.lit(".index must be a number or string")),
            )
        )

    own = F.array(
        F.when(~is_object, F.lit("entry must be an object")),
        F.when(is_object & ((company != "STRING") | (F.trim(F.coalesce(get(i, "company"), F.lit(""))) == "")),
               F.lit("company must be a non-empty string")),
        F.when(is_object & ~city.isin("STRING", "VOID"), F.lit("city must be a string when provided")),
        F.when(is_object & ~(F.startswith(cats, F.lit("OBJECT")) | (cats == "VOID")),
               F.lit("categories must be an object when provided")),
    )
    nested = F.coalesce(F.transform(entries, category_error), F.array().cast("array<string>"))
    return rows.select("pos", F.explode(F.array_compact(F.concat(own, nested))).alias("error")).unionByName(whole)


def _names(header: Column, words: Sequence[str]) -> Column:
    return F.lower(header).rlike(rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")


def _without(header: Column, words: Sequence[str]) -> Column:
    bare = F.regexp_replace(F.lower(header), rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])", "")
    return F.regexp_replace(bare, r"^[ _-]+|[ _-]+$", "")


def sheet_headers(cells: DataFrame, depth: int = vocab.SHEET_HEADER_ROWS) -> DataFrame:
    """Header cells (sheet, header_row, col, header) of each sheet.

    The header is the first of ``depth`` rows with a company cell and a different
    city, count or index cell; else the first with any company cell. Sheets without
    one are in :func:`sheet_issues`.
    """
    text = F.trim("value")
    top = cells.filter((F.col("row") <= depth) & (F.coalesce(text, F.lit("")) != ""))
    top = top.select("sheet", "row", "col", text.alias("header"))
    company = _names(F.col("header"), vocab.SHEET_COMPANY)
    other = (
        _names(F.col("header"), vocab.SHEET_CITY)
        | _names(F.col("header"), vocab.SHEET_COUNT)
        | _names(F.col("header"), vocab.SHEET_INDEX)
    )
    rows = top.groupBy("sheet", "row").agg(
        F.max(company).alias("company"), F.max(other & ~company).alias("other")
    )
    chosen = rows.groupBy("sheet").agg(
        F.coalesce(
            F.min(F.when(F.col("company") & F.col("other"), F.col("row"))),
            F.min(F.when(F.col("company"), F.col("row"))),
        ).alias("header_row")
    )
    found = top.join(chosen.filter("header_row IS NOT NULL"), "sheet").filter(F.col("row") == F.col("header_row"))
    return found.select("sheet", "header_row", "col", "header")


def sheet_roles(headers: DataFrame) -> DataFrame:
    """What each column holds: (sheet, header_row, col, role, category, field).

    Count and index columns of one category are paired in column order;
    identifier columns and blank headers carry nothing.
    """
    h = F.col("header")
    company, city = _names(h, vocab.SHEET_COMPANY), _names(h, vocab.SHEET_CITY)
    per_sheet = Window.partitionBy("sheet")
    d = headers.withColumns(
        {
            "_company_col": F.max(F.when(company, F.col("col"))).over(per_sheet),
            "_city_col": F.max(F.when(city & ~company, F.col("col"))).over(per_sheet),
        }
    )
    is_count = _names(h, vocab.SHEET_COUNT)
    is_index = _names(h, vocab.SHEET_INDEX) & ~is_count
    role = (
        F.when(F.col("col") == F.col("_company_col"), "company")
        .when(F.col("col") == F.col("_city_col"), "city")
        .when(_names(h, vocab.SHEET_ID), "skip")
        .when(is_count, "count")
        .when(is_index, "index")
        .otherwise("plain")
    )
    bare = F.when(is_count, _without(h, vocab.SHEET_COUNT)).when(is_index, _without(h, vocab.SHEET_INDEX))
    d = d.withColumn("role", role).withColumn("_bare", bare).filter(F.col("role") != "skip")
    nth = Window.partitionBy("sheet", "role", "_bare").orderBy("col")
    d = d.withColumn("_nth", F.row_number().over(nth))
    same = Window.partitionBy("sheet", "_bare", "_nth")
    paired = (
        F.col("role").isin("count", "index")
        & (F.col("_bare") != "")
        & (F.size(F.collect_set(F.when(F.col("role").isin("count", "index"), F.col("role"))).over(same)) == 2)
    )
    own_name = F.replace(F.lower("header"), F.lit(" "), F.lit("_"))
    name = F.when(paired, F.translate("_bare", " -", "__")).otherwise(own_name)
    return d.select(
        "sheet", "header_row", "col", "role",
        F.when(F.col("role").isin("count", "index", "plain"), name).alias("category"),
        F.when(F.col("role") == "count", "count").otherwise("index").alias("field"),
    )


def sheet_issues(cells: DataFrame, depth: int = vocab.SHEET_HEADER_ROWS) -> DataFrame:
    """Sheets that give no entry or no figure: (sheet, error), one row a sheet at most."""
    roles = sheet_roles(sheet_headers(cells, depth)).groupBy(F.col("sheet").alias("_sheet")).agg(
        F.count("category").alias("_data")
    )
    sheets = cells.select("sheet").distinct().join(roles, F.col("sheet") == F.col("_sheet"), "left")
    error = F.when(F.col("_data").isNull(), f"no header in the first {depth} rows").when(
        F.col("_data") == 0, "no salary data columns"
    )
    return sheets.select("sheet", error.alias("error")).filter("error IS NOT NULL")


#: Header cells of all sheets up to which every task holds them.
BROADCAST_ROLES = 100_000


def unpivot_salary(cells: DataFrame, depth: int = vocab.SHEET_HEADER_ROWS) -> DataFrame:
    """Wide sheets as (sheet, row, company, city, category, count, index).

    ``cells`` is (sheet, row, col, value as text). Text that is no number is
    not salary data; a row without a company is no entry. A company without any
    figure is one row without category. Sheets without a header in their first
    ``depth`` rows are in :func:`sheet_issues`.
    """
    # by guess the cells look smaller than their headers, so Spark is told which side is small
    roles = cut(sheet_roles(sheet_headers(cells, depth)))
    few = roles.limit(BROADCAST_ROLES + 1).count() <= BROADCAST_ROLES
    body = cells.join(F.broadcast(roles) if few else roles.hint("merge"), ["sheet", "col"]).filter(F.col("row") > F.col("header_row"))
    value = F.trim("value")

    def cell(role):
        return F.max(F.when((F.col("role") == role) & (value != ""), value))

    number = parse_locale_number("value")
    facts = F.collect_list(
        F.when(
            F.col("category").isNotNull() & number.isNotNull(),
            F.struct(
                "category",
                F.when(F.col("field") == "count", number.cast("bigint").cast("double")).alias("count"),
                F.when(F.col("field") == "index", number).alias("index"),
            ),
        )
    )
    rows = body.groupBy("sheet", "row").agg(
        cell("company").alias("company"), F.coalesce(cell("city"), F.lit("")).alias("city"), facts.alias("facts")
    )
    flat = rows.filter(F.col("company").isNotNull()).select(
        "sheet", "row", "company", "city", F.inline_outer("facts")
    )
    return flat.groupBy("sheet", "row", "company", "city", "category").agg(
        F.max("count").alias("count"), F.max("index").alias("index")
    )


# --- batch lists and score results -------------------------------------------------


def parse_batch_refs(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, errors): an entry without a ref is an error row, never an
    abort of the others; so is a document that cannot be used."""
    keep = [c for c in payloads.columns if c != "payload"]
    rows = items_of(payloads, []).withColumnRenamed("item_no", "entry_no")
    i = F.col("item")
    ref = F.when(kind_of(i, "ref") == "STRING", get(i, "ref"))
    ok = F.coalesce(F.trim(ref) != "", F.lit(False))
    rows = rows.withColumn("ref", ref)
    good = rows.filter(ok).select(*keep, "entry_no", "ref", get(i, "description").alias("description"))
    bad = rows.filter(~ok).select(
        *keep, "entry_no",
        F.coalesce("ref", F.concat(F.lit("entry#"), "entry_no"), F.lit("document")).alias("ref"),
        F.coalesce("document_error", F.lit("batch entry is missing its ref")).alias("error"),
        F.lit("batch-file").alias("code"),
    )
    return good, bad


def read_batch_refs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_batch_refs(read_payloads(spark, path))


def _kind_name(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("VOID")), r"^[A-Z]+", 0))


def parse_scores(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of score documents: a list or ``{"results": []}``. Results
    carry their position ``n`` in the document; a document that cannot be used is an
    error row."""
    rows = items_of(payloads.select("payload"), ["results"]).withColumnRenamed("item_no", "n")
    i = F.col("item")
    kind = F.coalesce(F.schema_of_variant("item"), F.lit("VOID"))
    scores = kind_of(i, "scores")
    error = F.when(F.col("document_error").isNotNull(), F.col("document_error")).when(
        ~F.startswith(kind, F.lit("OBJECT")), F.concat(F.lit("scoring object must be an object, got "), _kind_name(kind))
    ).when(
        ~(F.startswith(scores, F.lit("OBJECT")) | (scores == "VOID")),
        F.concat(F.lit("scores must be an object, got "), _kind_name(scores)),
    )

    def dim(name):
        number = kind_of(i, f"scores.{name}").rlike(r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        return F.when(number, get(i, f"scores.{name}", "double")).alias(name)

    rows = rows.withColumn("error", error)
    key = F.coalesce(get(i, "key"), F.concat(F.lit("results["), "n", F.lit("]")), F.lit("document"))
    errors = rows.filter(F.col("error").isNotNull()).select(key.alias("key"), "error")
    good = rows.filter(F.col("error").isNull()).select(
        "n",
        get(i, "key").alias("key"),
        get(i, "status").alias("status"),
        F.struct(*[dim(d) for d in vocab.DIMENSIONS]).alias("scores"),
        *[get(i, c).alias(c) for c in ("location_verdict", "language_gate", "language_note", "deadline")],
        get(i, "strengths", "array<string>").alias("strengths"),
        get(i, "gaps", "array<string>").alias("gaps"),
    )
    return good, errors


def read_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_scores(read_payloads(spark, path))
