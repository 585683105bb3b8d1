"""Joins between postings, seen store, tracker, candidates and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.dates import as_of_col
from rolebook.functions.text import canon_location, norm_key
from rolebook.functions.urls import numeric_ref
from rolebook.operators.gates import gate_stale
from rolebook.operators.scoring import Candidate, factor_weights, freshness, half_up
from rolebook.session import cut


def tracker_pairs(tracker: DataFrame) -> DataFrame:
    """Distinct (company_key, role_key); rows without a company do not count."""
    pairs = tracker.select(norm_key("company").alias("company_key"), norm_key("role").alias("role_key"))
    return pairs.filter(F.col("company_key") != "").distinct()


def _pair_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"company_key": norm_key("company"), "role_key": norm_key("title")})


def exclude_tracked(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """Postings whose company and title are not in the tracker."""
    keys = ["company_key", "role_key"]
    return _pair_keys(postings).join(tracker_pairs(tracker), keys, "left_anti").drop(*keys)


def mark_tracked(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """All postings with ``tracked``: one join where both sides are needed."""
    keys = ["company_key", "role_key"]
    pairs = tracker_pairs(tracker).withColumn("_hit", F.lit(True))
    out = _pair_keys(postings).join(pairs, keys, "left")
    return out.withColumn("tracked", F.coalesce("_hit", F.lit(False))).drop("_hit", *keys)


def known_keys(seen: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct asked keys (column ``key``) that the store holds.

    The store is the large side and grows for ever. A semi join keeps it on
    the streamed side, so a small batch of keys can be broadcast to it and
    the store itself is not shuffled.
    """
    return seen.select("key").join(asked.distinct(), "key", "left_semi").distinct()


def only_new(postings: DataFrame, seen: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Postings whose key the seen store does not hold."""
    known = known_keys(seen, postings.select(F.col(key).alias("key"))).withColumnRenamed("key", key)
    return postings.join(known, key, "left_anti")


def join_scores(results: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, errors): score results against stored entries; a result with
    an unknown key is an error row. As in :func:`only_new` the store is first
    narrowed to the keys asked for."""
    known = known_keys(seen, results.select("key")).withColumn("_known", F.lit(True))
    joined = results.join(known, "key", "left")
    errors = joined.filter(F.col("_known").isNull()).select("key", F.lit("no such key in the seen store").alias("error"))
    return joined.filter(F.col("_known")).drop("_known"), errors


def resolve_refs(refs: DataFrame, postings: DataFrame, board: str = "remoteok") -> DataFrame:
    """Adds ``posting_id`` and ``how`` to refs (column ``ref``).

    Exact id, slug or url first (lowest ``pos`` wins); else the numeric url
    tail, only when exactly one posting carries it.
    """
    r = refs.withColumn("_num", numeric_ref("ref", board))

    def keyed(pairs):
        return F.explode(F.array_distinct(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("val")) for k, c in pairs])))

    slug = F.col("slug") if "slug" in postings.columns else F.lit(None).cast("string")
    post_keys = postings.select(
        F.col("id").alias("_id"), "pos", keyed([("id", F.col("id")), ("slug", slug), ("url", F.col("url"))]).alias("k")
    ).select("k.kind", "k.val", "_id", "pos")
    first = post_keys.filter(F.coalesce("val", F.lit("")) != "").groupBy("kind", "val").agg(
        F.min(F.struct("pos", "_id")).alias("_best")
    )
    ref_keys = r.select(
        "ref", keyed([("id", F.col("ref")), ("id", F.col("_num")), ("slug", F.col("ref")), ("url", F.col("ref"))]).alias("k")
    ).select("ref", "k.kind", "k.val").distinct()
    exact = ref_keys.join(first, ["kind", "val"]).groupBy("ref").agg(F.min("_best").alias("_exact"))
    tail = F.regexp_extract(F.regexp_replace("url", "/+$", ""), r"-(\d+)$", 1)
    tails = (
        postings.select(tail.alias("_num"), F.col("id").alias("_tail_id"))
        .filter(F.col("_num") != "")
        .groupBy("_num")
        .agg(F.min("_tail_id").alias("_tail_id"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )
    out = r.join(exact, "ref", "left").join(tails, "_num", "left")
    return out.select(
        *refs.columns,
        F.coalesce(F.col("_exact._id"), F.col("_tail_id")).alias("posting_id"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_tail_id").isNotNull(), "tail").alias("how"),
    )


def pair(postings: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Every posting with each of a few configured candidates, as struct
    ``cand``. The list is exploded in place: no join, no shuffle. For a table
    of candidates see :func:`candidate_reach`, which forms no pairs."""
    return postings.select("*", F.explode(F.array(*[c.as_struct() for c in candidates])).alias("cand"))


#: Places are looked up by substrings of at most this many characters.
TERM = 16


def _place_parts(place: Column) -> Column:
    n = F.length(place)
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(n, F.lit(TERM))),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(place, i, k)),
        )
    )
    return F.array_distinct(F.concat(F.array(F.lit("")), F.when(n > 0, parts).otherwise(F.array(F.lit("")))))


def accepted_places(places: DataFrame, wants: DataFrame) -> DataFrame:
    """Distinct (accept, place) of accepted sets and the distinct places they admit, by
    an equi join of terms with parts of places; an empty set admits every place."""
    terms = wants.select("accept").distinct().select("accept", F.explode("accept").alias("term"))
    parts = places.filter(F.col("place").isNotNull()).select("place", F.explode(_place_parts(F.col("place"))).alias("_part"))
    hits = (
        terms.withColumn("_part", F.substring("term", 1, TERM))
        .join(parts, "_part")
        .filter(F.contains("place", F.col("term")))
        .select("accept", "place")
        .distinct()
    )
    return hits.union(places.select(F.array().cast("array<string>").alias("accept"), "place"))


def texts_of(column: str) -> Column:
    """An array of texts; null is no text at all, and null entries are left out."""
    return F.array_compact(F.coalesce(F.col(column), F.array().cast("array<string>")))


def accepted_set() -> Column:
    return F.array_sort(F.array_distinct(F.transform(texts_of("locations"), lambda w: canon_location(w))))


def candidate_reach(postings: DataFrame, candidates: DataFrame, as_of, max_age_days: int = vocab.RANK_MAX_AGE_DAYS) -> DataFrame:
    """(candidate_id, passed): postings that pass the date and place gates of
    each row of a candidate table (candidate_id, locations), of any size.

    Postings are reduced to counts per distinct place, candidates to distinct
    accepted sets; the two meet in an equi join of accepted terms with the
    substrings of a place. No posting ever meets a candidate.
    """
    late = gate_stale("posted_date", max_age_days, as_of).fails
    places = postings.filter(~late).groupBy(canon_location("location").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    wants = candidates.select("candidate_id", accepted_set().alias("accept"))
    met = accepted_places(places.select("place"), wants).join(places.withColumnRenamed("place", "_p"), F.col("place").eqNullSafe(F.col("_p")))
    counts = met.groupBy("accept").agg(F.sum("n").alias("passed"))
    out = wants.join(counts, "accept", "left")
    return out.select("candidate_id", F.coalesce("passed", F.lit(0)).cast("bigint").alias("passed"))


def _title_parts(title: Column) -> Column:
    """Distinct parts of one to three characters."""
    sized = F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - k + 1, F.lit(1))), lambda i: F.substr(title, i, k)),
    )
    return F.array_distinct(F.flatten(sized))


def shortlist_per_candidate(postings: DataFrame, candidates: DataFrame, as_of, top: int, max_age_days: int = vocab.RANK_MAX_AGE_DAYS) -> DataFrame:
    """(candidate_id, id, score): the best ``top`` postings of each row of a candidate
    table (candidate_id, stage, skills, locations), as ranking without texts scores them;
    best first is score desc, pos. Null skills are no skills (half of their part), null
    locations accept any place.

    Candidates are reduced to distinct profiles and postings to distinct titles and
    places. Skills meet titles, and accepted terms places, in equi joins; a profile meets
    only postings whose title names one of its skills, and, for the rest, the ``top``
    freshest postings of its accepted places: any other without a skill is outranked by
    those. Tops are cut before they are shuffled.
    """
    late = gate_stale("posted_date", max_age_days, as_of).fails
    live = postings.filter(~late).select(
        "id", "pos", F.lower(F.coalesce("title", F.lit(""))).alias("title"), canon_location("location").alias("place"), freshness("posted_date", as_of).alias("fresh")
    )
    skills = F.array_sort(F.array_distinct(F.transform(texts_of("skills"), lambda s: F.lower(s))))
    wants = candidates.select("candidate_id", "stage", skills.alias("skills"), accepted_set().alias("accept"))
    wants = wants.withColumn("profile", F.sha2(F.to_json(F.struct("stage", "skills", "accept")), 256))
    profiles = wants.select("profile", "stage", "skills", "accept").dropDuplicates(["profile"])
    places = accepted_places(live.select("place").distinct(), profiles).withColumnRenamed("place", "_p")

    terms = profiles.select(F.explode("skills").alias("term")).distinct().withColumn("_part", F.substring("term", 1, 3))
    parts = live.select("title").distinct().select("title", F.explode(_title_parts(F.col("title"))).alias("_part"))
    named = parts.join(terms, "_part").filter(F.contains("title", F.col("term"))).select("title", "term").distinct()
    each = profiles.select("profile", "accept", F.explode("skills").alias("term"))
    hits = each.join(named, "term").groupBy("profile", "accept", "title").agg(F.count(F.lit(1)).alias("hits"))
    here = F.col("place").eqNullSafe(F.col("_p"))
    skilled = hits.join(live, "title").join(places.withColumnRenamed("accept", "_a"), here & (F.col("accept") == F.col("_a")))
    skilled = skilled.select("profile", "id", "pos", "fresh", "hits")

    def first(df: DataFrame, key: str, *order) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return df.withColumn("_n", place).filter(F.col("_n") <= top).drop("_n")

    newest = first(live, "place", F.col("fresh").desc(), "pos").join(places, here)
    newest = first(newest, "accept", F.col("fresh").desc(), "pos").select("accept", "id", "pos", "fresh")
    others = profiles.select("profile", "accept").join(newest, "accept").select("profile", "id", "pos", "fresh", F.lit(0).cast("bigint").alias("hits"))

    n, w = F.size("skills"), factor_weights(F.col("stage"))
    share = F.when(n == 0, 0.5).otherwise(F.try_divide(F.col("hits").cast("double"), n.cast("double")))
    echo = F.when(n == 0, 0.5).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("hits").cast("double"), F.least(n, F.lit(3)).cast("double"))))
    score = half_up(F.lit(100.0) * (w["skill"] * share + w["title"] * echo + w["freshness"] * F.col("fresh")))
    rows = skilled.union(others).groupBy("profile", "id", "pos", "fresh").agg(F.max("hits").alias("hits"))
    rows = rows.join(profiles.select("profile", "stage", "skills"), "profile").select("profile", "id", "pos", score.alias("score"))
    best = first(rows, "profile", F.col("score").desc(), "pos")
    return wants.select("candidate_id", "profile").join(best, "profile").select("candidate_id", "id", "score")


def with_company(df: DataFrame, registry: DataFrame, slug: str = "slug") -> DataFrame:
    """Display name of a board slug (ignoring case), else the slug."""
    names = registry.groupBy(F.lower("slug").alias("_slug")).agg(F.min("company").alias("_company"))
    out = df.withColumn("_slug", F.lower(slug)).join(names, "_slug", "left")
    return out.withColumn("company", F.coalesce("_company", F.col(slug))).drop("_slug", "_company")


def merge_gap_sources(tracker: DataFrame, ranked: DataFrame) -> DataFrame:
    """Tracker applications and ranked postings as one row per company + role.

    ``tracker`` has company, role, fit_rating, ``inferred`` skills and a date;
    ``ranked`` has company, title, rank_score and recorded ``gaps``. Recorded
    gaps beat inferred skills. Both sides are reduced to one row per pair
    first (latest application, best score), so no pair multiplies.
    """
    t = tracker.groupBy(F.lower("company").alias("company"), F.lower("role").alias("role")).agg(
        F.max_by(F.struct("fit_rating", "inferred"), F.struct("date", "application_id")).alias("t")
    )
    r = ranked.groupBy(F.lower("company").alias("company"), F.lower("title").alias("role")).agg(
        F.max_by(F.struct("rank_score", "gaps"), F.struct("rank_score", "key")).alias("r")
    )
    both = t.join(r, ["company", "role"], "full_outer")
    recorded = F.size(F.coalesce("r.gaps", F.array().cast("array<string>"))) > 0
    none = F.array().cast("array<string>")
    return both.select(
        "company", "role",
        F.col("t").isNotNull().alias("tracked"),
        F.col("t.fit_rating").alias("fit_rating"),
        F.col("r.rank_score").alias("rank_score"),
        F.when(recorded, F.col("r.gaps")).otherwise(F.coalesce("t.inferred", none)).alias("gaps"),
        F.when(recorded, "recorded").otherwise("inferred").alias("provenance"),
    )


def cache_lookup(wanted: DataFrame, cache: DataFrame, as_of, ttl_days: int = vocab.CACHE_TTL_DAYS) -> DataFrame:
    """Latest cached ``value`` per company no older than the TTL (inclusive)
    and not from the future; ``hit`` tells a miss apart."""
    day = as_of_col(as_of)
    fresh = cache.filter(F.col("fetched_date").between(F.date_sub(day, ttl_days), day))
    latest = fresh.groupBy("company").agg(
        F.max_by(F.struct("fetched_date", "value"), F.struct("fetched_date", "value")).alias("_c")
    )
    out = wanted.join(latest, "company", "left")
    return out.select(
        *wanted.columns,
        F.col("_c.fetched_date").alias("fetched_date"),
        F.col("_c.value").alias("value"),
        F.col("_c").isNotNull().alias("hit"),
    )


def cache_lookup_asof(wanted: DataFrame, cache: DataFrame, day: str = "day", ttl_days: int = vocab.CACHE_TTL_DAYS) -> DataFrame:
    """:func:`cache_lookup` with a date of its own in each row (column ``day``): the latest cached
    value of the company that is no older than the TTL on that day and not from after it.

    Both sides are dealt by company and a cell of as many days as the TTL spans, so a day looks into
    its own cell and the one before. Before they meet, the cache is reduced to one value a company and
    day and the rows to the different days of a company, so a company with very many
    rows brings a bounded number to each cell. Rows without a company or a day miss; of values of one
    day the greatest counts.
    """
    width = ttl_days + 1
    cell = lambda d: F.floor(F.unix_date(d) / F.lit(width)).cast("bigint")
    known = cache.filter("company IS NOT NULL AND fetched_date IS NOT NULL").groupBy("company", "fetched_date").agg(F.max("value").alias("value"))
    known = known.withColumn("_cell", cell(F.col("fetched_date")))
    asked = wanted.select(F.col("company"), F.col(day).alias("_day")).filter("company IS NOT NULL AND _day IS NOT NULL").distinct()
    own = cell(F.col("_day"))
    asked = asked.withColumn("_cell", F.explode(F.array(own, own - 1)))
    met = asked.join(known, ["company", "_cell"]).filter(F.col("fetched_date").between(F.date_sub("_day", ttl_days), F.col("_day")))
    latest = met.groupBy("company", "_day").agg(F.max(F.struct("fetched_date", "value")).alias("_c"))
    latest = latest.select(F.col("company").alias("_of"), "_day", "_c")
    out = wanted.join(latest, (F.col("company") == F.col("_of")) & (F.col(day) == F.col("_day")), "left")
    return out.select(*wanted.columns, F.col("_c.fetched_date").alias("fetched_date"), F.col("_c.value").alias("value"), F.col("_c").isNotNull().alias("hit"))


#: Parts that a comparison of tables is cut into, and parts of a part that differs.
COARSE, FINE = 1 << 12, 1 << 8


def column_differences(expected: DataFrame, actual: DataFrame) -> list[tuple[str, str]]:
    """(side, column) of columns that one table alone has, or has with another type."""
    e, a = dict(expected.dtypes), dict(actual.dtypes)
    out = [("missing column", c) for c in e if c not in a] + [("extra column", c) for c in a if c not in e]
    return out + [("other type", c) for c in e if c in a and e[c] != a[c]]


def reconcile_tables(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(what, keys as text, column, expected, actual): every difference between two keyed tables of any size.

    Columns that only one side has, or has with another type, are rows of their own and not compared further. Rows
    are summed up by order-free checksums of parts of the keys, then of parts of the parts that differ; only rows of
    parts that differ there meet in a join, so equal tables move a few numbers. Null keys are keys;
    a key that occurs repeatedly on a side is told, with how often on each.
    """
    sides = column_differences(expected, actual)
    odd = {c for _, c in sides}
    common = [c for c in expected.columns if c in actual.columns and c not in odd and c not in keys]
    if set(keys) & odd:
        raise ValueError(f"key columns differ: {sorted(set(keys) & odd)}")

    def hashed(df: DataFrame) -> DataFrame:
        text = F.to_json(F.struct(*[F.col(k) for k in keys]))
        values = [F.col(c).cast("string").alias(c) for c in common]
        h = F.xxhash64(text, *[F.coalesce(v, F.lit("\0")) for v in values])
        return df.select(text.alias("_key"), F.pmod(F.xxhash64(text), F.lit(COARSE)).alias("_part"), F.pmod(F.hash(text), F.lit(FINE)).alias("_fine"), h.alias("_h"), *values)

    def parts(df: DataFrame, by: list[str], name: str) -> DataFrame:
        total = F.sum(F.col("_h").cast("decimal(38,0)"))
        return df.groupBy(*by).agg(F.struct(F.count(F.lit(1)).alias("n"), total.alias("s")).alias(name))

    def differing(e: DataFrame, a: DataFrame, by: list[str]) -> DataFrame:
        both = parts(e, by, "_e").join(parts(a, by, "_a"), by, "full_outer")
        return cut(both.filter(~F.col("_e").eqNullSafe(F.col("_a"))).select(*by))

    e, a = hashed(expected), hashed(actual)
    coarse = differing(e, a, ["_part"])  # at most COARSE rows
    e, a = (x.join(F.broadcast(coarse), "_part", "left_semi") for x in (e, a))
    fine = differing(e, a, ["_part", "_fine"])  # at most COARSE * FINE rows
    e, a = (x.join(F.broadcast(fine), ["_part", "_fine"], "left_semi") for x in (e, a))
    row = lambda df, name: df.groupBy("_key").agg(F.count(F.lit(1)).alias(f"_n{name}"), F.min(F.struct("_h", *common)).alias(f"_{name}"))
    both = row(e, "e").join(row(a, "a"), "_key", "full_outer")
    text = "what string, key string, column string, expected string, actual string"
    none = F.lit(None).cast("string")
    cell = lambda what, c=none, x=none, y=none: F.struct(F.lit(what).alias("what"), c.alias("column"), x.alias("expected"), y.alias("actual"))
    values = [F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), cell("differs", F.lit(c), F.col(f"_e.{c}"), F.col(f"_a.{c}"))) for c in common]
    found = (
        F.when(F.col("_na").isNull(), F.array(cell("missing")))
        .when(F.col("_ne").isNull(), F.array(cell("extra")))
        .when((F.col("_ne") > 1) | (F.col("_na") > 1), F.array(cell("repeated", none, F.col("_ne").cast("string"), F.col("_na").cast("string"))))
        .otherwise(F.array_compact(F.array(*values)) if values else F.array().cast("array<struct<what:string,column:string,expected:string,actual:string>>"))
    )
    rows = both.select(F.col("_key").alias("key"), F.explode(found).alias("d")).select("d.what", "key", "d.column", "d.expected", "d.actual")
    return rows.union(expected.sparkSession.createDataFrame([(what, None, c, None, None) for what, c in sides], text))


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Differences between two keyed tables: ``detail`` says missing, extra or
    by how much the value differs."""
    e = expected.select(*keys, F.col(value).cast("double").alias("_e"), F.lit(True).alias("_in_e"))
    a = actual.select(*keys, F.col(value).cast("double").alias("_a"), F.lit(True).alias("_in_a"))
    both = e.join(a, list(keys), "full_outer")
    name = F.concat_ws("/", *keys)
    detail = (
        F.when(F.col("_in_a").isNull(), F.concat(F.lit("missing: "), name))
        .when(F.col("_in_e").isNull(), F.concat(F.lit("extra: "), name))
        .when(F.abs(F.col("_e") - F.col("_a")) > tolerance, F.concat(F.lit("differs: "), name))
        .when(F.col("_e").isNull() != F.col("_a").isNull(), F.concat(F.lit("differs: "), name))
    )
    return both.select(*keys, F.col("_e").alias("expected"), F.col("_a").alias("actual"), detail.alias("detail")).filter(
        F.col("detail").isNotNull()
    )


def ratchet(diffs: DataFrame, known: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(diffs with ``known`` pattern or NULL, known patterns with their hits).

    Unexpected differences fail; so does a known pattern without hits, since
    the list of known differences may only shrink.
    """
    match: Column = F.lit(None).cast("string")
    for pattern in reversed(list(known)):
        match = F.when(F.contains("detail", F.lit(pattern)), F.lit(pattern)).otherwise(match)
    classed = diffs.withColumn("known", match)
    hits = F.array(
        *[
            F.struct(F.lit(p).alias("pattern"), F.count_if(F.contains("detail", F.lit(p))).alias("hits"))
            for p in known
        ]
    )
    patterns = diffs.agg(hits.alias("h")).select(F.inline("h")).withColumn("resolved", F.col("hits") == 0)
    return classed, patterns
