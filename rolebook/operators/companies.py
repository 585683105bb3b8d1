"""Fuzzy company matching as equi joins.

A pair scores at all only when the names share a core word or one key
contains the other. Both are found exactly, without comparing other pairs:
shared words by a join on the word, containment by joining whole keys to the
substrings of the longer key. Names are reduced to distinct ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.names import anglicize, company_key, core_words
from rolebook.session import cut


def name_forms(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Distinct names with their key and core words; keyless names drop out
    because nothing can match them."""
    forms = df.select(F.col(column).alias(prefix)).distinct().select(
        prefix, company_key(prefix).alias(f"{prefix}_key"), core_words(prefix).alias(f"{prefix}_words")
    )
    return forms.filter(F.col(f"{prefix}_key") != "")


def match_score(q: Column, n: Column, q_words: Column, overlap: Column) -> Column:
    """0-100 from two keys, the query's word count and the shared words."""
    def ratio(short, long):
        return F.length(short).cast("double") / F.length(long)

    def contained(short, long):
        r = ratio(short, long)
        return F.contains(long, short), (F.length(short) <= 4) & (r < 0.5), F.lit(80) + F.floor(r * 10).cast("int")

    q_in, q_short, q_score = contained(q, n)
    n_in, n_short, n_score = contained(n, q)
    coverage = F.floor(F.lit(30.0) + F.try_divide(overlap.cast("double"), q_words.cast("double")) * 40).cast("int")
    return (
        F.when(q == n, 100)
        .when(q_in & (~q_short | (overlap > 0)), q_score)
        .when(n_in & ~n_short, n_score)
        .when(n_in & (overlap > 0), 75)
        .when(overlap == 0, 0)
        .when(q_words == 1, 70)
        .otherwise(coverage)
    )


#: Longest substring that is joined whole. Longer keys are looked up by their
#: first characters, so a key of any length yields a linear number of parts.
PART = 16


def _substrings(key: Column) -> Column:
    """Substrings long enough to score by containment alone, up to PART."""
    n = F.length(key)
    lengths = F.filter(F.sequence(F.lit(1), F.least(n, F.lit(PART))), lambda k: (k >= 5) | (k * 2 >= n))
    return F.array_distinct(
        F.flatten(
            F.transform(
                lengths,
                lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(key, i, k)),
            )
        )
    )


def _contained_pairs(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """Pairs where the needle's key is inside the other key. A needle longer
    than PART is found by its start; scoring checks the rest of it."""
    parts = hays.select(hay, F.explode(_substrings(F.col(f"{hay}_key"))).alias("_part"))
    starts = needles.select(needle, F.substring(f"{needle}_key", 1, PART).alias("_part"))
    return parts.join(starts, "_part").select("query", "company")


def match_names(queries: DataFrame, companies: DataFrame, floor: int = vocab.MATCH_FLOOR) -> DataFrame:
    """(query, company, score) for every pair of distinct names at or above
    the floor. ``queries`` has ``query``, ``companies`` has ``company``."""
    q = name_forms(queries, "query", "query")
    c = name_forms(companies, "company", "company")
    shared = (
        q.select("query", F.explode("query_words").alias("_word"))
        .join(c.select("company", F.explode("company_words").alias("_word")), "_word")
        .select("query", "company", F.lit(1).alias("_shared"))
    )
    inside = _contained_pairs(q, "query", c, "company").union(_contained_pairs(c, "company", q, "query"))
    pairs = (
        shared.unionByName(inside.withColumn("_shared", F.lit(0)))
        .groupBy("query", "company")
        .agg(F.sum("_shared").alias("_shared"))
    )
    scored = (
        pairs.join(q, "query")
        .join(c, "company")
        .withColumn(
            "score",
            match_score(F.col("query_key"), F.col("company_key"), F.size("query_words"), F.col("_shared")),
        )
    )
    return scored.filter(F.col("score") >= floor).select("query", "company", "score")


#: Names with a frequent word are dealt to one more task for each so many of them.
SPREAD = 20_000


def _best(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, cut before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")


def _pair_score() -> Column:
    shared = F.size(F.array_intersect("query_words", "company_words"))
    return match_score(F.col("query_key"), F.col("company_key"), F.size("query_words"), shared)


def best_names(queries: DataFrame, companies: DataFrame, k: int, floor: int = vocab.MATCH_FLOOR) -> DataFrame:
    """(query, company, score): the ``k`` best matches of each distinct query name, as
    :func:`match_names` scores them; best first is score desc, company asc.

    A word that very many names share makes no pairs beyond the result. The first ``k`` names of
    each word stand for all that share one word, and for each part of a name the ``k`` best that contain
    it. They give each query a floor; a name past them must share so many words that its score reaches
    the floor, so it has one of the query's rarest words (all but as many as may be
    missing), and only those words' lists are opened. Lists of frequent words are dealt to several tasks.
    Names without a key match nothing. Intermediate tables go to the shared folder.
    """
    q, c = cut(name_forms(queries, "query", "query")), cut(name_forms(companies, "company", "company"))
    by_name = F.col("company").asc()
    lists = c.select(F.explode("company_words").alias("word"), "*")
    own = q.select(F.explode("query_words").alias("word"), "*")

    # what shares a word: the first by name, and all where one of the keys is short (its own rules)
    firsts = _best(lists, ["word"], k, by_name)
    short = lists.filter(F.length("company_key") <= 4)
    seeds = own.join(firsts.union(short).distinct(), "word").drop("word")
    # what holds the other's key: the best for each part; a part of full length may go on
    parts = c.select("*", F.explode(_substrings(F.col("company_key"))).alias("_part"))
    whole = _best(parts.filter(F.length("_part") < PART), ["_part"], k, F.length("company_key"), by_name)
    level = F.floor(F.length("_part") * 10 / F.length("company_key"))
    whole = whole.union(_best(parts.filter(F.length("_part") < PART), ["_part"], k, level.desc(), by_name)).distinct()
    starts = q.select("*", F.substring("query_key", 1, PART).alias("_part"))
    holding = starts.join(whole.union(parts.filter(F.length("_part") == PART)), "_part").drop("_part")
    keyed = _best(c, ["company_key"], k, by_name).select("*", F.substring("company_key", 1, PART).alias("_part"))
    held = q.select("*", F.explode(_substrings(F.col("query_key"))).alias("_part")).join(keyed, "_part").drop("_part")
    met = seeds.unionByName(holding).unionByName(held).select("query", "company", _pair_score().alias("score"))
    known = cut(_best(met.filter(F.col("score") >= floor).distinct(), ["query"], k, F.col("score").desc(), by_name))

    full = known.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    counts = lists.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = own.select("query", "word").join(counts, "word").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("rare"))
    asked = q.join(rare, "query").join(full.select("query", "least"), "query", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(floor)), F.lit(floor)))
    n = F.size("query_words")
    coverage = lambda s: F.floor(F.lit(30.0) + F.try_divide(s.cast("double"), n.cast("double")) * 40).cast("int")
    enough = F.filter(F.sequence(F.lit(1), n), lambda s: (s >= 2) & (coverage(s) >= F.col("least")))
    need = F.when(F.length("query_key") <= 4, F.lit(1)).otherwise(F.get(enough, F.lit(0)))
    opened = F.transform(F.slice("rare", 1, F.greatest(F.size("rare") - need + 1, F.lit(0))), lambda r: r["word"])
    opened = asked.filter(need.isNotNull()).withColumn("opened", opened).select("*", F.explode("opened").alias("word")).drop("rare")
    tasks = counts.select(F.col("word").alias("_word"), (F.floor(F.col("n") / SPREAD) + 1).alias("tasks")).filter("tasks > 1")
    dealt = lambda df: df.join(tasks, F.col("word") == F.col("_word"), "left").drop("_word")
    opened = dealt(opened).withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    spread = dealt(lists).withColumn("task", F.pmod(F.xxhash64("company"), F.coalesce("tasks", F.lit(1)))).drop("tasks")
    more = opened.join(spread, ["word", "task"])
    # a pair that shares several opened words is taken at the rarest
    more = more.filter(F.get(F.filter("opened", lambda w: F.array_contains(F.col("company_words"), w)), F.lit(0)) == F.col("word"))
    more = more.withColumn("score", _pair_score()).filter(F.col("score") >= F.col("least")).select("query", "company", "score")
    more = _best(more, ["query"], k, F.col("score").desc(), by_name)
    return _best(known.union(more).distinct(), ["query"], k, F.col("score").desc(), by_name)


def in_city(city: str) -> Column:
    """City substring, with or without special letters."""
    entry = F.coalesce(F.lower("city"), F.lit(""))
    want = F.lit(city.lower())
    return F.contains(entry, want) | F.contains(anglicize(entry), anglicize(want))


def match_companies(queries: DataFrame, companies: DataFrame, city: str | None = None, floor: int = vocab.MATCH_FLOOR) -> DataFrame:
    """Matching company entries (all their columns) per query, with ``score``.
    Best first is score desc, company asc."""
    entries = companies.filter(in_city(city)) if city else companies
    return match_names(queries, entries, floor).join(entries, "company")


def best_companies(queries: DataFrame, companies: DataFrame, k: int, city: str | None = None, floor: int = vocab.MATCH_FLOOR) -> DataFrame:
    """Entries (all their columns) of the ``k`` best matching names of each query, with ``score``."""
    entries = companies.filter(in_city(city)) if city else companies
    return best_names(queries, entries, k, floor).join(entries, "company")
