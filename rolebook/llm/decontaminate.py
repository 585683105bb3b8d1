"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased. A
fingerprint is the least hash of ``GRAM`` words in every ``WINDOW - GRAM + 1`` neighbouring
ones, so any ``WINDOW`` words that two texts share have a fingerprint in common. Equal
fingerprints of documents and items are joined; for those that meet, the words around the place are
compared with the item's: runs of ``WINDOW`` equal words, or all words of a shorter item, are
inside a window that occurs. Documents are read once, for their number of words as well (once
more where items shorter than a window exist), and what is shuffled are hits and counts.

An item shorter than a window has one fingerprint, its longest word, looked up among all
words of the documents. Null texts have no words; an item without an id is looked for but
not named. Results depend on the text alone, so repeated rows and ids shared by different
texts each get their own; of equal hashes in a window the first counts on both sides. No
documents give no rows; without items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

#: Words of a window that counts as a shared passage, and of a hashed gram.
WINDOW, GRAM = 13, 7
#: Fingerprints of items, and bytes of words around them, up to which they are broadcast; more are
#: joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words. A text of ASCII alone takes the faster function."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.regexp_extract_all(low, F.lit(WORDS), 0)


def _after(column: str, places: int) -> Column:
    """The array without its first ``places`` entries."""
    return F.slice(column, places + 1, F.size(column))


def with_fingerprints(df: DataFrame) -> DataFrame:
    """``df`` with words ``w``, and ``fp``: for every window of ``WINDOW`` words the least hash of
    its ``GRAM``-word grams in the upper bits and its place (from 0) in the lower 31, each
    once; of equal hashes the first. Hashes and minima are doubled: two words, four, then
    two overlapping fours, so a word is hashed once and meets six combinations. At the end of an array a
    combination lacks its second part; what it gives is cut off with the last windows."""
    span = WINDOW - GRAM + 1
    hashed = lambda a, b: F.xxhash64(a, b)
    low = lambda a, b: F.least(a, b)
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    for shift in (1, 2, GRAM - 4):
        df = df.withColumn("h", F.zip_with("h", _after("h", shift), hashed))
    upper = F.lit(-1 << 31).cast("long")
    df = df.withColumn("h", F.transform("h", lambda x, i: x.bitwiseAND(upper).bitwiseOR(i.cast("long"))))
    # the grams of the last words reach past the end
    df = df.withColumn("h", F.slice("h", 1, F.greatest(F.size("w") - (GRAM - 1), F.lit(0))))
    for shift in (1, 2, span - 4):
        df = df.withColumn("h", F.zip_with("h", _after("h", shift), low))
    return df.withColumn("fp", F.array_distinct(F.slice("h", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))).drop("h")


def placed(fp: Column) -> tuple[Column, Column]:
    """(hash, place) of a fingerprint."""
    return F.shiftright(fp, 31), fp.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _left(place: Column) -> Column:
    """Words before a gram that a window with it can reach."""
    return F.least(place, F.lit(WINDOW - GRAM))


def _near(w: str, place: Column) -> Column:
    """The words of all windows that hold the gram at a place."""
    return F.slice(w, place - _left(place) + 1, _left(place) + WINDOW)


def _small(df: DataFrame) -> bool:
    """Whether ``df`` has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes of words."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    size = df.agg(F.sum(F.aggregate("item_near", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("string").alias("item"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))


def _known(items: DataFrame) -> DataFrame:
    """(item, known, item_left, item_near): fingerprints of items of at least a window, the words
    around each and how many of them come before it."""
    own = with_fingerprints(items.where(F.size("w") >= WINDOW)).select("item", "w", F.explode("fp").alias("f"))
    h, place = placed(F.col("f"))
    return own.select("item", h.alias("known"), _left(place).alias("item_left"), _near("w", place).alias("item_near")).distinct()


def _short(items: DataFrame) -> DataFrame:
    """The same for items under a window: the hash of their longest word stands for them."""
    items = items.where((F.size("w") > 0) & (F.size("w") < WINDOW))
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("n"), x.alias("x"), (-i).alias("p"))))
    items = items.select("item", "w", longest.alias("l"))
    return items.select("item", F.xxhash64("l.x").alias("known"), (-F.col("l.p")).alias("item_left"), F.col("w").alias("item_near")).distinct()


def bounds(same: Column) -> Column:
    """-1, the places that are not true, and the size of an array of booleans."""
    off = F.filter(F.transform(same, lambda x, i: F.when(~F.coalesce(x, F.lit(False)), i)), lambda i: i.isNotNull())
    return F.concat(F.array(F.lit(-1)), off, F.array(F.size(same)))


def runs(b: Column, need: int) -> Column:
    """(a, z), first and last place of each run of at least ``need`` between bounds."""
    gaps = F.transform(b, lambda x, i: F.struct((x + 1).alias("a"), (F.get(b, i + 1) - 1).alias("z")))
    return F.filter(F.slice(gaps, 1, F.size(b) - 1), lambda r: r["z"] - r["a"] + 1 >= need)


def _met(docs: DataFrame, marks: Column, split, known: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, w, place, item, item_left, item_near): each mark of documents
    (doc_id, text_key, w ...) whose hash is known. ``split`` turns a mark into (hash, place).
    One row a document without place or item tells its number of words, ``n``.

    The words ride along a broadcast join, where only rows that meet are written. For more
    items marks and hashes alone are shuffled, and the words of documents with a hit are
    fetched afterwards."""
    keys = ["doc_id", "text_key"]
    every = F.concat(F.array(F.lit(None)), marks)
    each = docs.select(*keys, F.size("w").alias("n"), "w", F.explode(every).alias("f"))
    h, place = split(F.col("f"))
    # a document's own row meets the one without an item, whatever the marks are
    nothing = known.limit(0).sparkSession.range(1).select(*(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns))
    all_ = known.unionByName(nothing)
    if _small(known):
        each = each.select(*keys, "n", "w", h.alias("h"), place.alias("place"))
        return each.join(F.broadcast(all_), F.col("h").eqNullSafe(F.col("known"))).drop("h", "known")
    each = each.select(*keys, "n", h.alias("h"), place.alias("place"))
    found = X.cut(each.where("h IS NOT NULL").join(known, F.col("h") == F.col("known")).drop("h", "known", "n"))
    wanted = found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "place", "item", "item_left", "item_near")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    texts = docs.select(*keys, "w").join(wanted.select("hit_id", "hit_key").distinct(), same, "left_semi").dropDuplicates(keys)
    there = texts.join(wanted, same).select(*keys, F.size("w").alias("n"), "w", "place", "item", "item_left", "item_near")
    own = docs.select(*keys, F.size("w").alias("n"), F.lit(None).cast("array<string>").alias("w"), F.lit(None).cast("int").alias("place"))
    return there.unionByName(own, allowMissingColumns=True)


def _windows(met: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, item, first, last): runs of words inside windows of an item; rows
    without an item stay as they are."""
    keys = ["doc_id", "text_key", "n", "item"]
    left = _left(F.col("place"))
    both = F.least(left, "item_left")  # words before the gram that both have
    near = F.slice("w", F.col("place") - both + 1, both + WINDOW)
    met = met.withColumn("start", F.col("place") - both).withColumn("both", both).withColumn("near", F.when(F.col("place").isNotNull(), near))
    same = F.zip_with("near", F.slice("item_near", F.col("item_left") - F.col("both") + 1, F.col("both") + WINDOW), lambda x, y: x == y)
    met = met.select(*keys, "start", same.alias("same"))
    met = met.withColumn("b", bounds(F.col("same")))
    met = met.select(*keys, "start", F.explode_outer(runs(F.col("b"), WINDOW)).alias("r")).where("r IS NOT NULL OR start IS NULL")
    return met.select(*keys, (F.col("start") + F.col("r.a")).alias("first"), (F.col("start") + F.col("r.z")).alias("last"))


def _whole(met: DataFrame) -> DataFrame:
    """The same for short items, all of whose words must be there."""
    keys = ["doc_id", "text_key", "n", "item"]
    first = F.col("place") - F.col("item_left")
    same = (first >= 0) & (F.slice("w", F.greatest(first, F.lit(0)) + 1, F.size("item_near")) == F.col("item_near"))
    met = met.where(same)
    return met.select(*keys, first.alias("first"), (first + F.size("item_near") - 1).alias("last"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, item, first, last): runs of words of documents that are inside
    windows of the item, from documents (doc_id, text_key, w) and items (item, w), and a row
    without run and item for each document; n words each."""
    known = X.cut(_known(items))
    out = _windows(_met(with_fingerprints(docs), F.col("fp"), placed, known))
    short = _short(items)
    if not short.isEmpty():
        marks = F.transform("w", lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i")))
        there = _met(docs, marks, lambda f: (f["h"], f["i"]), X.cut(short)).where("item_left IS NOT NULL")
        out = out.unionByName(_whole(there))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("text_key"), words(F.col("t")).alias("w"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items): words of each document, those inside
    an occurring window, and the ids, sorted as strings, of the items with one."""
    keys = ["doc_id", "text_key", "n"]
    found = hits(_keyed(docs, id_col, text_col), _items(items, item_col, item_text))
    # a place, an item, or a document itself a row, counted and named by document in one pass
    nothing = F.lit(None)
    place = F.transform(F.sequence("first", "last"), lambda p: F.struct(p.alias("place"), nothing.cast("string").alias("item")))
    name = F.array(F.struct(nothing.cast("int").alias("place"), F.col("item").alias("item")))
    both = F.when(F.col("first").isNull(), name).otherwise(F.concat(place, name))
    own = F.col("first").isNull().cast("int").alias("own")
    both = found.select(*keys, own, F.explode(both).alias("x")).select(*keys, "own", "x.*")
    both = both.groupBy(*keys, "place", "item").agg(F.sum("own").alias("own"))
    hit = both.groupBy(*keys).agg(F.count("place").alias("n_hit"), F.sort_array(F.collect_list("item")).alias("items"), F.sum("own").alias("rows"))
    # rows alike were counted as one document
    hit = hit.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return hit.select("doc_id", "text_key", F.col("n").cast("long").alias("n_words"), "n_hit", "items")


def contaminated() -> Column:
    """At least a twentieth of the words, and one, inside occurring windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever
    their names. Null texts have no words and stay; rows alike stay or go together."""
    bad = report(docs, items, id_col=id_col, text_col=text_col, **columns).where(contaminated())
    bad_id, bad_key = X.fresh(docs, "bad_id", "bad_key")
    bad = bad.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (key == F.col(bad_key)), "left_anti")
