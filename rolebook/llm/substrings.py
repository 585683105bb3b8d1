"""Passages that an earlier document holds, by prefix-partitioned suffix trees over words.

A suffix starts at every place with ``LENGTH`` words before the end of its text. Its prefix
runs up to the end of its anchor, the least hashed ``GRAM`` words among its first
``LENGTH`` (the first of equals): prefixes of 16 to 50 words, longer where the anchor lies
later. Equal suffixes have equal prefixes, and the suffixes whose prefixes end in one anchor
are neighbours, so they travel together as one segment of at most 84 words. An anchor
that occurs in one document alone has no suffix to tell. Segments alike are one class that
knows its least document, so copies are never compared with each other.

Anchors are packed into groups of ``BATCH`` words. A group's suffixes are sorted by ranks of
1, 2, 4 ... words, neighbours give the words they share, and every stretch of neighbours
that share ``LENGTH`` or more is a deep internal node of the group's tree: a maximal
repeat whose least document is the least of its leaves. An anchor whose different
segments have more than ``HEAVY`` words is dealt by the longest prefix instead, the whole
window: there a subtree is its deep node alone, and the least document a plain minimum.

Words are runs without ASCII blanks, unchanged, compared by 64-bit hashes. Null and empty
texts have no words. A document without an id is before and after none: nothing is
removed from it or because of it. Rows with one id are the same document, so a passage
shared by them alone stays; rows alike each get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

LENGTH, GRAM = 50, 16
#: Words of an anchor's different segments that make one tree; words of a group of anchors.
HEAVY, BATCH = 1 << 18, 1 << 18

_SYMBOL = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0xE7037ED1A0B428DB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of the words of a run of texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return np.searchsorted(at, first, side="right") - 1, first, end


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each word, about ``chunk`` bytes of text at a time."""
    out = np.empty(len(first), np.uint64)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + chunk)))
        size = end[lo:hi] - first[lo:hi]
        start = np.cumsum(size) - size
        n = int(size.sum())
        place = np.arange(n) - np.repeat(start, size)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _STEP)]))
        total = np.add.reduceat(_SYMBOL[data[place + np.repeat(first[lo:hi], size)]] * power[place], start)
        out[lo:hi] = _mixed(total + size.astype(np.uint64))
        lo = hi
    return out


def gram_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) words from each place on, by doubling."""
    h, m = w, 1
    while m < size:
        longer = _mixed(h + np.uint64(m))
        longer[:-m] += h[m:] * _STEP
        h, m = longer, 2 * m
    return _mixed(h)


def segments(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash, hash of the words covered) of the
    segments of texts with word hashes ``w``, text k having words at[k] to at[k + 1]."""
    n, span = len(w), LENGTH - GRAM + 1
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(np.arange(n) + LENGTH <= at[1:][row]) if n else np.zeros(0, np.int64)
    if not len(ok):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = gram_hashes(w, GRAM)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    m = 1
    while 2 * m <= span:
        key[:-m] = np.minimum(key[:-m], key[m:])
        m *= 2
    if span > m:
        key[: n - (span - m)] = np.minimum(key[: n - (span - m)], key[span - m :])
    anchor = (key[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(ok), bool)
    new[1:] = anchor[1:] != anchor[:-1]  # a place is in one text, so a new text is new as well
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ok)) - 1
    a, z = ok[first], ok[last]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LENGTH + span, _STEP)]))
    size = z - a + LENGTH
    start = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    covered = _mixed(np.add.reduceat(w[place + np.repeat(a, size)] * power[place], start) + size.astype(np.uint64))
    return row[a], a, z, h[anchor[first]].view(np.int64), covered.view(np.int64)


class SubTree:
    """Deep internal nodes of the suffix tree of a group of segments.

    ``parts`` are arrays of word hashes; every place of a part with ``LENGTH`` words before
    its end is a suffix. ``part`` and ``start`` name the suffixes in order, node k holds
    those from ``first[k]`` to ``last[k]``, which share ``depth[k]`` words (told up to 63;
    0 where it is a leaf).
    """

    def __init__(self, parts: list[np.ndarray]):
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        rank = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int64)
        n = len(rank)
        end = np.repeat(begin + size, size)
        levels, m = [rank], 1
        while m < 32:
            after = np.full(n, -1, np.int64)
            after[:-m] = np.where(np.arange(n - m) + m < end[: n - m], levels[-1][m:], -1)
            levels.append(np.unique(levels[-1] * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
            m *= 2
        place = np.flatnonzero(np.arange(n) + LENGTH <= end)
        # 32 words and the 32 that end with the window: all LENGTH of them
        order = np.lexsort((levels[-1][place + LENGTH - 32], levels[-1][place]))
        place = place[order]
        shared = np.zeros(max(len(place) - 1, 0), np.int64)
        a, b = place[:-1].copy(), place[1:].copy()
        for level in range(5, -1, -1):
            inside = (a < end[place[:-1]]) & (b < end[place[1:]])
            same = np.zeros(len(a), bool)
            same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
            # equal ranks may both stop at an end: then no more than what is left is shared
            step = np.minimum(np.int64(1) << level, np.minimum(end[place[:-1]] - a, end[place[1:]] - b))
            shared += np.where(same, step, 0)
            a, b = a + np.where(same, step, 0), b + np.where(same, step, 0)
        deep = shared >= LENGTH
        new = np.concatenate([[True], ~deep]) if len(place) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(place)) - 1 if len(place) else self.first
        none = np.iinfo(np.int64).max
        low = np.append(np.where(deep, shared, none), none)
        self.depth = np.minimum.reduceat(low, self.first) if len(place) else self.first
        self.depth[self.depth == none] = 0
        self.part = np.searchsorted(begin, place, side="right") - 1
        self.start = place - begin[self.part]

    def least(self, of_part: np.ndarray) -> np.ndarray:
        """For each suffix the least value of its node, leaves valued by their part."""
        if not len(self.first):
            return np.zeros(0, of_part.dtype)
        low = np.minimum.reduceat(of_part[self.part], self.first)
        return np.repeat(low, self.last - self.first + 1)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a 128-bit name of both: rows of one name are alike."""
    d = X.pairs(df, id_col, text_col)
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit("name"), "doc_id").alias("k2"))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _segments(docs: DataFrame) -> DataFrame:
    """(h, c, doc_id, k1, k2, a, n): anchor, hash of the words covered, their document,
    first word and number."""

    def columns(batch: pa.RecordBatch) -> list:
        k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
        ids = batch.column(3)
        out: list[list[np.ndarray]] = []
        for lo, _, data, at in X.text_runs(batch.column(0)):
            row, first, end = places(data, at)
            starts = np.searchsorted(row, np.arange(len(at)))
            r, a, z, h, c = segments(word_hashes(data, first, end), starts)
            out.append([r + lo, h, c, k1[lo:][r], k2[lo:][r], a - starts[r], z - a + LENGTH])
        at, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
        return [ids.take(pa.array(at)), *rest]

    return X.map_batches(docs.select("text", "k1", "k2", "doc_id"), columns, f"doc_id {_kind(docs)}, h long, c long, k1 long, k2 long, a long, n long")


def _packed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, z): texts compressed for the way to their marks."""

    def columns(batch: pa.RecordBatch) -> list:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        data, at = X.text_bytes(batch.column(3))
        return [*(batch.column(i) for i in range(3)), pa.array([pack(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]

    return X.map_batches(docs.select("k1", "k2", "doc_id", "text"), columns, f"k1 long, k2 long, doc_id {_kind(docs)}, z binary")


def _unpacked(z: pa.Array) -> Iterator[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (np.frombuffer(unpack(z[i].as_py()), np.uint8) for i in range(len(z)))


def _words(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, c, low, heavy, w): the word hashes of each class, read from the document that
    stands for it, which is opened once."""
    per = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "low", "heavy", "a", "n")).alias("want"))

    def columns(batch: pa.RecordBatch) -> list:
        want = batch.column(1)
        flat, out = want.flatten(), []
        a, n = (flat.field(i).to_numpy() for i in (4, 5))
        ends = np.cumsum(want.value_lengths().to_numpy())
        lo = 0
        for data, hi in zip(_unpacked(batch.column(0)), ends.tolist(), strict=True):
            _, first, end = places(data, np.array([0, len(data)]))
            w = word_hashes(data, first, end)
            out += [w[x : x + k].tobytes() for x, k in zip(a[lo:hi].tolist(), n[lo:hi].tolist(), strict=True)]
            lo = hi
        return [*(flat.field(i) for i in range(4)), pa.array(out, pa.binary())]

    # rows alike have one name: any of them will do
    one = _packed(docs).join(per, ["k1", "k2"]).select("z", "want")
    return X.map_batches(one, columns, f"h long, c long, low {_kind(docs)}, heavy boolean, w binary")


def _in_trees(found: DataFrame) -> DataFrame:
    """(h, c, lo, hi, low): for windows lo to hi of a class the least document (as its
    rank) with them, from a tree over each group of anchors. Input: (h, c, low, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            parts = [np.frombuffer(x[3], np.uint64) for x in held]
            value = np.unique(np.array([x[2] for x in held]), return_inverse=True)
            tree = SubTree(parts)
            low = tree.least(value[1])
            order = np.lexsort((tree.start, tree.part))
            part, start, low = tree.part[order], tree.start[order], low[order]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (low[1:] != low[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(part)) - 1
            h, c = (np.array([x[i] for x in held], np.int64)[part[first]] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, start[first], start[last], value[0][low[first]])], ["h", "c", "lo", "hi", "low"])

        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != last and size >= BATCH:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // 8
                last = row[0]
        if held:
            yield out()

    kind = found.schema["low"].dataType.simpleString()
    order = found.repartition("h").sortWithinPartitions("h")
    return order.select("h", "c", "low", "w").mapInArrow(run, f"h long, c long, lo long, hi long, low {kind}")


def _by_window(found: DataFrame) -> DataFrame:
    """The same for anchors with very many segments, dealt by the longest prefix."""
    kind = found.schema["low"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            size = np.array([len(p) for p in parts])
            begin = np.cumsum(size) - size
            part = np.repeat(np.arange(len(parts)), size - LENGTH + 1)
            start = np.arange(len(part)) - np.repeat(np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1), size - LENGTH + 1)
            place = begin[part] + start
            w = np.concatenate(parts)
            h32 = gram_hashes(w, 32)
            p = h32[place] + h32[place + LENGTH - 32] * _STEP
            other = gram_hashes(w ^ np.uint64(0xD6E8FEB86659FD93), 32)
            q = _mixed(other[place] * _STEP + other[place + LENGTH - 32])
            own = [batch.column(i).take(pa.array(part)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), *own[:2], pa.array(start), own[2]], ["p", "q", "h", "c", "lo", "low"])

    each = found.select("h", "c", "low", "w").mapInArrow(run, f"p long, q long, h long, c long, lo long, low {kind}")
    least = each.groupBy("p", "q").agg(F.min("low").alias("least"), F.count("*").alias("m")).where("m > 1").select("p", "q", "least")
    own = found.select("h", "c", F.lit(0).cast("long").alias("lo"), F.expr("octet_length(w) div 8").alias("hi"), "low")
    own = own.select("h", "c", "lo", (F.col("hi") - LENGTH).alias("hi"), "low")  # what is in the class itself
    return own.unionByName(each.join(least, ["p", "q"]).select("h", "c", "lo", F.col("lo").alias("hi"), F.col("least").alias("low")))


def marks(docs: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): stretches of words (end exclusive) inside windows that start in
    a document before."""
    found = _segments(docs.where("doc_id IS NOT NULL"))
    again = found.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("h")
    again = X.cut(again)  # so that a frequent anchor is split in the join
    found = X.cut(found.join(again, "h"))
    classes = found.groupBy("h", "c").agg(F.min("doc_id").alias("low"), F.min(F.struct("k1", "k2", "a", "n")).alias("one"))
    classes = X.cut(classes.select("h", "c", "low", "one.*"))
    # in two steps, as an anchor may have very many segments
    heavy = classes.groupBy("h").agg(F.sum("n").alias("size")).where(F.col("size") > HEAVY).select("h", F.lit(True).alias("heavy"))
    classes = classes.join(heavy, "h", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    open_ = X.cut(_words(docs, classes))
    least = _in_trees(open_.where("NOT heavy")).unionByName(_by_window(open_.where("heavy")))
    least = least.withColumnRenamed("low", "least")
    hit = found.join(least, ["h", "c"]).where("least < doc_id")
    return hit.select("k1", "k2", (F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi") + LENGTH).alias("hi"))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept): maximal removed stretches as (start, end) word
    places, and the other words of each text joined by one space."""
    docs = _keyed(df, id_col, text_col)
    per = marks(docs).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("m"))

    def columns(batch: pa.RecordBatch) -> list:
        size, spans, kept = [], [], []
        for data, m in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            _, first, end = places(data, np.array([0, len(data)]))
            gone = np.zeros(len(first) + 1, np.int64)
            for x in m or ():
                gone[x["lo"]] += 1
                gone[x["hi"]] -= 1
            gone = np.concatenate([[0], np.cumsum(gone)[:-1] > 0, [0]])
            change = np.diff(gone)
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True)])
            raw = data.tobytes()
            left = np.flatnonzero(gone[1:-1] == 0)
            kept.append(b" ".join(raw[a:b] for a, b in zip(first[left].tolist(), end[left].tolist(), strict=True)).decode())
            size.append(len(first))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]

    both = _packed(docs).join(per, ["k1", "k2"], "left").select("doc_id", "z", "m")
    return X.map_batches(both, columns, f"doc_id {_kind(docs)}, n_words long, spans array<struct<start:long,end:long>>, kept string")
