"""Removal of long repeats with a run-length index over candidate passages.

Every ``LENGTH``-byte string starts in the domain of one anchor: its least hash of ``GRAM``
bytes (the first of equals). Equal strings have equal anchors, so only segments (all
strings of one anchor run, with the bytes they cover) whose anchor hash occurs again can
hold a repeat (or whose anchor occurs in them twice). Segments that occur again as a whole are repeats without being read.
The other candidates of an anchor meet in one place, where a run-compressed
Burrows-Wheeler transform of their texts is built. At the ends of its runs the length
that a suffix shares with its neighbours is sampled; inside a run it falls by one with
each byte, so the matching statistics of all texts are streamed from these samples, and
positions that match ``LENGTH`` bytes elsewhere are marked.

An anchor with more than ``HEAVY`` different segments (the edge of a passage in very many
documents), or ``HEAVY_BYTES`` of them, is not gathered: hashes of its strings are counted, dealt by string.

Texts are UTF-8 bytes; null reads as empty; matches never cross documents. Repeated rows
are documents of their own, so each is a repeat of the others. Strings are judged on the
input. Every string of the corpus lies in exactly one segment, so none meets itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

LENGTH, GRAM = 200, 32
#: Different segments of an anchor, and their bytes, that are indexed in one place; symbols
#: indexed at once.
HEAVY, HEAVY_BYTES, BATCH = 5_000, 8 << 20, 1 << 20

_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, m = _TABLE[data], 1
    while m < GRAM:
        longer = h * np.uint64((0xBF58476D1CE4E5B9 * (2 * m + 1)) & ((1 << 64) - 1) | 1)
        longer[:-m] += h[m:]
        h, m = longer, 2 * m
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash, whether the anchor occurs in it more
    than once) of every segment of a run of texts, starts counted in the run."""
    n, span = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = gram_hashes(data)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    m = 1
    while 2 * m <= span:
        key[:-m] = np.minimum(key[:-m], key[m:])
        m *= 2
    if span > m:
        key[: n - (span - m)] = np.minimum(key[: n - (span - m)], key[span - m :])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(np.arange(n) + LENGTH <= at[1:][row])
    anchor = (key[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    g, r = h[anchor], row[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ok)) - 1
    if not len(ok):
        last = first
    return r[first], ok[first], ok[last], g[first].view(np.int64), (anchor[first] != anchor[last]).astype(np.int64)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return rank, int(rank[order[-1]]) + 1


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of grouped texts. Suffixes of different
    groups share nothing; kept are the samples at run starts and run ends."""

    def __init__(self, parts: list[bytes], group: np.ndarray):
        size = np.array([len(p) + 1 for p in parts])
        self.start = np.cumsum(size) - size
        self.n = int(size.sum())
        raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        self.symbol = raw.astype(np.int64) + 1
        self.symbol[self.start + size - 1] = 0  # the end of a text
        order = self._suffixes(np.repeat(group, size), int(size.max()))
        own = np.repeat(group, size)[order]
        before = np.concatenate([[0], self.symbol[:-1]])
        before[self.start] = 0
        bwt = before[order]
        starts = np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0) | (own[1:] != own[:-1])])
        ends = np.append(starts[1:], True)
        same = own[1:] == own[:-1]
        k = np.flatnonzero(starts)
        self.up = self._sampled(order[k], order[k - 1], (k > 0) & np.concatenate([[False], same])[k])
        k = np.flatnonzero(ends)
        self.down = self._sampled(order[k], order[(k + 1) % self.n], np.append(same, False)[k])
        self.runs = int(starts.sum())

    def _suffixes(self, group: np.ndarray, longest: int) -> np.ndarray:
        """Places in suffix order within each group; equal suffixes in text order."""
        key = np.zeros(self.n, np.int64)
        for k in range(7):
            key[: self.n - k] |= self.symbol[k:] << (9 * (6 - k))
        # symbols after an end belong to the next text: blank them
        end = np.append(self.start[1:], self.n)[np.searchsorted(self.start, np.arange(self.n), side="right") - 1]
        left = np.minimum(end - np.arange(self.n), 7)
        key &= -(np.int64(1) << (9 * (7 - left)))
        rank, count = _ranks(key)
        rank, count = _ranks(group * np.int64(count) + rank)
        m = 7
        while count < self.n and m < longest:
            at = np.arange(self.n) + m
            inside = at < end
            after = np.zeros(self.n, np.int64)
            after[inside] = rank[at[inside]] + 1
            rank, count = _ranks(rank * np.int64(count + 1) + after)
            m *= 2
        return np.argsort(rank, kind="stable")

    def _sampled(self, place: np.ndarray, other: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in text order, symbols each shares with its neighbour)."""
        shared = np.zeros(len(place), np.int64)
        open_ = np.flatnonzero(real)
        while len(open_):
            a, b = place[open_] + shared[open_], other[open_] + shared[open_]
            go = (self.symbol[a] == self.symbol[b]) & (self.symbol[a] > 0)
            open_ = open_[go]
            shared[open_] += 1
        order = np.argsort(place)
        return place[order], shared[order]

    def matching(self) -> np.ndarray:
        """Matching statistics: the symbols from each place on that occur elsewhere in
        the group, streamed from the samples."""
        out = np.zeros(self.n, np.int64)
        for place, shared in (self.up, self.down):
            last = np.zeros(self.n, np.int64)
            last[place] = np.arange(len(place))
            np.maximum.accumulate(last, out=last)
            np.maximum(out, shared[last] - (np.arange(self.n) - place[last]), out=out)
        return out


def repeated(parts: list[bytes], group: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text the stretches covered by ``LENGTH``-byte strings that also start
    elsewhere in its group."""
    index = RunIndex(parts, group)
    hit = np.flatnonzero(index.matching() >= LENGTH)
    text = np.searchsorted(index.start, hit, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if not len(hit):
        return out
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    for i, j in zip(first, np.append(first[1:], len(hit)) - 1, strict=True):
        k = text[i]
        out[k].append((int(hit[i] - index.start[k]), int(hit[j] - index.start[k]) + LENGTH))
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a 128-bit name of both: rows of one name are alike."""
    d = X.pairs(df, id_col, text_col)
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit("name"), "doc_id").alias("k2"))


def _segments(docs: DataFrame) -> DataFrame:
    """(h, c, k1, k2, a, n, more): anchor hash, hash of the bytes covered, their place,
    1 if the anchor occurs in them more than once."""

    def columns(batch: pa.RecordBatch) -> list:
        import xxhash

        k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
        out: list[list[np.ndarray]] = []
        for lo, _, data, at in X.text_runs(batch.column(0)):
            row, first, last, h, more = segments(data, at)
            raw = data.tobytes()
            c = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
            out.append([h, c.view(np.int64), k1[lo:][row], k2[lo:][row], first - at[row], last - first + LENGTH, more])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return X.map_batches(docs.select("text", "k1", "k2"), columns, "h long, c long, k1 long, k2 long, a long, n long, more long")


def _packed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, z): texts compressed for the way to their marks."""

    def columns(batch: pa.RecordBatch) -> list:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        data, at = X.text_bytes(batch.column(3))
        return [*(batch.column(i) for i in range(3)), pa.array([pack(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]

    return X.map_batches(docs.select("k1", "k2", "doc_id", "text"), columns, "k1 long, k2 long, doc_id long, z binary")


def _unpack(z: pa.Array) -> Iterator[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(x.as_py()) for x in z)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, c, whole, k1, k2, a, s): the bytes of wanted segments, each document being
    opened once."""
    per = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "whole", "a", "n")).alias("w"))

    def columns(batch: pa.RecordBatch) -> list:
        cols: list[list] = [[] for _ in range(7)]
        for k1, k2, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpack(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            for w in want:
                for c, v in zip(cols, (w["h"], w["c"], w["whole"], k1, k2, w["a"], text[w["a"] : w["a"] + w["n"]]), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]

    # rows alike have one name: any of them will do
    one = _packed(docs).select("k1", "k2", "z").join(per, ["k1", "k2"])
    return X.map_batches(one, columns, "h long, c long, whole boolean, k1 long, k2 long, a long, s binary")


def _indexed(texts: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): repeats inside segments that occur once, from an index over all
    different segments of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            h = rows.column("h").to_numpy()
            group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
            found = repeated(rows.column("s").to_pylist(), group)
            once = ~rows.column("whole").to_numpy()
            k1, k2, a = (rows.column(c).to_numpy() for c in ("k1", "k2", "a"))
            marks = [(k1[i], k2[i], a[i] + lo, a[i] + hi) for i, f in enumerate(found) if once[i] for lo, hi in f]
            return pa.RecordBatch.from_arrays([pa.array([m[j] for m in marks], pa.int64()) for j in range(4)], ["k1", "k2", "lo", "hi"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(6).nbytes
            if size < BATCH:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            at = np.concatenate([[0], np.flatnonzero(h[1 : whole + 1] != h[:whole]) + 1]) if whole else np.zeros(1, np.int64)
            ends = np.cumsum([0, *(len(s) + 1 for s in rows.column("s").slice(0, whole).to_pylist())])
            lo = 0
            for hi in at[1:].tolist():
                if ends[hi] - ends[lo] >= BATCH or hi == whole:
                    yield out(rows.slice(lo, hi - lo).combine_chunks())
                    lo = hi
            held = rows.slice(whole).to_batches()
            size = sum(b.column(6).nbytes for b in held) if whole else 0
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    order = texts.repartition("h").sortWithinPartitions("h", "c")
    return order.mapInArrow(run, "k1 long, k2 long, lo long, hi long")


def _counted(texts: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: every string is hashed, counted and
    joined back, dealt by the string."""

    def columns(batch: pa.RecordBatch) -> list:
        import xxhash

        cols: list[list] = [[] for _ in range(5)]
        rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True)
        for h, whole, k1, k2, a, s in rows:
            for i in range(len(s) - LENGTH + 1):
                x = xxhash.xxh3_128_intdigest(s[i : i + LENGTH], h & ((1 << 64) - 1))
                for c, v in zip(cols, (x >> 65, x & ((1 << 63) - 1), k1, k2, -1 if whole else a + i), strict=True):
                    c.append(v)
        return [pa.array(c, pa.int64()) for c in cols]

    strings = X.map_batches(texts, columns, "x1 long, x2 long, k1 long, k2 long, lo long")
    again = strings.groupBy("x1", "x2").agg(F.count("*").alias("m")).where("m > 1").select("x1", "x2")
    return strings.where("lo >= 0").join(again, ["x1", "x2"]).select("k1", "k2", "lo", (F.col("lo") + LENGTH).alias("hi"))


def marks(docs: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): stretches of repeated bytes, overlapping ones among them."""
    found = _segments(docs)
    again = found.groupBy("h").agg(F.sum(1 + F.col("more")).alias("m")).where("m > 1").select("h")
    found = X.cut(found.join(again, "h"))
    per = found.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "a", "n", "more")).alias("one"))
    per = X.cut(per.select("h", "c", (F.col("m") > 1).alias("whole"), "one.*"))
    # in two steps, as an anchor may have very many segments
    kinds = per.groupBy("h").agg(F.count("*").alias("d"), F.sum(1 + F.col("more")).alias("m"), F.sum("n").alias("size")).where("m > 1")
    kinds = kinds.select("h", ((F.col("d") > HEAVY) | (F.col("size") > HEAVY_BYTES)).alias("heavy"))
    open_ = X.cut(_texts(docs, per.join(kinds, "h")).join(kinds, "h"))
    twice = per.where("whole").select("h", "c")
    whole = found.join(twice, ["h", "c"]).select("k1", "k2", F.col("a").alias("lo"), (F.col("a") + F.col("n")).alias("hi"))
    light, heavy = (open_.where(x).drop("heavy") for x in ("NOT heavy", "heavy"))
    return whole.unionByName(_indexed(light)).unionByName(_counted(heavy))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): maximal removed stretches as (start, end) byte
    offsets, and the other bytes of each text."""
    docs = _keyed(df, id_col, text_col)
    per = marks(docs).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("m"))

    def columns(batch: pa.RecordBatch) -> list:
        size, spans, kept = [], [], []
        for text, m in zip(_unpack(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            own: list[list[int]] = []
            for x in sorted(m or [], key=lambda x: (x["lo"], x["hi"])):
                if own and x["lo"] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], x["hi"])
                else:
                    own.append([x["lo"], x["hi"]])
            edges = [0, *(p for s in own for p in s), len(text)]
            size.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]

    both = _packed(docs).join(per, ["k1", "k2"], "left").select("doc_id", "z", "m")
    return X.map_batches(both, columns, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
