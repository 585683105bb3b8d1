"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint bit is the majority of that bit over the XXH64 of all word shingles. Two
fingerprints link at ``DISTANCE`` or fewer differing bits, so of ``DISTANCE + 1`` blocks of
bits at least one is equal: distinct fingerprints meet in a bucket for each block's value
(a bucket of more than ``HEAVY`` is dealt again by blocks of the other bits). Inside a
bucket they are sorted by Gray rank, neighbours are grouped level by level, and each
group keeps the bits its members share. Pairs of groups are followed downwards: a pair
whose shared bits already differ too much is pruned, one that cannot differ too much is
linked as a whole, one that is connected already is left. A bucket returns one link for
each member of a component, so no group is ever expanded into all its pairs.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows and exact
copies share a fingerprint. A component is named by its smallest id; an id that is null
names none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: (first bit, bits) of the blocks, and of the blocks of the 51 or 52 other bits.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
INNER = ((0, 10), (10, 10), (20, 10), (30, 10), (40, 12))
#: Fingerprints of a bucket past which it is dealt again; members of an index node;
#: pairs of nodes followed at once.
HEAVY, FAN, PAIRS = 20_000, 8, 1 << 18


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    parts = [joined[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def columns(batch: pa.RecordBatch) -> list:
        fp = np.array([fingerprint(t) for t in X.strings(batch.column(1))], np.uint64)
        return [batch.column(0), pa.array(fp.view(np.int64))]

    return X.map_batches(X.pairs(df, id_col, text_col), columns, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbours differ in one bit."""
    out = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Index:
    """The hierarchy over fingerprints in (bucket, Gray rank) order: for each level the
    first member of every node, the bits its members share, and their values."""

    def __init__(self, bucket: np.ndarray, code: np.ndarray):
        self.code, self.n = code, len(code)
        self.label = np.arange(self.n)
        first = np.arange(self.n)
        self.first, self.value, self.shared = [first], [code], [np.full(self.n, ~np.uint64(0))]
        self.child: list[np.ndarray] = [np.arange(self.n + 1)]
        own = bucket
        while True:
            new = np.concatenate([[True], own[1:] != own[:-1]])
            if new.all():
                break
            place = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
            at = np.flatnonzero(place % FAN == 0)
            every = np.bitwise_and.reduceat(self.value[-1], at)
            # bits that all members share and on which they agree
            shared = np.bitwise_and.reduceat(self.shared[-1], at) & ~(every ^ np.bitwise_or.reduceat(self.value[-1], at))
            self.child.append(np.append(at, len(own)))
            self.first.append(self.first[-1][at])
            self.shared.append(shared)
            self.value.append(every & shared)
            own = own[at]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Members a[i] and b[i] are in one component: least labels, pointers halved."""
        a, b = self.label[a], self.label[b]
        while True:
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            a, b = self.label[a], self.label[b]

    def one(self, level: int) -> np.ndarray:
        """The component of each node's members, -1 where there are several."""
        low = np.minimum.reduceat(self.label, self.first[level])
        return np.where(low == np.maximum.reduceat(self.label, self.first[level]), low, -1)

    def chain(self, level: int, nodes: np.ndarray) -> None:
        """Link all members of each of the nodes."""
        ends = np.append(self.first[level], self.n)
        size = ends[nodes + 1] - ends[nodes]
        member = np.repeat(ends[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.link(member, np.repeat(ends[nodes], size))

    def join(self) -> np.ndarray:
        """Labels after linking every pair of one bucket within ``DISTANCE``."""
        top = len(self.first) - 1
        roots = np.arange(len(self.first[top]))
        near = np.bitwise_count(self.code[1:] ^ self.code[:-1]) <= DISTANCE
        ends = np.append(self.first[top], self.n)
        near[ends[1:-1] - 1] = False  # neighbours in different buckets
        k = np.flatnonzero(near)
        self.link(k, k + 1)
        todo = [(top, roots[i : i + PAIRS], roots[i : i + PAIRS]) for i in range(0, len(roots), PAIRS)]
        while todo:
            level, a, b = todo.pop()
            one = self.one(level)
            keep = (one[a] < 0) | (one[a] != one[b])
            a, b = a[keep], b[keep]
            both = self.shared[level][a] & self.shared[level][b]
            apart = np.bitwise_count((self.value[level][a] ^ self.value[level][b]) & both)
            most = apart + np.bitwise_count(~both)
            whole = most <= DISTANCE
            if whole.any():
                if level:
                    self.chain(level, np.unique(np.concatenate([a[whole & (np.bitwise_count(~self.shared[level][a]) <= DISTANCE)], b[whole]])))
                self.link(self.first[level][a[whole]], self.first[level][b[whole]])
            open_ = ~whole & (apart <= DISTANCE)
            if level and open_.any():
                todo += self._below(level, a[open_], b[open_])
        return self.label

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator:
        child = self.child[level]
        na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
        step = max(1, PAIRS // (FAN * FAN))
        for lo in range(0, len(a), step):
            s = slice(lo, lo + step)
            n = na[s] * nb[s]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(nb[s], n)
            x, y = np.repeat(child[a[s]], n) + k // wide, np.repeat(child[b[s]], n) + k % wide
            keep = x <= y
            yield level - 1, x[keep], y[keep]


def bucket_links(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smaller fingerprint of its component) for each one that is linked
    to another in some bucket; rows in bucket order."""
    code = fp.view(np.uint64)
    order = np.lexsort((gray_rank(code), bucket))
    code = code[order]
    label = Index(bucket[order], code).join()
    linked = label != np.arange(len(label))
    return code[linked].view(np.int64), code[label[linked]].view(np.int64)


def _block(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _rest(fp: Column, first: int, bits: int) -> Column:
    low = fp.bitwiseAND(F.lit((1 << first) - 1))
    return low if first + bits == 64 else F.shiftleft(F.shiftrightunsigned(fp, first + bits), first).bitwiseOR(low)


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, fp): every fingerprint in a bucket for each block, heavy buckets dealt
    again by the blocks of the other bits."""
    fp = F.col("fp")
    each = F.array(*(F.struct((_block(fp, a, n) + (k << 13)).alias("bucket"), _rest(fp, a, n).alias("rest")) for k, (a, n) in enumerate(BLOCKS)))
    dealt = classes.select("fp", F.explode_outer(each).alias("x")).select("fp", "x.bucket", "x.rest")
    # at most 5 * 2^13 rows, whatever the input
    heavy = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("bucket", F.lit(True).alias("heavy"))
    dealt = dealt.join(F.broadcast(heavy), "bucket", "left")
    inner = F.array(*(((F.col("bucket") * 8 + k + 1) * 4096) + _block(F.col("rest"), a, n) for k, (a, n) in enumerate(INNER)))
    again = F.when(F.col("heavy"), inner).otherwise(F.array(F.col("bucket") * 8 * 4096))
    return dealt.select("fp", F.explode_outer(again).alias("bucket")).select("bucket", "fp")


def links(classes: DataFrame) -> DataFrame:
    """(u, v) with v < u as unsigned index order: enough links between distinct
    fingerprints to connect all that are within ``DISTANCE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = bucket_links(b, f)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            b, f = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate((held_b, held_f)))
            whole = int(np.searchsorted(b, b[-1])) if len(b) else 0  # the last bucket may go on
            if whole:
                yield out(b[:whole], f[:whole])
            held_b, held_f = b[whole:], f[whole:]
        if len(held_b):
            yield out(held_b, held_f)

    dealt = buckets(classes).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node that is
    reachable. Large and small stars in turn; each round ends in the shared folder."""
    edges = X.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        edges = X.cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id among
    all rows that can be reached over links, null if all of them lack one."""
    docs = X.cut(fingerprints(df, id_col, text_col))
    classes = X.cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that a large component is split in the join
    named = X.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_class = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return docs.join(by_class, "fp").select("doc_id", "fp", "component_id")


def one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, with all its columns, whatever their names: the one with the
    smallest id (rows without one come last), of those with that id the one with the least text hash,
    of rows alike any. Two texts that share an id are judged each by its own component."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fp, key = X.fresh(df, "fp", "key")
    named = df.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("key"), text.alias("text"))

    def make(texts: pa.Array) -> list:
        return [pa.array(np.array([fingerprint(t) for t in X.strings(texts)], np.uint64).view(np.int64))]

    docs = X.cut(X.with_columns(named, "text", make, "fp long").select("id", "key", "fp"))
    # of each class its first row; nulls last
    place = F.struct(F.col("id").isNull().alias("late"), "id", "key")
    classes = X.cut(docs.groupBy("fp").agg(F.min(place).alias("first")))
    roots = connected(links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias(fp), F.col("first.key").alias(key))
    kept = df.join(first, F.col(id_col).eqNullSafe(F.col(fp)) & (F.sha2(text, 256) == F.col(key)), "left_semi")
    alike = X.fresh(df, "alike")[0]
    return kept.withColumn(alike, F.sha2(text, 256)).dropDuplicates([id_col, alike]).drop(alike)
