"""Vectors as one byte for each of sixteen parts, by dual-tree Lloyd rounds.

A component x becomes the integer floor(256 * x); a vector is cut into ``PARTS`` equal parts,
each position with a codebook of at most ``ENTRIES`` entries that starts as that part of the
vectors with the least ids. Within a task, blocks of parts form a tree for each position (halved
at the median of the widest component, with the bounding box, sum and count of each node)
and the entries form another. Pairs of a part node and an entry node go down together: a
pair goes where its boxes are further apart than some entry certainly is from
every part of the node, or where one entry is nearer than another to the whole box. A node
with one entry left takes it as a whole, with its cached sum. What is uncertain at the leaves
is told by distances of single parts. All bounds and distances are integers and only strictly worse
entries go, so ties reach the leaves and the lower index wins. What is shuffled are sums and
counts for each position and entry; codebooks are at most ``PARTS`` x ``ENTRIES`` entries.

Vectors that are null, or hold a null or non-finite component, are left out, and those
whose length differs from the one with the least id (such vectors have no parts to compare).
A length that 16 does not divide is cut at floor(p * length / 16). Integers are clipped where
squared distances would leave a long (beyond 741,455 times 256 for 64 components). Rows
with one id, and rows alike, are vectors of their own; equal ids are ordered by
their components, null ids come last. Null labels are a label. Label errors beyond a long are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers of a block of vectors that shares its trees; parts of a leaf.
BLOCK, LEAF = 1 << 19, 16
#: Labels up to which their sums are broadcast; beyond, rows are dealt by label and one of SALTS.
LABELS, SALTS = 100_000, 16


def cuts(size: int, parts: int = PARTS) -> list[int]:
    return [p * size // parts for p in range(parts + 1)]


def integers(values: np.ndarray, size: int) -> np.ndarray:
    """floor(SCALE * x), clipped where a squared distance of ``size`` components would not
    fit a long."""
    bound = math.isqrt((1 << 63) // max(size, 1)) // 2 - 1
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


class Tree:
    """Balanced tree of rows of integers; level k has at most 2**k nodes, each a stretch of
    ``order`` with its bounding box, sum and count."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.order = np.arange(n)
        edges = np.array([0, n])
        self.levels: list[tuple[np.ndarray, ...]] = []
        while True:
            p = points[self.order]
            low, high = np.minimum.reduceat(p, edges[:-1]), np.maximum.reduceat(p, edges[:-1])
            self.levels.append((edges, low, high, np.add.reduceat(p, edges[:-1])))
            size = np.diff(edges)
            if size.max() <= leaf or not p.shape[1]:
                return
            node = np.repeat(np.arange(len(size)), size)
            wide = np.argmax(high - low, axis=1)
            along = p[np.arange(n), wide[node]]
            self.order = self.order[np.lexsort((along, node))]
            # every node is halved (one of a single row has an empty left half, which is left out)
            edges = np.unique(np.concatenate([edges, edges[:-1] + size // 2]))

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(first child, end child) in the next level of each node of a level."""
        below = self.levels[level + 1][0]
        at = np.searchsorted(below, self.levels[level][0])
        return at[:-1], at[1:]


def _pairs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x) for every x from lo[k] to hi[k] - 1."""
    size = hi - lo
    k = np.repeat(np.arange(len(lo)), size)
    return k, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[k]


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared length of each row."""
    return np.einsum("ij,ij->i", x, x)


def _apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of two boxes."""
    near = np.maximum(np.maximum(low - high2, low2 - high), 0)
    far = np.maximum(high - low2, high2 - low)
    return _squared(near), _squared(far)


def assign(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry, lower of equals, for each row; sum and count of the rows of
    each entry; (nodes taken whole, single distances)), from trees over both."""
    n, k = len(points), len(entries)
    code = np.zeros(n, np.int64)
    total, count, work = np.zeros(entries.shape, np.int64), np.zeros(k, np.int64), np.zeros(2, np.int64)
    if not n:
        return code, total, count, work
    tree, other = Tree(points, LEAF), Tree(entries, 1)
    node, side, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    last, bottom = len(tree.levels) - 1, len(other.levels) - 1

    def settle(node: np.ndarray, entry: np.ndarray, edges: np.ndarray, sums: np.ndarray) -> None:
        work[0] += len(node)
        np.add.at(total, entry, sums[node])
        np.add.at(count, entry, np.diff(edges)[node])
        at, row = _pairs(edges[node], edges[node + 1])
        code[tree.order[row]] = entry[at]

    while True:
        # entries go down first: their tree is the smaller one
        edges, low, high, sums = tree.levels[level]
        while True:
            _, low2, high2, _ = other.levels[depth]
            near, far = _apart(low[node], high[node], low2[side], high2[side])
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            best = np.minimum.reduceat(far, first)[np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))]
            keep = near <= best
            node, side = node[keep], side[keep]
            if depth == bottom:
                break
            lo, hi = other.children(depth)
            at, side = _pairs(lo[side], hi[side])
            node, depth = node[at], depth + 1
        entry = other.order[side]
        # an entry goes if the likeliest one is nearer to every point of the box
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        group = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))
        middle = low[node] + high[node] - 2 * entries[entry]
        off = _squared(middle.astype(np.float64))
        likely = np.lexsort((off, group))[first]
        winner = entry[likely][group]
        a, b = entries[winner], entries[entry]
        corner = np.where(b > a, high[node], low[node])  # the corner that b likes best
        worse = _squared(corner - a) < _squared(corner - b)
        node, entry, group = node[~worse], entry[~worse], group[~worse]
        alone = np.bincount(group)[group] == 1
        settle(node[alone], entry[alone], edges, sums)
        node, entry = node[~alone], entry[~alone]
        if level == last or not len(node):
            break
        lo, hi = tree.children(level)
        at, node = _pairs(lo[node], hi[node])
        place = np.argsort(other.order)
        side = place[entry[at]]
        order = np.lexsort((side, node))
        node, side, level = node[order], side[order], level + 1
    if len(node):
        edges = tree.levels[level][0]
        order = np.lexsort((entry, node))
        node, entry = node[order], entry[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(first, len(node)))
        # every row of a leaf with the leaf's entries, in their order
        leaf, at = _pairs(edges[node[first]], edges[node[first] + 1])
        row = tree.order[at]
        which, at = _pairs(first[leaf], first[leaf] + size[leaf])
        work[1] += len(which)
        d = _squared(points[row[which]] - entries[entry[at]])
        start = np.cumsum(size[leaf]) - size[leaf]
        least = np.flatnonzero(d == np.minimum.reduceat(d, start)[which])
        pick = least[np.concatenate([[True], which[least[1:]] != which[least[:-1]]])]
        code[row] = best = entry[at[pick]]
        np.add.at(total, best, points[row])
        count += np.bincount(best, minlength=k)
    return code, total, count, work


def kept(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): rows whose vector is whole and finite, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(v.isNotNull() & ~F.coalesce(odd, F.lit(False)))


def _matrix(v: pa.Array, size: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), size)


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK // max(size, 1))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _sums(vectors: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """(part, entry, total, n) of one round's assignment."""
    at = cuts(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for block in _blocks(batch, size):
                x = integers(_matrix(block.column(0), size), size)
                for p, book in enumerate(books):
                    _, t, c, _ = assign(x[:, at[p] : at[p + 1]], book)
                    total[p] += t
                    count[p] += c
        rows = [(p, k, total[p][k].tolist(), int(count[p][k])) for p in range(PARTS) for k in np.flatnonzero(count[p]).tolist()]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "entry", "total", "n"])

    sums = vectors.select("v").mapInArrow(run, "part int, entry int, total array<long>, n long")
    # totals component by component, wider than a long
    flat = sums.select("part", "entry", "n", F.posexplode_outer("total").alias("i", "x"))
    flat = flat.groupBy("part", "entry", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    return flat


def train(vectors: DataFrame) -> tuple[int, list[np.ndarray]]:
    """(components of a vector, codebook of each position) after all rounds, from
    ``kept`` rows. What reaches the driver are ENTRIES vectors, then their sums."""
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow().column(0).to_pylist()
    size = len(start[0]) if start else 0
    if any(len(v) != size for v in start):
        vectors = vectors.where(F.size("v") == size)
        start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow().column(0).to_pylist()
    at = cuts(size)
    first = integers(np.array(start, np.float64).reshape(len(start), size), size)
    books = [first[:, at[p] : at[p + 1]].copy() for p in range(PARTS)]
    if not size:
        return size, books
    for _ in range(ROUNDS):
        for r in _sums(vectors.where(F.size("v") == size), books, size).collect():
            if r["i"] is not None:
                books[r["part"]][r["entry"], r["i"]] = int(r["x"]) // r["n"]
    return size, books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All integers by part, entry and place within the part."""
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def encode(vectors: DataFrame, size: int, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code binary, error) of the ``kept`` rows of ``size`` components."""
    at = cuts(size)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, size):
                x = integers(_matrix(block.column(2), size), size)
                code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    part = x[:, at[p] : at[p + 1]]
                    code[:, p] = c = assign(part, book)[0]
                    error += _squared(part - book[c])
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["vec_id", "label", "code", "error"])

    rows = vectors.where(F.size("v") == size).select("vec_id", "label", "v")
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, v): the vectors that codes stand for, as multiples of 1 / SCALE."""
    kind = codes.schema["vec_id"].dataType.simpleString()

    def columns(batch: pa.RecordBatch) -> list:
        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, PARTS)
        x = np.concatenate([b[code[:, p]] for p, b in enumerate(books)], axis=1) / SCALE
        return [batch.column(0), pa.array(list(x), pa.list_(pa.float64()))]

    return X.map_batches(codes.select("vec_id", "code"), columns, f"vec_id {kind}, v array<double>")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels, nulls together."""
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("x"))
    sums = sums.select(F.col("label").alias("of_label"), F.expr("try_cast(x AS long)").alias("label_error"))
    if sums.limit(LABELS + 1).count() <= LABELS:
        return codes.join(F.broadcast(sums), _same("label", "of_label"), "left").drop("of_label")
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    sums = sums.withColumn("of_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return salted.join(sums, _same("label", "of_label") & (F.col("salt") == F.col("of_salt")), "left").drop("of_label", "of_salt", "salt")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error), codebooks)."""
    vectors = kept(df, id_col, vector_col, label_col)
    size, books = train(vectors)
    return with_label_error(X.cut(encode(vectors, size, books))), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()
