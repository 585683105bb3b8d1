"""Entries of JSON documents of any size, read in several tasks.

A document is read as text cut at commas, which Spark splits by bytes like any text. What a
split does to the reader's state (inside a string or not, how many brackets deep) is a small
function of the state it starts in, so a first pass tells each split's function, composing them gives
every start, and the entries are then cut out in place. An entry that lies across splits is put
together from its pieces. What reaches the driver is a few numbers a split.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A string, closed or going on past the text, or a sign of structure.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("|\Z)|[{}\[\],]', re.S)
CLOSE = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


class Reader:
    """Walks through text handed over in parts, each ending after a comma.

    ``level`` is the depth inside the wanted container: 1 for the document itself, 2 for a part of
    it. Places where an entry begins or ends are numbered; ``piece`` gets (number, text, whether it
    is whole) and ``event`` (open or close, number, the key before it)."""

    def __init__(self, inside: bool, depth: int, level: int = 1, piece: Callable = None, event: Callable = None):
        self.inside, self.depth, self.level, self.piece, self.event = inside, depth, level, piece, event
        self.number, self.key, self.held, self.first = 0, None, [], True

    def _cut(self, text: str, whole: bool) -> None:
        self.held.append(text)
        if self.piece:
            self.piece(self.number, "".join(self.held), whole and not self.first)
        self.held, self.first = [], False

    def feed(self, text: str) -> None:
        at = 0
        if self.inside:
            m = CLOSE.match(text)
            if m:
                self.inside, at = False, m.end()
            else:
                at = len(text)
        start = 0
        for m in TOKEN.finditer(text, at):
            sign = text[m.start()]
            if sign == '"':
                self.inside = m[1] != '"'
                if self.depth == self.level - 1:
                    self.key = m[0]
                continue
            if sign == ",":
                if self.depth != self.level:
                    continue
                self._cut(text[start : m.start()], True)
            elif sign in "{[":
                self.depth += 1
                if self.depth != self.level:
                    continue
                self.first = False
                if self.event:
                    self.event("open", self.number + 1, self.key)
            else:
                self.depth -= 1
                if self.depth != self.level - 1:
                    continue
                self._cut(text[start : m.start()], True)
                if self.event:
                    self.event("close", self.number, None)
            self.number += 1
            start = m.end()
        if self.depth >= self.level:
            self.held.append(text[start:])

    def end(self) -> None:
        """The last piece goes on in the next split."""
        if self.depth >= self.level:
            self._cut("", False)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text of the documents between commas, in order."""
    raw = spark.read.option("lineSep", ",").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str | None]]:
    """(file, block, text) of consecutive rows, text None at the end of each split."""
    last = None
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        lo = 0
        for i in range(len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[lo], blocks[lo]):
                if i > lo:
                    key = (files[lo], blocks[lo])
                    if last is not None and last != key:
                        yield *last, None
                    yield *key, ",".join(values[lo:i]) + ","
                    last = key
                lo = i
    if last is not None:
        yield *last, None


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _functions(segments: DataFrame) -> list:
    """(file, block, depth and inside for a start outside, the same for a start inside a string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = None
        for file, block, text in _splits(batches):
            both = both or (Reader(False, 0), Reader(True, 0))
            if text is None:
                (a, b), both = both, None
                yield _batch([(file, block, a.depth, a.inside, b.depth, b.inside)], ["file", "block", "d0", "s0", "d1", "s1"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()])
            else:
                for r in both:
                    r.held, r.level = [], -1  # structure alone
                    r.feed(text)

    return segments.mapInArrow(run, "file string, block long, d0 long, s0 boolean, d1 long, s1 boolean").collect()


def _walk(segments: DataFrame, starts: dict, level: int, want: Callable[[str, int], int | None] | None, base: dict) -> DataFrame:
    """Pieces (file, number, block, text, whole) that are wanted; without ``want`` the events
    of the walk as (file, number, block, text: kind or key, whole: true for open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["file", "number", "block", "text", "whole"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        made: list[tuple] = []
        reader = None
        for file, block, text in _splits(batches):
            if reader is None:
                inside, depth = starts[file, block]
                before = base.get((file, block), 0)

                def piece(n, t, whole, file=file, block=block, before=before):
                    place = want(file, before + n)
                    if place is not None and (not whole or t.strip()):
                        made.append((file, place, block, t, whole))

                def event(kind, n, key, file=file, block=block):
                    made.append((file, n, block, key, kind == "open"))

                reader = Reader(inside, depth, level, piece if want else None, None if want else event)
            if text is not None:
                reader.feed(text)
                if not want:
                    reader.held = []
            else:
                reader.end()
                if not want:
                    # how many numbers the split has, and the last key in it
                    made.append((file, reader.number, block, reader.key, None))
                reader = None
            if len(made) >= 1000:
                yield _batch(made, names, kinds)
                made.clear()
        if made:
            yield _batch(made, names, kinds)

    return segments.mapInArrow(run, "file string, number long, block long, text string, whole boolean")


def entries_of(spark: SparkSession, path: str, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries (file, entry_no, text), issues (file, error)) of every document under ``path``.

    The entries of the document itself, an array or an object, or of its member ``part``: the text of
    an array's element, or of an object's key and value. Numbers count from 0 in the order of the
    document. A document whose strings or brackets do not close, or that has no such part, is an issue and
    has no entries; each entry is checked by whoever parses it.
    """
    segments = _segments(spark, path)
    level = 1 if part is None else 2
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    issues: dict[str, str] = {}
    state: dict[str, tuple[bool, int]] = {}
    for r in sorted(_functions(segments), key=lambda r: (r.file, r.block)):
        inside, depth = state.get(r.file, (False, 0))
        starts[r.file, r.block] = (inside, depth)
        state[r.file] = (r.s1, depth + r.d1) if inside else (r.s0, depth + r.d0)
    for file, (inside, depth) in state.items():
        if inside or depth:
            issues[file] = "document is not valid JSON"
    marks = sorted(_walk(segments, starts, level, None, {}).collect(), key=lambda r: (r.file, r.block, r.number, r.whole is None, r.whole is False))
    base: dict[tuple[str, int], int] = {}
    ranges: dict[str, list[list[int]]] = {}
    total: dict[str, int] = {}
    key: dict[str, str | None] = {}
    for r in marks:
        base.setdefault((r.file, r.block), total.get(r.file, 0))
        at = base[r.file, r.block] + r.number
        if r.whole is None:
            total[r.file] = at
            key[r.file] = r.text or key.get(r.file)
        elif r.whole:
            name = r.text or key.get(r.file)
            if part is None or (name and json.loads(name) == part):
                ranges.setdefault(r.file, []).append([at, at])
        elif ranges.get(r.file) and ranges[r.file][-1][1] == ranges[r.file][-1][0] and at >= ranges[r.file][-1][0]:
            ranges[r.file][-1][1] = at + 1
    for file in state:
        if file not in issues and file not in ranges:
            issues[file] = "document has no entries" if part is None else f"document has no list or object {part}"
    ranges = {f: [x for x in v if x[1] > x[0]] for f, v in ranges.items() if f not in issues}

    def want(file: str, n: int) -> int | None:
        """The entry's place from 0, of several such parts one after the other."""
        before = 0
        for a, b in ranges.get(file, ()):
            if a <= n < b:
                return before + n - a
            before += b - a
        return None

    found = _walk(segments, starts, level, want, base)
    cut = found.where("NOT whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))
    joined = cut.select("file", "number", F.array_join("x.text", "").alias("text"))
    entries = found.where("whole").select("file", "number", "text").union(joined).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    bad = spark.createDataFrame(sorted(issues.items()), "file string, error string")
    return entries.select("file", F.col("number").alias("entry_no"), "text"), bad
