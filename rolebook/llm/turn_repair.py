"""Cheapest repair of a conversation's turns by dynamic programming over a grammar.

A row is one of nine symbols: must be deleted (blank or duplicate), or its role's initial (s, u,
a, any other) with or without the fault "truncated". Keeping costs 0, another
role 1, deletion 2, an inserted turn 5, a truncated row that stays 5 more; what is left must read
``(s?(ua)+)?``. For one symbol the costs between the four states of that language (start,
after s, after u, after a) are a min-plus matrix, each cell with the edits that reach
it; the least cost wins, then the edits least in ASCII. A row's edits are any insertions and
then its own, so every edit sequence has one reading, and cells of one cost never hold a
prefix of each other.

Re-Pair replaces the most frequent pair of neighbouring symbols over all conversations by a
new symbol, again and again; a rule's matrix is the min-plus product of its two parts' and
its edits are a rope that shares theirs, so each rule is evaluated once, bottom-up, for all
conversations. A round makes rules of several pairs that cannot overlap. At most ``RULES`` rules
are made in ``ROUNDS`` rounds, so what reaches the driver and the tasks is bounded; symbols without a rule are multiplied as they are, with the same result.

Rows are range-partitioned by conversation and turn and read in pieces of at most ``PIECE``
rows, so a conversation may span many tasks; a piece is a string of symbols and a few
counts. Their matrices are applied in order, a lookup a piece. The repaired rows are streamed in
order, one conversation in one task as its digest needs, holding one row and the edits.

Rows are ordered by turn (nulls first), then role and the hash of the text. Null roles and texts read as one
space; rows alike are repeats of each other, hence duplicates. Roles may be anything: another
initial must be rewritten or deleted, and an empty role has no initial. A null conversation
id is a conversation. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

#: Rows of a piece; rules of the grammar, rounds of counting and rules made in a round.
PIECE, RULES, ROUNDS, AT_ONCE = 1024, 128, 8, 32
#: Different sequences that one task counts the pairs of.
SEQUENCES = 20_000

BLANKS = r"[\x20\x09-\x0D]"
#: The first symbol is a row that must go; then initials s, u, a, other, whole and truncated.
FIRST = 0x100
MUST_GO = chr(FIRST)
INITIALS = "sua?"


# ---- ropes and matrices -----------------------------------------------------------------


class Rope:
    """Edits as a shared binary tree of strings; size and hash tell most ropes apart."""

    __slots__ = ("hash", "left", "right", "size")
    MOD, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self, left, right=None):
        self.left, self.right = left, right
        if right is None:
            self.size, self.hash = len(left), 0
            for c in left:
                self.hash = (self.hash * self.BASE + ord(c)) % self.MOD
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(self.BASE, right.size, self.MOD) + right.hash) % self.MOD

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope(self, other)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            r = stack.pop()
            if r.right is None:
                out.append(r.left)
            else:
                stack += [r.right, r.left]
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """ASCII order; equal stretches are skipped by their hashes."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.size, x.hash) == (y.size, y.hash):
                continue
            if x.right is not None and (x.size >= y.size or y.right is None):
                a += [x.right, x.left]
                b.append(y)
            elif y.right is not None:
                b += [y.right, y.left]
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.left[:n] != y.left[:n]:
                    return x.left < y.left
                if x.size > n:
                    a.append(Rope(x.left[n:]))
                if y.size > n:
                    b.append(Rope(y.left[n:]))
        return bool(b)


NOTHING = Rope("")
#: A cell is (cost, edits) or None; a matrix is 4 x 4 cells by state before and after.
Cell = tuple[int, Rope] | None
Matrix = tuple[tuple[Cell, ...], ...]
#: State after writing u or a from a state; s is written at the start alone.
U = {0: 2, 1: 2, 3: 2}
A = {2: 3}
S = {0: 1}
ENDS = (0, 3)


def better(a: Cell, b: Cell) -> Cell:
    if a is None or b is None:
        return a or b
    return b if b[0] < a[0] or (b[0] == a[0] and b[1] < a[1]) else a


def product(x: Matrix, y: Matrix) -> Matrix:
    def cell(i: int, j: int) -> Cell:
        best: Cell = None
        for k in range(4):
            if x[i][k] and y[k][j] and (best is None or x[i][k][0] + y[k][j][0] <= best[0]):
                best = better(best, (x[i][k][0] + y[k][j][0], x[i][k][1] + y[k][j][1]))
        return best

    return tuple(tuple(cell(i, j) for j in range(4)) for i in range(4))


def _matrix(moves: list[tuple[int, int, int, str]]) -> Matrix:
    rows: list[list[Cell]] = [[None] * 4 for _ in range(4)]
    for i, j, cost, edit in moves:
        rows[i][j] = better(rows[i][j], (cost, Rope(edit)))
    return tuple(map(tuple, rows))


IDENTITY = _matrix([(i, i, 0, "") for i in range(4)])
_ONE = _matrix([(i, i, 0, "") for i in range(4)] + [(i, j, 5, "I") for move in (U, A) for i, j in move.items()])
#: Any insertions: three lead from each state to each that can be reached.
INSERTS = product(product(_ONE, _ONE), _ONE)


def symbol(initial: str | None, truncated: bool) -> str:
    return chr(FIRST + 1 + INITIALS.index(initial if initial in ("s", "u", "a") else "?") + 4 * truncated)


def base_matrices() -> dict[str, Matrix]:
    gone = [(i, i, 2, "D") for i in range(4)]
    out = {MUST_GO: product(INSERTS, _matrix(gone))}
    for initial in INITIALS:
        for truncated in (False, True):
            more = 5 * truncated
            keep = [(i, j, more, "K") for i, j in {"s": S, "u": U, "a": A}.get(initial, {}).items()]
            # another role: writing the same one again never pays
            other = [(i, j, 1 + more, "R") for move in (U, A) for i, j in move.items()]
            out[symbol(initial, truncated)] = product(INSERTS, _matrix(gone + keep + other))
    return out


class Grammar:
    """Rules (pair -> symbol) in order, and the matrix of every symbol."""

    def __init__(self, pairs: list[str]):
        self.rules = [(p, chr(FIRST + 0x100 + k)) for k, p in enumerate(pairs)]
        self.matrix = base_matrices()
        for pair, new in self.rules:
            self.matrix[new] = product(self.matrix[pair[0]], self.matrix[pair[1]])

    def compressed(self, symbols: str) -> str:
        for pair, new in self.rules:
            if len(symbols) < 2:
                break
            symbols = symbols.replace(pair, new)
        return symbols

    def of(self, symbols: str) -> Matrix:
        out = IDENTITY
        for s in self.compressed(symbols):
            out = product(out, self.matrix[s])
        return out


def cheapest(row: tuple[Cell, ...]) -> tuple[int, str]:
    """The best end of the cells reached from the start, insertions at the end among them."""
    best: Cell = None
    for i in range(4):
        for j in ENDS:
            if row[i] and INSERTS[i][j]:
                best = better(best, (row[i][0] + INSERTS[i][j][0], row[i][1] + INSERTS[i][j][1]))
    return best[0], best[1].text()


# ---- rows -> pieces ---------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, copy): rows of (conv_id, turn, role, text) with the
    faults that the checksum of ``conv_id:turn`` deals; dropped rows are marked gone."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), F.concat_ws(":", spaced("conv_id"), spaced("turn")).alias("key"))
    d = d.withColumn("deal", F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(20)))
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("deal") == 0).alias("gone"), F.explode(copies).alias("copy"))


def _faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tie, copy, gone, blank, truncated, k1, k2): narrow rows."""
    trimmed = F.regexp_replace("text", rf"{BLANKS}+\z", "")
    last = F.substring(trimmed, -1, 1)
    return rows.select(
        "conv_id", "turn", "role", F.xxhash64("text").alias("tie"), "copy", "gone",
        (trimmed == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
        F.xxhash64("role", F.lit("a"), "text").alias("k1"), F.xxhash64("text", F.lit("b"), "role").alias("k2"),
    )


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("tie").asc(), F.col("copy").asc()]


def _symbols(rows: DataFrame) -> DataFrame:
    """Narrow rows with their ``fault`` (blank, duplicate, truncated or null)."""
    key = ["conv_id", "k1", "k2"]
    place = F.struct(F.col("turn").isNotNull().alias("late"), "turn", "copy")
    # a second copy always follows its first; rows alike of one turn are told apart in order
    seen = rows.where("NOT gone AND NOT blank AND copy = 0").groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    seen = seen.where("n > 1").select(F.col("conv_id").alias("c"), F.col("k1").alias("a"), F.col("k2").alias("b"), "first", F.lit(True).alias("again"))
    both = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")), "left")
    later = F.coalesce(F.col("again"), F.lit(False)) & (place > F.col("first"))
    fault = F.when(F.col("blank"), "blank").when((F.col("copy") == 1) | later, "duplicate").when(F.col("truncated"), "truncated")
    return both.select("conv_id", "turn", "role", "tie", "copy", "gone", F.when(~F.col("gone"), fault).alias("fault"))


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low {turn}, high {turn}, head string, tail string"


def _pieces(rows: DataFrame) -> DataFrame:
    """(part, piece, conv_id, symbols, counts ...) of at most ``PIECE`` rows each, in order."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["part", "piece", "conv_id", "symbols", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail"]
    schema = f"part int, piece long, conv_id {kind['conv_id']}, symbols string, " + _COUNTS.format(turn=kind["turn"])
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        open_: dict | None = None
        n, before = 0, None

        def close() -> None:
            nonlocal n, open_
            if open_ is not None:
                o = open_
                made.append((o["part"], n, o["conv"], "".join(o["symbols"]), o["blank"], o["duplicate"], o["truncated"], o["illegal"], o["turns"], o["low"], o["high"], o["head"], o["tail"]))
                n += 1
            open_ = None

        types = None
        for batch in batches:
            types = types or [pa.int32(), pa.int64(), batch.column(1).type, pa.string(), *[pa.int64()] * 5, *[batch.column(2).type] * 2, pa.string(), pa.string()]
            for part, conv, turn, role, tie, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_["conv"] != conv or len(open_["symbols"]) >= PIECE:
                    close()
                    open_ = {"part": part, "conv": conv, "symbols": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "head": None, "tail": None}
                if gone:
                    continue
                o, initial = open_, role[:1]
                if fault != "blank" and before == (conv, turn, role, tie):
                    fault = "duplicate"
                before = (conv, turn, role, tie)
                o["symbols"].append(MUST_GO if fault in ("blank", "duplicate") else symbol(initial, fault == "truncated"))
                if fault:
                    o[fault] += 1
                if o["tail"] is not None and o["tail"] + initial not in legal:
                    o["illegal"] += 1
                o["tail"] = initial
                if o["head"] is None:
                    o["head"] = initial
                if turn is not None and turn != o["high"]:
                    o["turns"] += 1
                    o["low"] = turn if o["low"] is None else o["low"]
                    o["high"] = turn
            if len(made) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)
                made.clear()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    ranged = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return ranged.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "tie", "gone", "fault").mapInArrow(run, schema)


# ---- grammar ----------------------------------------------------------------------------


def _pair_counts(symbols: str) -> Counter:
    """Neighbouring pairs that do not overlap with an equal one before."""
    out: Counter = Counter()
    last: dict[str, int] = {}
    for i in range(len(symbols) - 1):
        pair = symbols[i : i + 2]
        if last.get(pair, -2) < i - 1:
            out[pair] += 1
            last[pair] = i
    return out


def learn(sequences: DataFrame, rules: int | None = None) -> Grammar:
    """Re-Pair over rows (symbols, n): in each round the most frequent pairs, of which
    none ends with what another starts with (so that they never overlap), become rules."""
    pairs: list[str] = []
    limit = RULES if rules is None else rules
    sequences = sequences.select("symbols", "n").coalesce(sequences.count() // SEQUENCES + 1)

    def counts(known: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grammar = Grammar(known)
            total: Counter = Counter()
            for batch in batches:
                for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for pair, k in _pair_counts(grammar.compressed(s)).items():
                        total[pair] += k * n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        return sequences.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    for _ in range(ROUNDS):
        starts: set[str] = set()
        ends: set[str] = set()
        made = len(pairs)
        for r in counts(list(pairs)).where("n > 1").orderBy(F.desc("n"), "pair").limit(AT_ONCE).collect():
            a, b = r["pair"]
            if len(pairs) < limit and a not in ends and b not in starts:
                starts.add(a)
                ends.add(b)
                pairs.append(r["pair"])
        if len(pairs) in (made, limit):
            break
    return Grammar(pairs)


# ---- plan and repair --------------------------------------------------------------------


def plan(rows: DataFrame, rules: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each
    conversation of rows (conv_id, turn, role, text, gone, copy)."""
    pieces = X.cut(_pieces(_symbols(_faulty(rows))))
    sequences = X.cut(pieces.where("symbols <> ''").groupBy("symbols").agg(F.count("*").alias("n")))
    grammar = learn(sequences, rules)
    pairs = [p for p, _ in grammar.rules]
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Grammar(pairs)
        memory: dict[str, Matrix] = {}
        whole: dict[str, tuple[int, str]] = {}
        made: list[tuple] = []
        state: dict | None = None

        def matrix(symbols: str) -> Matrix:
            if symbols not in memory:
                if len(memory) > 20_000:
                    memory.clear()
                memory[symbols] = known.of(symbols)
            return memory[symbols]

        def close() -> None:
            if state is None:
                return
            s = state
            if len(s["symbols"]) == 1 and s["symbols"][0] in whole:
                cost, audit = whole[s["symbols"][0]]
            else:
                row = IDENTITY[0]
                for x in s["symbols"]:
                    row = product((row,) * 4, matrix(x))[0] if x else row
                cost, audit = cheapest(row)
                if len(s["symbols"]) == 1:
                    if len(whole) > 20_000:
                        whole.clear()
                    whole[s["symbols"][0]] = (cost, audit)
            gaps = 0 if s["low"] is None else int(s["high"] - s["low"] + 1 - s["turns"])
            made.append((s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit))

        types = None
        for batch in batches:
            types = types or [batch.column(2).type, *[pa.int64()] * 6, pa.string()]
            for _, _, conv, symbols, blank, duplicate, truncated, illegal, turns, low, high, head, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state["conv"] != conv:
                    close()
                    state = {"conv": conv, "symbols": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "tail": None}
                s = state
                s["symbols"].append(symbols)
                s["blank"] += blank
                s["duplicate"] += duplicate
                s["truncated"] += truncated
                s["illegal"] += illegal
                if head is not None:
                    s["illegal"] += s["tail"] is not None and s["tail"] + head not in legal
                    s["tail"] = tail
                if low is not None:
                    s["turns"] += turns - (s["high"] == low)
                    s["low"] = low if s["low"] is None else s["low"]
                    s["high"] = high
            if len(made) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)
                made.clear()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    ordered = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "piece")
    return ordered.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that the cheapest edits leave, place
    from 0. Rows of a conversation are neighbours, in order, within a partition."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    audits = plans.select(
        "conv_id", F.lit(None).cast(turn).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("tie"), F.lit(0).alias("copy"), F.lit(0).alias("kind")
    )
    own = rows.where("NOT gone").select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("tie"), "copy", F.lit(1).alias("kind"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("kind").asc(), *_order()[1:]]
    names = ["conv_id", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size = 0
        conv, audit, at, place, expect = None, "", 0, 0, "user"

        def write(edit: str, role: str | None, text: str) -> None:
            nonlocal place, expect, size
            role = role if role is not None else expect
            # a kept first system turn is the only row that is neither
            expect = "assistant" if role[:1] == "u" else "user"
            made.append((conv, place, edit, role, text))
            size += len(text)
            place += 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                write("I", None, "")
                at += 1

        types = None
        for batch in batches:
            types = types or [batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for c, role, text, is_row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), X.strings(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if not is_row:
                    inserts()
                    conv, audit, at, place, expect = c, text, 0, 0, "user"
                else:
                    inserts()
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        write(edit, role if edit == "K" else None, text)
                if size > X.RUN_BYTES or len(made) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), types, strict=True)], names)
                    made.clear()
                    size = 0
        inserts()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), types, strict=True)], names)

    both = audits.unionByName(own).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "role", "text", "kind").mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines, streamed over ``repaired`` rows in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            ids, out = [], []
            rows_ = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), X.strings(batch.column(2)), X.strings(batch.column(3)), strict=True)
            for c, place, role, text in rows_:
                if place == 0:
                    if sha is not None:
                        ids.append(conv)
                        out.append(sha.hexdigest())
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(out)], ["conv_id", "sha256"])
            last = batch.column(0).type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last), pa.array([sha.hexdigest()])], ["conv_id", "sha256"])

    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def report(rows: DataFrame, rules: int | None = None) -> DataFrame:
    """``plan`` with the digest of the repaired conversation."""
    plans = X.cut(plan(rows, rules))
    found = digests(repaired(rows, plans)).select(F.col("conv_id").alias("of"), "sha256")
    out = plans.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("sha256")
