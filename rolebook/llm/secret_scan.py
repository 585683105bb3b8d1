"""Secrets: fixed patterns, and formats inferred from labelled credentials.

Base kinds assign, access and hex are found leftmost and non-overlapping for each kind.
For each kind, values that the patterns found in a bounded sample are the labelled
credentials: their prefix tree is folded, state by state, wherever the frequencies of
two states are statistically compatible (Hoeffding bound), into a probabilistic
automaton. Ordinary tokens give a background automaton the same way. Tokens are the runs
of credential characters, cut at base spans, from the shortest labelled length upwards.
Every one is scored: the best kind's log-likelihood less the background's. Those that
reach ``MARGIN`` are added as ``format``.

Offsets are code points, the end exclusive. Null texts read as empty and have no spans;
repeated rows give repeated rows; a kind without a labelled value has no automaton.
"""

from __future__ import annotations

import math
import re
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolebook.llm import texts as X
from rolebook.llm.pii import luhn

KINDS = ("assign", "access", "hex", "format")
#: Bounds of the training sample: different documents looked at, distinct values of a kind, characters
#: of a value, and characters of all values of a kind (of longer formats fewer values are learned).
SAMPLE_DOCS, SAMPLE_VALUES, SAMPLE_CHARS, SAMPLE_TOTAL = 40_000, 400, 512, 25_600
#: Confidence of the merge test; log-likelihood ratio that makes a token a secret, and
#: how much of it each character has to bring.
CONFIDENCE, MARGIN, MARGIN_CHAR = 0.05, 12.0, 0.5
#: Log-probability of a character an automaton does not expect; it starts anew there.
SURPRISE = math.log(1e-4)

ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: Characters of the shortest value that a pattern can label.
LEAST = 6
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST},}}+")
#: Tokens whose score a worker remembers.
REMEMBERED = 1 << 16


def base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def tokens(text: str, spans: list[tuple[str, int, int]], least: int = LEAST) -> list[tuple[int, int]]:
    """Runs of credential characters without their parts in base spans: the pieces of
    ``least`` or more characters."""
    out, k, reach = [], 0, 0
    spans = sorted((a, b) for _, a, b in spans)
    for m in TOKEN.finditer(text):
        at, b = m.span()
        at = max(at, min(reach, b))
        while k < len(spans) and spans[k][0] < b:
            if spans[k][0] - at >= least:
                out.append((at, spans[k][0]))
            reach = max(reach, spans[k][1])
            at = max(at, min(reach, b))
            k += 1
        if b - at >= least:
            out.append((at, b))
    return out


class Automaton:
    """A probabilistic automaton: next state and log-probability of (state, symbol),
    log-probability of ending in a state; length of the shortest value learned."""

    def __init__(self, step: dict[tuple[int, str], tuple[int, float]], end: dict[int, float], shortest: int = 0):
        self.step, self.end, self.shortest = step, end, shortest

    def log_likelihood(self, value: str) -> float:
        state, total = 0, 0.0
        for c in value:
            hit = self.step.get((state, c))
            if hit is None:
                total += SURPRISE
                state = 0
            else:
                state = hit[0]
                total += hit[1]
        return total + self.end.get(state, SURPRISE)

    def rows(self) -> list[tuple[int, str, int, float]]:
        return [(s, c, t, p) for (s, c), (t, p) in self.step.items()] + [(s, "", -1, p) for s, p in self.end.items()] + [(-1, "", self.shortest, 0.0)]

    @classmethod
    def of_rows(cls, rows) -> Automaton:
        rows = list(rows)
        shortest = max((t for s, _, t, _ in rows if s < 0), default=0)
        return cls({(s, c): (t, p) for s, c, t, p in rows if c}, {s: p for s, c, _, p in rows if not c and s >= 0}, shortest)


def infer(values: list[str]) -> Automaton:
    """Fold the prefix tree of the values: states are tried against those already
    kept, in breadth-first order, and merged with the first compatible one."""
    seen, ends = [0], [0]  # values through a state, values ending there
    arcs: list[dict[str, list]] = [{}]  # symbol -> [state, count]
    for v in values:
        s = 0
        seen[0] += 1
        for c in v:
            if c not in arcs[s]:
                seen.append(0)
                ends.append(0)
                arcs.append({})
                arcs[s][c] = [len(arcs) - 1, 0]
            arc = arcs[s][c]
            arc[1] += 1
            s = arc[0]
            seen[s] += 1
        ends[s] += 1
    root = math.sqrt(0.5 * math.log(2 / CONFIDENCE))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > root * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        """b is the root of a tree; a may lie on cycles."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], seen[a], ends[b], seen[b]):
                return False
            for c in arcs[a].keys() | arcs[b].keys():
                x, y = arcs[a].get(c), arcs[b].get(c)
                if differ(x[1] if x else 0, seen[a], y[1] if y else 0, seen[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ends[a] += ends[b]
            for c, (t, n) in arcs[b].items():
                if c in arcs[a]:
                    arcs[a][c][1] += n
                    todo.append((arcs[a][c][0], t))
                else:
                    arcs[a][c] = [t, n]

    kept = [0]
    queue = deque((0, c) for c in sorted(arcs[0]))
    is_kept = {0}
    while queue:
        s, c = queue.popleft()
        t = arcs[s][c][0]
        if t in is_kept:
            continue
        for k in kept:
            if compatible(k, t):
                arcs[s][c][0] = k
                fold(k, t)
                # folding may hang new trees below kept states
                queue.extend((x, d) for x in kept for d in sorted(arcs[x]) if arcs[x][d][0] not in is_kept and (x, d) not in queue)
                break
        else:
            kept.append(t)
            is_kept.add(t)
            queue.extend((t, d) for d in sorted(arcs[t]))
    step, end = {}, {}
    for s in kept:
        total = ends[s] + sum(n for _, n in arcs[s].values())
        for c, (t, n) in arcs[s].items():
            step[s, c] = (t, math.log(n / total))
        if ends[s]:
            end[s] = math.log(ends[s] / total)
    return Automaton(step, end, min(map(len, values), default=0))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Automaton]:
    """Automata by kind, and ``""`` for the background. Each is inferred in a task of
    its own from at most ``SAMPLE_VALUES`` values; the transitions come to the driver."""
    docs = X.pairs(df, id_col, text_col)
    docs = X.sample(docs, SAMPLE_DOCS)

    def values(batch: pa.RecordBatch) -> list:
        kinds, found = [], []
        for t in X.strings(batch.column(1)):
            t = t or ""
            spans = base(t)
            for kind, a, b in spans:
                v = ASSIGN.match(t, a, b)[1] if kind == "assign" else t[a:b]
                if len(v) <= SAMPLE_CHARS:
                    kinds.append(kind)
                    found.append(v)
            for a, b in tokens(t, spans):
                if b - a <= SAMPLE_CHARS:
                    kinds.append("")
                    found.append(t[a:b])
        return [pa.array(kinds, pa.string()), pa.array(found, pa.string())]

    seen = X.map_batches(docs, values, "kind string, value string").distinct()
    shortest = seen.where("kind <> ''").agg(F.min(F.length("value")).alias("n")).first().n
    if shortest is None:  # nothing to compare tokens with
        return {}
    seen = seen.where((F.col("kind") != "") | (F.length("value") >= shortest))
    # of each kind the values of least hashes, as many as both bounds allow; the sample is bounded
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    size = F.sum(F.length("value")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = seen.select("kind", "value", F.row_number().over(order).alias("i"), size.alias("size"))
    chosen = chosen.where((F.col("i") <= SAMPLE_VALUES) & (F.col("size") <= SAMPLE_TOTAL)).select("kind", "value")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = infer(sorted(pdf["value"])).rows()
        out = pd.DataFrame(rows, columns=["state", "symbol", "target", "p"])
        out.insert(0, "kind", key[0])
        return out

    rows = chosen.groupBy("kind").applyInPandas(fit, "kind string, state long, symbol string, target long, p double").collect()
    out = {k: Automaton.of_rows((r.state, r.symbol, r.target, r.p) for r in rows if r.kind == k) for k in {r.kind for r in rows}}
    for a in out.values():  # of the whole sample, also where fewer values are learned from
        a.shortest = shortest
    return out


#: Numbers as texts write them (dates, amounts, addresses, phone numbers; card numbers by their checksum):
#: the log-probability of a digit, and of a sign between digits.
NUMBER, DIGIT, SIGN = re.compile(r"\+[0-9]+|[0-9]+(?:[./_-]+[0-9]+)+[.]?"), math.log(1 / 10), math.log(1 / 8)


def written_number(value: str) -> bool:
    return bool(NUMBER.fullmatch(value)) or (value.isascii() and value.isdigit() and 13 <= len(value) <= 19 and luhn(value))


def ratio(value: str, automata: dict[str, Automaton]) -> float:
    """Log-likelihood of the best kind less that of the background, for which a word in
    capitals is also the word in small letters (at the odds of one in two), and a written number
    also any number of its shape. Other runs of digits are tokens like any."""
    best = max((a.log_likelihood(value) for k, a in automata.items() if k), default=-math.inf)
    other = automata[""].log_likelihood(value) if "" in automata else SURPRISE * len(value)
    if "" in automata and value.isupper():
        other = max(other, automata[""].log_likelihood(value.lower()) - math.log(2))
    if written_number(value):
        other = max(other, sum(DIGIT if c.isdigit() else SIGN for c in value))
    return best - other


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find(df: DataFrame, automata: dict[str, Automaton], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, score), by start, then kind; the
    score is the log-likelihood ratio, for base spans of the text they cover."""
    sent = df.sparkSession.sparkContext.broadcast({k: a.rows() for k, a in automata.items()})
    least = min((a.shortest for k, a in automata.items() if k), default=None)
    made: dict[str, Automaton] = {}
    scored: dict[str, float] = {}

    def score(token: str) -> float:
        r = scored.get(token)
        if r is None:
            r = ratio(token, made)
            if len(token) <= SAMPLE_CHARS:
                if len(scored) >= REMEMBERED:
                    scored.clear()
                scored[token] = r
        return r

    def spans_of(text: str) -> list[dict]:
        spans = base(text)
        out = [(kind, a, b, ratio(text[a:b], made)) for kind, a, b in spans]
        for a, b in tokens(text, spans, max(least, LEAST)) if least is not None else ():
            r = score(text[a:b])
            if r >= max(MARGIN, MARGIN_CHAR * (b - a)):
                out.append(("format", a, b, r))
        out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return [{"kind": k, "start": a, "end": b, "score": round(r, 4) if math.isfinite(r) else None} for k, a, b, r in out]

    def columns(batch: pa.RecordBatch) -> list:
        if not made:
            made.update({k: Automaton.of_rows(r) for k, r in sent.value.items()})
        return [batch.column(0), pa.array([spans_of(t or "") for t in X.strings(batch.column(1))], pa.list_(SPAN))]

    return X.map_batches(X.pairs(df, id_col, text_col), columns, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
