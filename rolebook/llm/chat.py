"""Chat formatting in budgeted windows.

Turns are read in order and cut into turn-aligned windows: the prefix sums of the turns'
tokens say how many more turns fit. Tokens are what ``size`` of a row says, in production the ids
of the formatted turn, marks and escapes included (``sized``); without it words and signs. A window repeats the system turn and a limited
history, whose targets are masked, then holds its own turns; only its own assistant turns
carry loss, so each does so once. The system turn that opens a conversation stands in
front of every later window; only history makes room. A turn that does not fit beside it
has a window for itself, whole, which then exceeds the budget.

Template: ``<s>``, then for each turn ``[INST]role[/INST]text</s>``. In roles and texts a
control string is escaped by a backslash, and backslashes in front of one, or at the end,
are doubled; ``unescape`` takes that back exactly.

Null roles and texts read as empty; rows without conv_id form one conversation. Turns are
ordered by turn (null first), ties by role, then text; repeated rows are turns of their
own. Conversations are streamed in turn order from a shuffle sorted by (conv_id, turn):
a task holds one window, whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolebook.llm import bpe
from rolebook.llm import texts as X

#: Tokens of a window, and the history that it may repeat: turns and tokens.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 256, 2, 64
#: Tokens of a turn's marks.
MARKS = 4
SYSTEM, ASSISTANT = "system", "assistant"

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
_ESCAPE = re.compile(rf"(?<!\\)(\\*+)({CONTROL}|\Z)")
_UNESCAPE = re.compile(rf"(?<!\\)(\\++)({CONTROL}|\Z)")
_TURN = re.compile(r"\[INST\](.*?)(?<!\\)((?:\\\\)*)\[/INST\](.*?)(?<!\\)((?:\\\\)*)</s>", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    """Backslashes before a control string or the end are doubled, and a control string
    gets one more."""
    return _ESCAPE.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def tokens(role: str, text: str) -> int:
    """Words and signs of a turn, and its marks."""
    return MARKS + sum(1 for _ in _TOKEN.finditer(text))


@dataclass
class Turn:
    role: str
    text: str
    size: int
    before: int  # prefix sum: tokens of all turns before it


@dataclass
class Windows:
    """The windows of one conversation, fed turn by turn. Where the system turn and the
    next turn exceed the budget, the window exceeds it too."""

    number: int = 0
    total: int = 0
    system: Turn | None = None
    recent: list[Turn] = field(default_factory=list)
    repeated: list[Turn] = field(default_factory=list)
    own: list[Turn] = field(default_factory=list)

    def add(self, role: str, text: str, size: int | None = None) -> dict | None:
        """The window that ends before this turn, if one does."""
        turn = Turn(role, text, tokens(role, text) if size is None else size, self.total)
        self.total += turn.size
        if not self.number and not self.own and role == SYSTEM:
            self.system = turn
        done = None
        if self.own and sum(t.size for t in self.repeated) + self.total - self.own[0].before > BUDGET:
            done = self.close()
            self.repeated = self._context(turn)
        self.own.append(turn)
        self.recent = [*self.recent, turn][-HISTORY_TURNS:]
        return done

    def _context(self, turn: Turn) -> list[Turn]:
        head = [self.system] if self.system else []
        room = BUDGET - turn.size - sum(t.size for t in head)
        if room < 0:  # no history
            return head
        past = [t for t in self.recent if t is not self.system]
        while past and turn.before - past[0].before > min(room, HISTORY_TOKENS):
            past.pop(0)
        return head + past

    def close(self) -> dict | None:
        """The window at hand."""
        if not self.own:
            return None
        out, at, targets = ["<s>"], 3, []
        for i, t in enumerate(self.repeated + self.own):
            head, body = f"[INST]{escape(t.role)}[/INST]", escape(t.text)
            if i >= len(self.repeated) and t.role == ASSISTANT:
                targets.append({"start": at + len(head), "end": at + len(head) + len(body)})
            out += [head, body, "</s>"]
            at += len(head) + len(body) + 4
        done = {"window": self.number, "repeated": len(self.repeated), "text": "".join(out), "targets": targets}
        self.number += 1
        self.own = []
        return done


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(m[1] + m[2]), unescape(m[3] + m[4])) for m in _TURN.finditer(text, 3)]


def formatted(role: str, text: str) -> str:
    """A turn as the template writes it."""
    return f"[INST]{escape(role)}[/INST]{escape(text)}</s>"


def sized(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``size``: the ids that the byte-level encoder gives the
    formatted turn."""
    sent = df.sparkSession.sparkContext.broadcast(bpe.read_ranks(rank_path))
    df = df.select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*kinds, "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codec = bpe.codec_of(sent, pattern, bpe.CHUNK)
            sizes = []
            for role, text in zip(X.strings(batch.column(2)), X.strings(batch.column(3)), strict=True):
                sizes.append(len(codec.encode([formatted(role or "", text or "")])[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names)

    return df.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", size long")


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def windows(df: DataFrame) -> DataFrame:
    """(conv_id, window, repeated, text, targets) from rows (conv_id, turn, role, text) and, where
    they have one, a column ``size``: how many turns a window repeats at its start, its formatted text, and the (start,
    end) code points under the loss mask."""
    target = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ("window", "repeated", "text", "targets")
    kinds = (pa.int64(), pa.int64(), pa.string(), target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, made, ids, out = None, Windows(), [], []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(ids, pa.int64()), *(pa.array([w[n] for w in out], k) for n, k in zip(names, kinds, strict=True))]
            ids.clear()
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *names])

        def keep(done: dict | None) -> None:
            if done:
                ids.append(conv)
                out.append(done)

        for batch in batches:
            for c, role, text, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv:
                    keep(made.close())
                    conv, made = c, Windows()
                keep(made.add(role or "", text or "", size))
                if len(out) >= 1000:
                    yield flush()
        keep(made.close())
        yield flush()

    size = F.col("size").cast("long") if "size" in df.columns else F.lit(None).cast("long").alias("size")
    rows = _ordered(df.select("conv_id", "turn", "role", "text", size), "turn", "role", "text").select("conv_id", "role", "text", "size")
    return rows.mapInArrow(run, "conv_id long, window long, repeated long, text string, targets array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read
    from the windows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, state = None, None

        def end() -> None:
            if state:
                rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for c, repeated, text, targets in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or c != conv:
                    end()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for t in targets:
                    body = unescape(text[t["start"] : t["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
                if len(rows) >= 1000:
                    yield flush()
        end()
        yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _ordered(formatted, "window").select("conv_id", "repeated", "text", "targets").mapInArrow(run, schema)
