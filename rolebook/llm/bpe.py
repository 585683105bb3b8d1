"""Byte-level BPE encoding and decoding.

Every match of the pre-tokenizer pattern is mapped byte by byte to printable
characters and merged by the ``tokenizers`` library, and ids turn back into bytes
through the same byte table. A worker encodes each distinct chunk (white space and
the run after it) once and keeps a bounded memory of chunks; lookups, offsets and
decoding are array gathers over a run of texts.

Characters that Python's Unicode tables do not know yet are cut by the tiktoken
library, as tables of different age would disagree on whether they are letters.

Nulls read as empty texts; an empty text has no ids; repeated rows give repeated
rows; any other column is left alone. Ids that the vocabulary lacks raise.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolebook.llm import texts as X

#: Distinct chunks a worker remembers; past it the memory starts anew.
CHUNKS_KEPT = 150_000
#: No match of the public pattern goes on from a non-space into white space, so
#: texts may be cut there. Pass None with a pattern of which that is not true.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"


def byte_table() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1
    characters for themselves, the others counted up from 256."""
    visible = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
    spare = (chr(c) for c in range(256, 512))
    return [c or next(spare) for c in visible]


def read_ranks(path: str) -> bytes:
    """The rank file as it is: a vocabulary, so bounded, sent once to executors."""
    with open(path, "rb") as f:
        return f.read()


class Ragged:
    """Rows of unequal length over one flat array."""

    def __init__(self, rows: list, dtype):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if rows else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(rows), dtype) if dtype == np.uint8 else np.array([x for r in rows for x in r], dtype)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows one after the other, where each starts and the end)."""
        return gather(self.flat, self.first[rows], self.size[rows])


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return flat[np.repeat(first - at[:-1], size) + np.arange(at[-1])], at


class Codec:
    """Encoder and decoder of one rank file and one pattern."""

    def __init__(self, rank_file: bytes, pattern: str, chunk: str | None = CHUNK, kept: int = CHUNKS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import models

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        table = byte_table()
        shown = {k: "".join(table[b] for b in k) for k in ranks}
        # every way to halve a token is a merge of that token's rank
        merges = [(shown[k[:i]], shown[k[i:]]) for k in sorted(ranks, key=ranks.get) for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        self.model = models.BPE(vocab={shown[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.table = dict(enumerate(table))
        self.pieces, self.chunk = regex.compile(pattern), re.compile(chunk) if chunk else None
        self.newer = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        back = {c: b for b, c in enumerate(table)}
        by_id = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            by_id[v] = bytes(back[c] for c in shown[k])
        self.known_ids = np.array([len(b) > 0 for b in by_id])
        self.bytes_of = Ragged(by_id, np.uint8)
        self.digits = Ragged([b"%d," % v for v in range(len(by_id))], np.uint8)
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.ids_of: dict[str, list[int]] = {}

    def _piece(self, p: str) -> list[int]:
        ids = self.ids_of.get(p)
        if ids is None:
            ids = self.ids_of[p] = [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.table))]
        return ids

    def _merge(self, chunk: str) -> list[int]:
        if not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk):
            return self.newer.encode_ordinary(chunk)
        cut = self.pieces.findall(chunk)
        return self._piece(cut[0]) if len(cut) == 1 else [i for p in cut for i in self._piece(p)]

    def _learn(self, chunks: set[str]) -> None:
        new = [self._merge(c) for c in chunks]
        self.row.update(zip(chunks, range(len(self.row), len(self.row) + len(new)), strict=True))
        size = np.fromiter(map(len, new), np.int64, len(new))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(new), np.int32, size.sum())])
        self.size = np.concatenate([self.size, size])
        self.first = np.cumsum(self.size) - self.size

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and the end); no
        special tokens."""
        cut = [self.chunk.findall(t) if self.chunk else [t] for t in batch]
        if len(self.row) > self.kept:
            self._forget()
        self._learn(set().union(*cut).difference(self.row))
        get = self.row.__getitem__
        rows = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        ids, at = gather(self.flat, self.first[rows], self.size[rows])
        ends = np.cumsum([0, *map(len, cut)])
        return ids, at[ends]

    def check(self, ids: np.ndarray) -> np.ndarray:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known_ids) or not self.known_ids[ids].all()):
            raise ValueError("an id outside the vocabulary")
        return ids

    def decode_bytes(self, ids) -> bytes:
        return self.bytes_of.take(self.check(ids))[0].tobytes()

    def decode(self, ids) -> str:
        """Bytes joined first, so characters split over tokens come back whole;
        a character cut off at an end of ``ids`` reads as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict = {}


def codec_of(sent, pattern: str, chunk: str | None) -> Codec:
    key = (hashlib.sha1(sent.value).digest(), pattern, chunk)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(sent.value, pattern, chunk)
    return _codecs[key]


def _batches(df: DataFrame, rank_path: str, pattern: str, chunk: str | None, make, schema: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def columns(batch: pa.RecordBatch) -> list:
        codec = codec_of(sent, pattern, chunk)
        data, at = X.text_bytes(batch.column(1))
        parts = []
        for lo, hi in X.runs(at):
            whole = [data[at[i] : at[i + 1]].tobytes().decode() for i in range(lo, hi)]
            parts.append(make(codec, *codec.encode(whole)))
        return [batch.column(0), *(pa.concat_arrays(c) for c in zip(*parts, strict=True))]

    return X.map_batches(df, columns, schema)


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def encode(df: DataFrame, rank_path: str, pattern: str, chunk: str | None = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts): the token ids of each text and the byte offset at
    which each token starts (inside a character, where one is split)."""

    def make(codec: Codec, ids: np.ndarray, at: np.ndarray) -> tuple:
        size = codec.bytes_of.size[ids]
        starts = np.cumsum(size) - size
        whole = np.append(starts, size.sum())[at[:-1]]
        return _lists(ids, at, pa.int32()), _lists(starts - np.repeat(whole, np.diff(at)), at, pa.int64())

    return _batches(X.pairs(df, id_col, text_col), rank_path, pattern, chunk, make, "doc_id long, ids array<int>, starts array<long>")


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text, bytes) of rows of ids; null ids read as none."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def columns(batch: pa.RecordBatch) -> list:
        codec = codec_of(sent, pattern, CHUNK)
        raw = [codec.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
        return [batch.column(0), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string()), pa.array(raw, pa.binary())]

    return X.map_batches(df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids"), columns, "doc_id long, text string, bytes binary")


def digests(codec: Codec, ids: np.ndarray, at: np.ndarray) -> tuple:
    """(number, digest of the decimal ids, digest of the decoded bytes) of each text."""
    raw, raw_at = codec.bytes_of.take(codec.check(ids))
    dec, dec_at = codec.digits.take(ids)
    sha = lambda x, lo, hi: hashlib.sha256(x[lo:hi]).hexdigest()
    a, b = dec_at[at], raw_at[at]
    return (
        pa.array(np.diff(at), pa.int64()),
        pa.array([sha(dec, a[i], max(a[i], a[i + 1] - 1)) for i in range(len(at) - 1)], pa.string()),
        pa.array([sha(raw, b[i], b[i + 1]) for i in range(len(at) - 1)], pa.string()),
    )


def round_trip(df: DataFrame, rank_path: str, pattern: str, chunk: str | None = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and
    of the bytes that decoding those ids gives."""
    return _batches(
        X.pairs(df, id_col, text_col), rank_path, pattern, chunk, digests,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
