"""Language identification by prediction by partial matching over bytes.

For each language a context tree of at most ``ORDER`` bytes is counted on a bounded
sample of labelled rows and then frozen. A byte seen after its context costs
-log2(n / (total + distinct)); an unseen one pays the escape probability
distinct / (total + distinct) and is looked up one byte shorter, without the bytes
already excluded, down to one of 256 equally likely bytes. The language with the
shortest code for the whole text wins; ties go to the first name. Every language that
occurs is learned; ``BLOCK`` languages share a tree, and a task holds one block at a time.

Null texts and texts without a letter give ``und`` with score 0; with no labelled row
every text is ``und``. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

ORDER = 3
#: Bounds of the training sample: different rows of each language, chosen by a hash of their id
#: and text, and characters of one such row (of longer texts the start is learned).
SAMPLE_ROWS, SAMPLE_CHARS = 400, 1 << 16
#: Bounds of a block's model: contexts of an order, the most frequent first, how
#: often a context has to occur, and numbers of the table (each order gets an equal part of what
#: the shorter ones left), so a block's broadcast has at most four times as many bytes.
CONTEXTS, LEAST, CELLS = 20_000, 2, 16_000_000
#: Bytes scored at once in a task.
RUN = 1 << 18
#: Languages of a block.
BLOCK = 8


@dataclass
class Model:
    """symbol: byte -> symbol, the last one for bytes never seen and for the start
    of a text; child[node, symbol]: the node one byte older, or -1; bits[node,
    symbol, language]."""

    languages: list[str]
    symbol: np.ndarray
    child: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text (rows of ``at``) in each language."""
        if not len(data):
            return np.zeros((len(at) - 1, len(self.languages)))
        start = self.symbol.dtype.type(self.bits.shape[1] - 1)
        sym = self.symbol[data]
        first = at[:-1][at[:-1] < at[1:]]
        node, alive = np.zeros(len(data), np.int32), np.ones(len(data), bool)
        for k in range(1, ORDER + 1):
            older = np.empty_like(sym)
            older[k:], older[:k] = sym[:-k], start
            for j in range(min(k, len(data))):
                older[np.minimum(first + j, len(data) - 1)[first + j < len(data)]] = start
            # a text shorter than k bytes has set its successor's first bytes, which are set anyway
            deeper = self.child[node, older]
            alive &= deeper >= 0
            node = np.where(alive, deeper, node)
        return X.sum_by_row(self.bits[node, sym], at)


@dataclass
class Trained:
    """What was counted: n of each (number of a language, gram)."""

    languages: list[str]
    lang: np.ndarray
    gram: np.ndarray
    n: np.ndarray

    def blocks(self) -> Iterator[Model]:
        """The models of ``BLOCK`` languages each, in order, made one at a time. They
        share their symbols, so that code lengths of different blocks compare."""
        seen = symbols(self.gram)
        for lo in range(0, len(self.languages), BLOCK):
            of = (self.lang >= lo) & (self.lang < lo + BLOCK)
            yield build(self.languages[lo : lo + BLOCK], self.lang[of] - lo, self.gram[of], self.n[of], seen)


def fit_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, gram, n): how often ``ORDER`` bytes (0 and a flag before the start)
    and the byte after them occur, from rows (lang number, text)."""

    def count(batches):
        for batch in batches:
            grams, langs = [], []
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in X.text_runs(batch.column(1)):
                length = np.diff(at)
                place = np.arange(len(data)) - np.repeat(at[:-1], length)
                gram = data.astype(np.int64)
                for k in range(1, ORDER + 1):
                    older = np.full(len(data), 256, np.int64)
                    older[k:] = data[:-k] if k < len(data) else older[k:]
                    older[place < k] = 256
                    gram |= older << (9 * k)
                grams.append(gram)
                langs.append(np.repeat(number[lo:hi], length))
            if grams:
                key, n = np.unique(np.concatenate(grams) | (np.concatenate(langs).astype(np.int64) << 40), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 40), pa.array(key & ((1 << 40) - 1)), pa.array(n)], ["lang", "gram", "n"])

    return rows.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def symbols(gram: np.ndarray) -> np.ndarray:
    """The bytes that occur."""
    seen = np.unique(np.concatenate([(gram >> (9 * k)) & 511 for k in range(ORDER + 1)]))
    return seen[seen < 256]


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, seen: np.ndarray | None = None) -> Model:
    """The frozen trees of all languages over one common set of contexts."""
    seen = symbols(gram) if seen is None else seen
    s = len(seen) + 1
    symbol = np.full(257, s - 1, np.uint8 if s <= 256 else np.uint16)
    symbol[seen] = np.arange(s - 1)
    parts = [symbol[(gram >> (9 * k)) & 511].astype(np.int64) for k in range(ORDER + 1)]
    langs = len(languages)
    children, tables = [], []
    nodes, offset = {0: 0}, 0  # context code -> node, of the order before
    child = [np.full((1, s), -1, np.int32)]
    lower = np.full((1, s, langs), 1 / 256)
    level_of = np.zeros(len(gram), np.int64)  # node of each gram at the order at hand, -1 if dropped
    for k in range(ORDER + 1):
        if k:
            code = level_of * s + parts[k]
            code[level_of < 0] = -1
            keys, inverse = np.unique(code, return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(keys))
            keep = (keys >= 0) & (total >= LEAST)
            room = min(CONTEXTS, (CELLS // (s * langs) - sum(map(len, tables))) // (ORDER - k + 1))
            if keep.sum() > room:
                # the most frequent; of equal ones those of the least code
                chosen = np.lexsort((keys, -total))
                chosen = chosen[keep[chosen]][: max(room, 0)]
                keep = np.zeros(len(keys), bool)
                keep[chosen] = True
            fresh = np.full(len(keys), -1, np.int64)
            fresh[keep] = np.arange(keep.sum())
            level_of = fresh[inverse]
            parent, older = keys[keep] // s, keys[keep] % s
            children.append((parent, older))
            lower = lower[parent]
        rows = lower.shape[0]
        counts = np.zeros((rows, s, langs))
        ok = level_of >= 0
        np.add.at(counts, (level_of[ok], parts[0][ok], lang[ok]), n[ok])
        total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        left = np.maximum((lower * (counts == 0)).sum(1, keepdims=True), 1e-9)
        own = np.where(counts > 0, counts / np.maximum(total + distinct, 1), distinct / np.maximum(total + distinct, 1) * lower / left)
        lower = np.where(total > 0, own, lower)
        tables.append(lower.astype(np.float32))
    first = np.cumsum([0, *(len(t) for t in tables)])
    child = np.full((first[-1], s), -1, np.int32)
    for k, (parent, older) in enumerate(children):
        child[first[k] + parent, older] = first[k + 1] + np.arange(len(parent))
    return Model(languages, symbol[:256], child, -np.log2(np.concatenate(tables)))


def train(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trained:
    """Fit on the rows where ``learn`` holds, text and language being not null.

    The number of rows of each language and the counts of the bounded sample come to
    the driver."""
    text = F.col(text_col).cast("string")
    rows = df.where(learn).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    found = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    nothing = np.zeros(0, np.int64)
    if not found:
        return Trained([], nothing, nothing, nothing)
    names = [x for x, _ in found]
    place = F.array_position(F.lit(names), F.col("lang"))
    wanted = rows.withColumn("n", F.element_at(F.lit([n for _, n in found]), place.cast("int")))
    wanted = X.sample(wanted, SAMPLE_ROWS, by="lang", number="n")
    counts = fit_counts(wanted.select((place - 1).alias("lang"), F.substring("text", 1, SAMPLE_CHARS).alias("text")), names).toArrow()
    if not counts.num_rows:
        return Trained([], nothing, nothing, nothing)
    return Trained(names, *(counts.column(c).to_numpy() for c in ("lang", "gram", "n")))


class Sent:
    """The blocks of a model, broadcast one by one. A worker holds one block: a single
    one for good, of several the one at hand, read again for each batch."""

    def __init__(self, df: DataFrame, model: Trained):
        self.languages = model.languages
        self.parts = [df.sparkSession.sparkContext.broadcast(m) for m in model.blocks()]

    def blocks(self) -> Iterator[Model]:
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1:
                part.__dict__.pop("_value", None)  # else every block would stay in memory


def _predicted(texts: pa.Array, sent: Sent) -> list[pa.Array]:
    names = np.array([*sent.languages, "und"], object)
    has_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    known, size = has_letter & bool(sent.languages), np.diff(X.text_bytes(texts)[1])
    bits = [np.concatenate([m.code_lengths(data, at) for _, _, data, at in X.text_runs(texts, RUN)]) for m in sent.blocks()]
    bits = np.concatenate(bits, 1) if bits else np.zeros((len(texts), 1))
    least = bits.min(1)
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    best = np.where(known, bits.argmin(1), len(names) - 1)
    rate = np.where(known, least / np.maximum(size, 1), np.nan)
    return [pa.array(names[best], pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(rate, mask=np.isnan(rate))]


def predict(df: DataFrame, model: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte): the best language, its share among
    all languages by code length, and its bits for each byte (null for ``und``)."""
    sent = Sent(df, model)

    def columns(batch: pa.RecordBatch) -> list:
        return [batch.column(0), *_predicted(batch.column(1), sent)]

    return X.map_batches(X.pairs(df, id_col, text_col), columns, "doc_id long, lang_pred string, score double, bits_per_byte double")


def label(df: DataFrame, model: Trained, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and the prediction's three; columns of those names are
    replaced."""
    sent = Sent(df, model)
    return X.with_columns(df, text_col, lambda texts: _predicted(texts, sent), "lang_pred string, score double, bits_per_byte double")


def identify(df: DataFrame, learn: Column) -> DataFrame:
    """Train on the rows where ``learn`` holds and predict every row of ``df``."""
    return predict(df, train(df, learn))
