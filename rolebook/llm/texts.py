"""Shared helpers: whole texts of an Arrow batch as bytes, rows in bounded runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolebook.session import cut  # noqa: F401

#: Bytes of text handled at once inside a task; one longer text is a run alone.
RUN_BYTES = 1 << 20


def pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under the names the operators use."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fixed folds."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(mod))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sample(df: DataFrame, rows: int, by: str = "", number: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` rows with different (id, text), the least hashes of both; with ``by`` so many
    of each of its values. The bound holds whatever the ids are: rows without one, or sharing one,
    are told apart by their texts, and rows alike count once. ``number`` names a column with the
    number of rows (of that value), which is counted where it is not given."""
    h, p, last, of = fresh(df, "h", "p", "last", "of")
    total = F.col(number) if number else F.lit(max(df.count(), 1))
    named = df.withColumn(h, F.xxhash64(F.col(id_col).cast("string"), text_col)).withColumn(p, F.pmod(F.col(h), total))
    # so many are expected; a few more or less by chance, so the last ones are cut, by numbers alone
    chosen = named.where(F.col(p) < rows + 4 * int(rows**0.5) + 4)
    numbers = chosen.select(*([F.col(by).alias(of)] if by else []), p, h).distinct()
    if by:
        place = F.row_number().over(Window.partitionBy(of).orderBy(p, h))
        numbers = numbers.withColumn("place", place).where(F.col("place") <= rows)
        cuts = numbers.groupBy(of).agg(F.max(F.struct(p, h)).alias(last))
        once = chosen.join(cuts, F.col(by) == F.col(of)).where(F.struct(p, h) <= F.col(last)).drop(of, last)
    else:
        top = numbers.orderBy(p, h).limit(rows).agg(F.max(F.struct(p, h)).alias(last)).first()[last]
        once = chosen.where((F.col(p) < top[p]) | ((F.col(p) == top[p]) & (F.col(h) <= top[h]))) if top else chosen
    return once.dropDuplicates([*([by] if by else []), h]).drop(h, p)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a text column as UTF-8 bytes; null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = max(lo + 1, min(hi, n))
        yield lo, hi
        lo = hi


def text_runs(array: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each run of rows."""
    data, at = text_bytes(array)
    for lo, hi in runs(at, limit):
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """mapInArrow with ``make`` returning the columns of each batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(batch)], names)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, text_col: str, make: Callable[[pa.Array], list], added: str) -> DataFrame:
    """All columns of ``df`` and those that ``make`` gives for the text column of each
    batch, as (name type) pairs; columns of those names are replaced. Batches pass
    through as they are, so long texts are not turned into Python strings."""
    names = [x.split()[0] for x in added.split(", ")]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{x.split()[0]}` {x.split()[1]}" for x in added.split(", ")])
    places = [i for i, f in enumerate(df.schema.fields) if f.name not in names]
    text = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + make(batch.column(text)), [f.name for f in kept] + names)

    return df.mapInArrow(run, schema)


def sum_by_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts`` (len = rows + 1); an
    empty row sums to 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def strings(array: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts one by one, a few hundred at a time as Python strings."""
    for lo in range(0, len(array), rows):
        yield from array.slice(lo, rows).to_pylist()
