"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

UPPER = bytes(range(65, 91))
#: Byte tables: ASCII capitals become small letters; ALNUM also turns every byte that is no letter, digit or part of a
#: non-ASCII character into a space, so that ``split`` gives the words.
LOWER = bytes.maketrans(UPPER, UPPER.lower())
ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
ALNUM_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD = rb"[^\x20\x09-\x0D]+"
CAPITALS, SMALLS = UPPER.decode(), UPPER.lower().decode()

#: Text bytes that a kernel takes at once; a longer single text is taken alone.
SHARD_BYTES = 24_000_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALLS)


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def lowest(df: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows of each ``key`` with the smallest hashes of doc_id, numbered in ``n``. Rows whose hash is far above
    are left out first, by the group's count, so the task that numbers a group sees little more than ``size`` rows. There
    is one row for each key at the driver (labels, languages)."""
    counts = {r[0]: r[1] for r in df.groupBy(key).count().collect()}
    if counts:
        upto = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (1.2 * size + 200) / n)])[F.col(key)]
        df = df.where(F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5) <= upto)
    order = Window.partitionBy(key).orderBy(F.xxhash64("doc_id"), "doc_id")
    return df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``limit`` bytes of ``column`` (a single longer text is a piece)."""
    for batch in batches:
        sizes = np.array([0 if v is None else v for v in pc.binary_length(batch[column]).to_pylist()], np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def columns_schema(df: DataFrame, more: str) -> str:
    """DDL of ``df``'s columns followed by ``more``."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {more}" if more else own


def fresh_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as ``df`` needs to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or not name.startswith("_"):
        name = "_" + name
    return name


class Flat:
    """Positions of variable-length groups laid out one after another."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if len(self.sizes) else np.zeros(0, np.int64)
        self.total = int(self.sizes.sum())
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.starts + self.sizes] - total[self.starts]
