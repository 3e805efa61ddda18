"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; one longer text is a step of its own.
STEP_BYTES = 1 << 19


#: Bytes of rows that Spark sends to a Python worker at once; one longer row goes alone.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES, so that workers stay small with long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def plain_strings(column) -> pa.Array:
    """A string column as one array without nulls (null: empty) that starts at offset 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset else column


def utf8_steps(column, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; offsets start at 0."""
    column = plain_strings(column)
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def list_array(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


MIX_1, MIX_2, MIX_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + MIX_1
    x = (x ^ (x >> np.uint64(30))) * MIX_2
    x = (x ^ (x >> np.uint64(27))) * MIX_3
    return x ^ (x >> np.uint64(31))


BASE = 0xD6E8FEB86659FD93  # odd, so that powers have inverses modulo 2**64
_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j for j < n, kept and grown by doubling."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            table, have = np.ones(1, np.uint64), 1
            while have < size:
                table = np.concatenate([table, table * np.uint64(pow(base, have, 1 << 64))])
                have *= 2
            _powers[name] = table
    return _powers["up"], _powers["down"]


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer: equal bytes, equal hash."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte ranges, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def held_out(column: str, folds: int, fold: int):
    """True where crc32 of the id as text leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, folds: int, fold: int, key: str = "doc_id"
) -> DataFrame:
    """At most ``limit`` labelled rows of ``docs`` outside the held-out fold, as (key, text, label).

    Rows are taken by the hash of their id, so the choice is random but stable. Null ids, null
    labels are no labels; an id labelled twice takes its largest label. The chosen ids are
    bounded by ``limit``, so they are broadcast and the texts never shuffle.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds, fold))
        .groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    return (
        docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col(key) == F.col("_id"))
        .select(key, "text", F.col("_label").alias("label"))
    )
