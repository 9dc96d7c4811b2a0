"""Shared helpers: scratch tables, and words of whole texts as 64-bit hashes in numpy."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tassel.session import checkpoint_dir

#: Rows in an Arrow batch: whole texts can be long, and a task holds a batch on both sides.
BATCH_ROWS = 1000
#: A slice of texts that numpy handles at once; one longer text makes a longer slice.
SLICE_BYTES = 1 << 20


class Scratch:
    """A folder of its own in the shared checkpoint folder, for tables between the steps of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``df`` written as Parquet and read back: later steps neither recompute it nor depend on executors."""
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package from where the driver has it.

    On a cluster the package is installed or sent with the job; then the extra path does no harm. Batches are
    held to ``BATCH_ROWS`` rows (a setting of the session, lowered but never raised).
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows)) <= BATCH_ROWS:
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    settings = df.sparkSession.sparkContext.environment
    paths = [p for p in settings.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        settings["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df.mapInArrow(function, schema)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_beside(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and, unless one of them holds it, the column ``text`` (a name or ``column.field``)."""
    return docs.select(*keep) if text.split(".")[0] in keep else docs.select(*keep, text)


def text_in(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The texts of a batch of :func:`text_beside`."""
    name, _, field = text.partition(".")
    column = batch.column(name)
    return pc.struct_field(column, field) if field else column


# ---------------------------------------------------------------------------------------------- texts in numpy


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def _letters() -> np.ndarray:
    """0 for what is no word byte, else the byte with A-Z lowered: words are runs of 0-9, a-z and bytes from 128."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


WORD_BYTES = _letters()
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.zeros(0, np.uint64)
_inverse = np.zeros(0, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1024)
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                table = np.multiply.accumulate(steps)
                if base == _BASE:
                    _powers = table
                else:
                    _inverse = table
    return _powers, _inverse


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes with 0 between words, first byte of each word, words before each text)."""
    low = WORD_BYTES[raw]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    return low, starts, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words before each text)."""
    low, starts, bounds = word_starts(raw, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), bounds
    powers, inverse = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(low.astype(np.uint64) * powers[: len(raw)], starts) * inverse[starts]
    return mix64(sums), bounds


_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (``len(words) - k + 1`` of them); the caller masks text ends."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out *= _STEP
            out += words[j : j + n]
    return mix64(out)


def gram_places(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions where k words of one text begin, grams before each text)."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    before = np.concatenate(([0], np.cumsum(counts)))
    shift = bounds[:-1] - before[:-1]
    return np.arange(before[-1]) + np.repeat(shift, counts), before
