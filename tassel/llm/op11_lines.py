"""Line dedup: lines that several documents have are dropped from all of them but the one with the largest doc_id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, in_arrow
from .units import NO_ID

#: Lines whose key is shorter (in code points) always stay.
MIN_CHARS = 20
#: So many documents make a line a common one.
MIN_DOCS = 3
BLANKS = " \t\n\v\f\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line without blanks at its ends and with A-Z lowered; None for a short one."""
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


def _own_keys(min_chars: int):
    """Each key of each text once, beside the document's id and the text's hash."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for n, text in enumerate(batch.column(2)):
                own = {line_key(line, min_chars) for line in text.as_py().split("\n")}
                own.discard(None)
                found.extend(own)
                owner.extend([n] * len(own))
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.binary())],
                names=["id", "text_hash", "key"],
            )

    return keys


def _without(min_chars: int):
    """The lines of each text whose key is not among the dropped ones, joined again in their order."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2)):
                text, gone = text.as_py(), gone.as_py()
                n_lines.append(text.count("\n") + 1)
                if gone is None:
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                gone = set(gone)
                left = [line for line in text.split("\n") if line_key(line, min_chars) not in gone]
                n_dropped.append(n_lines[-1] - len(left))
                kept.append("\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_lines", "n_dropped", "kept"],
            )

    return lines


def drop_common_lines(
    docs: DataFrame, keep: list[str], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``keep`` with n_lines (before), n_dropped and kept (the text of the lines that stay, joined by line feeds).

    ``docs`` has doc_id and text. Lines are cut at line feeds only. A line's key is the line without spaces, tabs,
    vertical tabs, form feeds and carriage returns at both ends and with A-Z lowered. A key of at least
    ``min_chars`` code points found in at least ``min_docs`` documents loses its lines everywhere except in the
    document with the largest doc_id that holds it; there all of them stay.

    Rows of one doc_id are one document when documents are counted, and all of them are it when it keeps a line.
    Rows without a doc_id count as one document, smaller than all others. A null or empty text is one empty line.
    Repeated rows each come back. Without rows there are none.

    Each text gives each of its keys once (a 128-bit hash, never the line). Which keys are common is a two-step
    distinct count; the common ones are joined to the keys of all texts, and what a text loses is gathered by
    doc_id and text, so a group is never larger than one text. The three tables between are written, so that
    both joins are of plain shuffled tables: Spark broadcasts the small side only if its files are small, and
    splits a hot line or a row that is repeated a million times as a skewed join.
    """
    scratch = Scratch(docs.sparkSession, "common-lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    keys = scratch.table(in_arrow(own, _own_keys(min_chars), "id long, text_hash long, key binary"), "keys")
    counted = keys.groupBy("key").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keeper"))
    common = scratch.table(counted.filter(F.col("docs") >= min_docs).select("key", "keeper"), "common")
    lost = keys.join(common, "key").filter("id <> keeper")
    gone = scratch.table(lost.groupBy("id", "text_hash").agg(F.collect_set("key").alias("gone")), "gone")

    rows = docs.select(
        F.struct(*keep).alias("row"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("text_hash"),
    )
    beside = rows.join(gone, ["id", "text_hash"], "left").select("row", "text", "gone")
    schema = StructType(
        [
            StructField("row", beside.schema["row"].dataType),
            StructField("n_lines", LongType()),
            StructField("n_dropped", LongType()),
            StructField("kept", StringType()),
        ]
    )
    return in_arrow(beside, _without(min_chars), schema).select("row.*", "n_lines", "n_dropped", "kept")
